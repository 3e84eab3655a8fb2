"""Repair of conversations by depth-first branch-and-bound over edits of their turns.

A row's edits are Keep (K, cost 0), Rerole to user or assistant (R, 2) and Delete (D, 3);
Insert (I, 2) puts an empty user or assistant turn anywhere. Blank and duplicate rows have
to go, an undeleted truncated row costs 1 more. The repaired roles' initials have to read
``(s?(ua)+)?``; of the cheapest repairs the one whose edits, written in order, are least in
ASCII order counts. As a turn's place tells which role it may get, that string names the repair.

The search (``search``) walks a run of rows with an explicit stack, cheap edits first. A
node is (rows read, state of the pattern); its dominance table keeps the least (cost, edits)
that reached it and drops every worse prefix. The costs that the remaining rows cause in
any repair bound a node from below; what can't beat the incumbent is cut. When the stack is
empty, the incumbent is proved. Equal patterns are searched once per worker (bounded memo).

A conversation may hold any share of the rows. Rows are sorted by range of (conversation,
turn, role, text), so a long one spans tasks. A task answers the conversations it holds
whole and leaves long ones, and those at its edges, as pieces: per piece the best edits from every
state to every state. Few numbers per piece are then chained (the least (cost, edits) to each state,
tracing back the states between pieces), and the pieces' repaired texts are hashed in
order, one piece in memory at a time.

Defined cases: null role or text is one space (a blank text; initial neither s, u nor a).
Null turns come first; a null id is a conversation of its own; a null in the damage key is a space. Rows of one
turn are ordered by role, then text (binary), so equal rows are adjacent. A role's initial
is its first character, case kept; an empty role has none. A conversation without rows after
damage has zeros, no edits and the hash of no bytes. An empty table gives no rows. Columns
other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import SPACES, store

SALTS = 16
PIECE_ROWS = 4096
PIECE_CHARS = 4 << 20
BLOCK_ROWS = 64
MEMO = 20_000

# States of the pattern: nothing yet, after the system turn, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_ACCEPTED = (START, ASSISTANT)
_NEXT = (USER, USER, ASSISTANT, USER)
_KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
_GOALS = ((START, SYSTEM, USER, ASSISTANT), (SYSTEM, USER, ASSISTANT), (USER, ASSISTANT), (USER, ASSISTANT))

# A row as one letter: initial s, u, a or x (other); upper case if truncated; d has to go.
MUST_GO = "d"
Best = tuple[int, str]


# -- search -----------------------------------------------------------------------------


def _floor(row: str) -> int:
    """What a row costs in any repair."""
    if row == MUST_GO:
        return 3
    cut = row.isupper()
    return min(3, 2 + cut) if row in "xX" else int(cut)


@lru_cache(maxsize=MEMO)
def search(rows: str, entry: int, whole: bool) -> dict[int, Best]:
    """The least (cost, edits) from state ``entry`` over ``rows`` to each state that can end it.

    ``whole`` asks for the best accepted end only, returned under its state.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + _floor(rows[i])
    incumbents: dict[int, Best] = {}
    winner: int | None = None
    dominant: dict[tuple[int, int], Best] = {(0, entry): (0, "")}
    stack: list[tuple[int, int, int, str]] = [(0, entry, 0, "")]

    def beaten(i: int, state: int, cost: int, edits: str) -> bool:
        goals = (winner,) if whole else _GOALS[state]
        for goal in goals:
            known = incumbents.get(goal)
            if known is None or cost + rest[i] < known[0]:
                return False
            if cost + rest[i] == known[0] and edits <= known[1][: len(edits)]:
                return False
        return True

    while stack:
        i, state, cost, edits = stack.pop()
        if dominant[i, state] != (cost, edits) or beaten(i, state, cost, edits):
            continue
        if i == n and (not whole or state in _ACCEPTED):
            goal = state
            if whole:
                if winner is None or (cost, edits) < incumbents[winner]:
                    incumbents, winner = {goal: (cost, edits)}, goal
            elif goal not in incumbents or (cost, edits) < incumbents[goal]:
                incumbents[goal] = (cost, edits)
        after = _NEXT[state]
        children = [(i, after, cost + 2, edits + "I")]
        if i < n:
            row = rows[i]
            if row == MUST_GO:
                children.append((i + 1, state, cost + 3, edits + "D"))
            else:
                extra = int(row.isupper())
                children.insert(0, (i + 1, state, cost + 3, edits + "D"))
                children.append((i + 1, after, cost + 2 + extra, edits + "R"))
                kept = _KEEPS[state].get(row.lower())
                if kept is not None:
                    children.append((i + 1, kept, cost + extra, edits + "K"))
        for child in children:
            node, value = child[:2], child[2:]
            known = dominant.get(node)
            if (known is None or value < known) and not beaten(*child):
                dominant[node] = value
                stack.append(child)
    return incumbents


def _extended(upto: dict[int, Best], rows: str) -> tuple[dict[int, Best], dict[int, int]]:
    """The least (cost, edits) to each state after ``rows`` too, and the state each came from."""
    out: dict[int, Best] = {}
    origin: dict[int, int] = {}
    for entry, (cost, edits) in upto.items():
        for state, (more, last) in search(rows, entry, False).items():
            found = (cost + more, edits + last)
            if state not in out or found < out[state]:
                out[state], origin[state] = found, entry
    return out, origin


def moves(rows: str, entry: int) -> dict[int, Best]:
    """As ``search`` for all ends, over any number of rows: blocks are searched and chained."""
    upto: dict[int, Best] = {entry: (0, "")}
    for at in range(0, len(rows), BLOCK_ROWS):
        upto, _ = _extended(upto, rows[at : at + BLOCK_ROWS])
    return upto


def repair(rows: str) -> Best:
    """(cost, edits) of the whole conversation."""
    if len(rows) <= BLOCK_ROWS:
        (found,) = search(rows, START, True).values()
        return found
    ends = moves(rows, START)
    return min(ends[state] for state in _ACCEPTED if state in ends)


def repaired(edits: str, entry: int, rows: str, turns: list[tuple[str, str]]) -> list[str]:
    """``role:text`` of the repaired turns; ``turns`` holds the rows that may stay."""
    out, state, i, at = [], entry, 0, 0
    for edit in edits:
        if edit == "I":
            state = _NEXT[state]
            out.append(f"{_ROLES[state]}:")
            continue
        row = rows[i]
        i += 1
        if row == MUST_GO:
            continue
        role, text = turns[at]
        at += 1
        if edit == "K":
            state = _KEEPS[state][row.lower()]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = _NEXT[state]
            out.append(f"{_ROLES[state]}:{text}")
    return out


# -- rows -------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults of the contract: conv_id, turn, role, text, n (copies), gone."""
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fate.alias("fate"))
    text = (
        F.when(F.col("fate") == 1, "")
        .when(F.col("fate") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    gone = F.col("fate") == 0
    # A dropped row only says that its conversation exists.
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(~gone, F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(~gone, text).alias("text"),
        F.when(F.col("fate") == 3, 2).otherwise(1).cast("bigint").alias("n"),
        gone.alias("gone"),
    )


def _place(turn: str) -> Column:
    return F.struct(F.col(turn).isNotNull().alias("there"), F.col(turn).alias("turn"))


def _faults(rows: DataFrame) -> DataFrame:
    """One row per distinct (conversation, turn, role, text), with its copies and faults."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    last = F.right(bare, F.lit(1))
    found = rows.groupBy("conv_id", "gone", "turn", "role", "text").agg(F.sum("n").alias("n"))
    found = found.select(
        "*",
        (bare == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64("text", "role").alias("h2"),
    )
    found = store(found, "turns")
    # Equal texts of other turns. The table of those that come again is copied to a fixed
    # number of salts, so that the rows of a text said very often are no single task's load.
    again = found.where(~F.col("gone") & ~F.col("blank")).groupBy("conv_id", "h1", "h2")
    again = again.agg(F.min(_place("turn")).alias("first"), F.count("*").alias("times")).where("times > 1")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    again = again.select(F.col("conv_id").alias("conv"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first", salts.alias("slot"))
    same = (
        F.col("conv_id").eqNullSafe(F.col("conv"))
        & (F.col("h1") == F.col("k1"))
        & (F.col("h2") == F.col("k2"))
        & (F.pmod(F.xxhash64("turn"), F.lit(SALTS)) == F.col("slot"))
    )
    later = F.coalesce(_place("turn") > F.col("first"), F.lit(False)) & ~F.col("blank")
    return found.join(again, same, "left").select(
        "conv_id", "gone", "turn", "role", "text", "n", "blank", "cut", later.alias("again")
    )


_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_PIECE = (
    "part int, no bigint, rows string, roles array<string>, texts array<string>, "
    "first string, last string, least bigint, most bigint, turns bigint"
)


class _Run:
    """Consecutive rows of one conversation: letters, turns that may stay and counts."""

    def __init__(self) -> None:
        self.rows: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.size = self.chars = 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first: str | None = None
        self.last: str | None = None
        self.least = self.most = None
        self.turns = 0

    def add(self, turn, role: str, text: str, count: int, blank: bool, again: bool, cut: bool, copies: bool) -> None:
        """``count`` equal rows; ``copies`` says that an equal row came right before."""
        initial = role[:1]
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.illegal += count - 1
        self.last = initial
        self.size += count
        if blank:
            self.blank += count
            self.rows.append(MUST_GO * count)
            return
        new = 0 if again or copies else 1
        self.duplicate += count - new
        if new:
            self.truncated += cut
            letter = initial if initial in ("s", "u", "a") else "x"
            self.rows.append(letter.upper() if cut else letter)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)
        if count > new:
            self.rows.append(MUST_GO * (count - new))

    def gaps(self) -> int:
        return self.most - self.least + 1 - self.turns if self.turns else 0


def _answers(
    batches: Iterable[pa.RecordBatch], schema: pa.Schema, piece_rows: int, piece_chars: int
) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> one row per finished conversation, and pieces of the others."""
    part = TaskContext.get().partitionId()
    out: list[dict] = []
    run, current, opened = _Run(), None, False
    first_here, no = True, 0
    began = False

    def piece() -> None:
        nonlocal run, no, opened
        out.append(
            {
                "conv_id": current[0],
                "done": False,
                "part": part,
                "no": no,
                "rows": "".join(run.rows),
                **{k: getattr(run, k) for k in ("blank", "duplicate", "truncated", "illegal")},
                **{k: getattr(run, k) for k in ("roles", "texts", "first", "last", "least", "most", "turns")},
            }
        )
        no += 1
        opened = True
        run = _Run()

    def finish(edge: bool) -> None:
        nonlocal run
        if opened or edge:
            if run.size or not opened:
                piece()
        else:
            rows = "".join(run.rows)
            cost, audit = repair(rows)
            text = "\n".join(repaired(audit, START, rows, list(zip(run.roles, run.texts, strict=True))))
            out.append(
                {
                    "conv_id": current[0],
                    "done": True,
                    "gaps": run.gaps(),
                    **{k: getattr(run, k) for k in ("blank", "duplicate", "truncated", "illegal")},
                    "cost": cost,
                    "audit": audit,
                    "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
                }
            )
        run = _Run()

    for batch in batches:
        names = ("conv_id", "gone", "turn", "role", "text", "n", "blank", "cut", "again")
        columns = [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]
        for conv, gone, turn, role, text, n, blank, cut, again in zip(*columns, strict=True):
            if not began or conv != current[0]:
                if began:
                    finish(first_here)
                    first_here = False
                current, opened, began = (conv,), False, True
            if gone:
                continue
            copies = False
            while n:
                # Very many copies make several pieces.
                count = min(n, max(1, piece_rows - run.size))
                run.add(turn, role, text, count, blank, again, cut, copies)
                copies, n = True, n - count
                if run.size >= piece_rows or run.chars >= piece_chars:
                    piece()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if began:
        finish(True)
        yield pa.RecordBatch.from_pylist(out, schema)


# -- chains of pieces -------------------------------------------------------------------

_ROUTE = f"done boolean, part int, no bigint, entry int, edits string, head_part int, head_no bigint, {_SUMMARY}"


def _chain(pieces: list[dict], key) -> Iterator[dict]:
    """A conversation's pieces in order -> its summary, and how each piece is to be edited."""
    upto: dict[int, Best] = {START: (0, "")}
    origins, total, last, most = [], _Run(), None, None
    for p in pieces:
        step: dict[int, Best] = {}
        origin: dict[int, int] = {}
        for entry, (cost, edits) in upto.items():
            for state, (more, tail) in moves(p["rows"], entry).items():
                found = (cost + more, edits + tail)
                if state not in step or found < step[state]:
                    step[state], origin[state] = found, entry
        upto = step
        origins.append(origin)
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(total, name, getattr(total, name) + p[name])
        if last is not None and p["first"] is not None:
            total.illegal += last + p["first"] not in _LEGAL
        last = last if p["last"] is None else p["last"]
        if p["turns"]:
            total.turns += p["turns"] - (p["least"] == most)
            total.least = p["least"] if total.least is None else total.least
            total.most = most = p["most"]
    state = min((s for s in _ACCEPTED if s in upto), key=lambda s: upto[s])
    cost, audit = upto[state]
    head = {"head_part": pieces[0]["part"], "head_no": pieces[0]["no"]}
    counts = {name: getattr(total, name) for name in ("blank", "duplicate", "truncated", "illegal")}
    yield {"done": True, **key, **head, "gaps": total.gaps(), **counts, "cost": cost, "audit": audit}
    for p, origin in zip(reversed(pieces), reversed(origins), strict=True):
        entry = origin[state]
        yield {"done": False, "part": p["part"], "no": p["no"], "entry": entry, "edits": moves(p["rows"], entry)[state][1], **head}
        state = entry


def _grouped(batches: Iterable[pa.RecordBatch], same: Callable[[dict], tuple]) -> Iterator[list[dict]]:
    """Lists of consecutive rows of one key; the rows hold no texts."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and same(row) != same(held[0]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _routes(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for pieces in _grouped(batches, lambda row: (row["conv_id"],)):
        yield pa.RecordBatch.from_pylist(list(_chain(pieces, {"conv_id": pieces[0]["conv_id"]})), schema)


def _edited(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces with their edits -> the repaired text of each."""
    for batch in batches:
        for at in range(batch.num_rows):
            (p,) = batch.slice(at, 1).to_pylist()
            lines = repaired(p["edits"], p["entry"], p["rows"], list(zip(p["roles"], p["texts"], strict=True)))
            row = {k: p[k] for k in ("head_part", "head_no", "part", "no")}
            yield pa.RecordBatch.from_pylist([{**row, "lines": len(lines), "text": "\n".join(lines)}], schema)


def _hashed(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted piece texts -> one hash per conversation, one piece in memory at a time."""
    head, running, started = None, None, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"head_part": head[0], "head_no": head[1], "sha": running.hexdigest()}], schema)

    for batch in batches:
        for at in range(batch.num_rows):
            (p,) = batch.slice(at, 1).to_pylist()
            if head != (p["head_part"], p["head_no"]):
                if head:
                    yield row()
                head, running, started = (p["head_part"], p["head_no"]), hashlib.sha256(), False
            if p["lines"]:
                running.update(b"\n" if started else b"")
                running.update(p["text"].encode("utf-8", "surrogatepass"))
                started = True
    if head:
        yield row()


def _mapped(df: DataFrame, of: Callable, schema: str, *more) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: of(batches, arrow, *more), schema)


def repairs(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, n, gone).

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    conv = f"conv_id {dict(rows.dtypes)['conv_id']}"
    order = [F.asc_nulls_first("conv_id"), F.desc("gone"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    ranged = _faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    found = store(_mapped(ranged, _answers, f"{conv}, done boolean, {_SUMMARY}, {_PIECE}", piece_rows, piece_chars), "answers")
    summary = ["conv_id", *[c.split()[0] for c in _SUMMARY.split(", ")]]
    done = found.where("done").select(*summary)

    pieces = found.where("not done")
    bare = pieces.drop("roles", "texts", "done").repartition("conv_id")
    bare = bare.sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "no")
    routes = store(_mapped(bare, _routes, f"{conv}, {_ROUTE}"), "routes")
    edits = routes.where("not done").select("part", "no", "entry", "edits", "head_part", "head_no")
    held = pieces.select("part", "no", "rows", "roles", "texts").join(edits, ["part", "no"])
    texts = _mapped(held, _edited, "head_part int, head_no bigint, part int, no bigint, lines bigint, text string")
    ordered = texts.repartition("head_part", "head_no").sortWithinPartitions("head_part", "head_no", "part", "no")
    hashes = _mapped(ordered, _hashed, "head_part int, head_no bigint, sha string")
    spanning = routes.where("done").join(hashes, ["head_part", "head_no"]).withColumn("repaired_sha256", F.col("sha"))
    return done.union(spanning.select(*summary))
