"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every substring of the normalised items, as words. A document streams
through it word by word; the automaton's state gives the longest suffix of what was
read that occurs in an item. Where that length reaches the window, the last words of the
document are a window of an item, and the state names the items.

The items are test sets: their text is bounded by ``max_bytes`` (checked, an error beyond),
so the automaton is sent to every task. Documents are never shuffled or gathered.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spanloom.llm.shared import free_name

WINDOW = 10
MAX_INDEX_BYTES = 64 << 20
MAX_COVERAGE = 0.5

# Bytes of UTF-8 that end a word become spaces, A-Z become a-z, all others stay.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and characters from U+0080 on, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Index:
    """The automaton: ``step[state]`` maps a word id to a state, ``link`` is the suffix link."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words(text)]) for item, text in items]
        for _, seq in texts:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        # Items by the state of a full window, and short items by the state of their whole text.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}
        self.short_length: dict[int, int] = {}
        for item, seq in texts:
            state = 0
            for place, word in enumerate(seq, start=1):
                state = self.step[state][word]
                if place >= window:
                    self.full.setdefault(self._shortest(state), set()).add(item)
            if 0 < len(seq) < window:
                self.short.setdefault(state, set()).add(item)
                self.short_length[state] = len(seq)
        # The nearest state on the way up the suffix links that is a short item, itself included.
        self.marked = [-1] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.short else self.marked[self.link[state]]
        lengths = [len(seq) for _, seq in texts if seq]
        self.least = min([window, *lengths])

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, at: int, word: int) -> int:
        """The state after ``word`` from ``at`` whose longest string is one word longer."""
        after = self.step[at][word]
        if self.length[after] == self.length[at] + 1:
            return after
        copy = self._new(self.length[at] + 1, dict(self.step[after]), self.link[after])
        self.link[after] = copy
        while at != -1 and self.step[at].get(word) == after:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at != -1:
            self.link[new] = self._split(at, word)
        return new

    def _shortest(self, state: int) -> int:
        """The state on the suffix path that holds the suffix of exactly one window."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word intervals [start, end) inside window occurrences, and the items hit.

        Stretches of known words shorter than any window are passed over by numpy; they
        cannot hold an occurrence.
        """
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        if len(seq) < self.least or not self.ids:
            return hits, items
        get = self.ids.get
        known = np.fromiter((get(w, -1) for w in seq), dtype=np.int64, count=len(seq))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - start >= self.least:
                self._stream(known[start:end].tolist(), start, hits, items)
        return _merged(hits), items

    def _stream(self, seq: list[int], offset: int, hits: list, items: set[str]) -> None:
        step, link, length, window = self.step, self.link, self.length, self.window
        state = matched = 0
        for place, word in enumerate(seq, start=offset + 1):
            after = step[state].get(word)
            while after is None:
                state = link[state]
                matched = length[state]
                after = step[state].get(word)
            state = after
            matched += 1
            if matched >= window:
                hits.append((place - window, place))
                items |= self.full[self._shortest(state)]
            mark = self.marked[state]
            while mark > 0:
                if self.short_length[mark] <= matched:
                    hits.append((place - self.short_length[mark], place))
                    items |= self.short[mark]
                mark = self.marked[link[mark]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def build_index(
    benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text", max_bytes: int = MAX_INDEX_BYTES
) -> Index:
    """The automaton of a test set. Rows with a null id or text are no items; repeated rows
    are one item. A set of more than ``max_bytes`` is an error: give it in parts."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).dropna().distinct()
    size = rows.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the test items hold {size} bytes, more than max_bytes={max_bytes}")
    return Index(sorted((r["i"], r["t"]) for r in rows.collect()), window)


def hits(index: Index, text: Column) -> Column:
    """struct(n_words, spans of words [start, end), items) of a text; null has no words."""

    @pandas_udf("n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            seq = words(t)
            spans, items = index.scan(seq)
            rows.append((len(seq), [{"start": a, "end": b} for a, b in spans], sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return scan(text)


def report(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n_words, spans and items for every row of ``docs``, repeated rows included."""
    return docs.select("doc_id", hits(index, F.col("text")).alias("r")).select("doc_id", "r.*")


def remove(docs: DataFrame, index: Index, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without the hit spans; rows hit in more than ``max_coverage`` of their words go.

    A span goes from its first word to its last, with the separators up to the next word.
    Texts without a hit, null texts too, come back as they are. ``n_chars`` follows the
    text if there is such a column.
    """

    @pandas_udf("keep boolean, text string")
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            seq = words(t)
            spans, _ = index.scan(seq)
            n_hit = sum(b - a for a, b in spans)
            if not spans:
                rows.append((True, t))
            elif n_hit > max_coverage * len(seq):
                rows.append((False, None))
            else:
                starts = [m.start() for m in _WORD.finditer(t)] + [len(t)]
                at, kept = 0, []
                for a, b in spans:
                    kept.append(t[at : starts[a]])
                    at = starts[b]
                kept.append(t[at:])
                rows.append((True, "".join(kept)))
        return pd.DataFrame(rows, columns=["keep", "text"])

    name = free_name("_cut", docs.columns)
    new = docs.withColumn(name, cut(F.col("text"))).where(F.col(f"{name}.keep"))
    out = []
    for column in docs.columns:
        if column == "text":
            out.append(F.col(f"{name}.text").alias("text"))
        elif column == "n_chars":
            out.append(F.char_length(f"{name}.text").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars"))
        else:
            out.append(F.col(f"`{column}`"))
    return new.select(*out)
