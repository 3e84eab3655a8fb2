"""Main text of web pages: page structure, and a suffix array over the pages of a host.

A page becomes blocks of visible text. Those in an article or main element are its main
text; scripts, forms and parts marked as navigation, adverts, notices or comments are
not; other blocks are open. Then the host decides: the token streams of its pages, marked
parts too, are concatenated and sorted by suffix, up to the length of a long repeat.

* A stretch of ``long`` tokens on a ``share`` of the host's different pages, two at least, is
  boilerplate. It goes from open blocks, which count where a page marks no main text.
* A main block goes as a whole if such stretches cover it that stand on ``main_share`` of the
  different pages, four at least. A line that some articles share stays, and so does an
  article of nothing but such blocks.

Pages of equal blocks are one page in these counts, however many copies there are.

Pages meet by host. A host with more rows than ``shard_pages`` is dealt into shards by the
hash of its blocks, so no host is one task's load, and the shards give the same result as
one stream would: a stretch on a share of all pages is on that share of some shard's pages.
So each shard proposes what is frequent in it, all shards count all proposals of the host,
and the sums decide. The table of such hosts is broadcast: by construction it has fewer
than ``MAX_HOSTS`` rows.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_PAGES = 256
MAX_HOSTS = 1_000_000
LONG = 8  # tokens of a long repeat
SHARE = 0.2  # of a host's different pages, from which a repeat is boilerplate
MAIN_SHARE = 0.5
MAIN_LEAST = 4
SEEN = 100_000  # pages whose copies a task leaves out before the shuffle
LEVEL = 5  # of compression of what is shuffled

# -- parsing ----------------------------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|select|textarea|title)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label|hidden)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?", re.IGNORECASE)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody tfoot thead tr ul".split()
)
_DROPPED = frozenset("nav aside footer form button dialog menu head fieldset".split())
_HOLDERS = frozenset("div section article ul ol dl table p span header aside figure center main".split())

#: Names (whole words of class, id, role or label) of parts that are not main text.
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|footer|sidebar|aside|complementary|"
    r"contentinfo|banner|ads?|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|cookies?|"
    r"consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|"
    r"social|related|recommended|recommendations|comments?|commentlist|discussion|replies|reply|disqus|search|widget|"
    r"toolbar|pagination|pager|copyright|legal|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|discussion|replies|reply|disqus)(?:$|[\s_-])", re.IGNORECASE)
_MAIN = re.compile(r"(?:^|\s)(?:main|articlebody|(?:article|post|entry|story)[_-](?:body|content|text))(?:$|\s)", re.IGNORECASE)


def blocks(page: str | None) -> tuple[list[str], list[str], list[str]]:
    """(main, open, marked): the texts of a page's blocks in page order.

    Main blocks lie in an article or main element, marked ones in parts that are not main
    text; open ones in neither. Character references are decoded, white space within a block
    is one space, empty blocks are left out.
    """
    out: dict[str, list[str]] = {"main": [], "open": [], "marked": []}
    if not page:
        return out["main"], out["open"], out["marked"]
    piece: list[str] = []
    skip_tag, skip_depth, skip_comments = "", 0, False
    main_tags: list[list] = []  # open elements that hold main text: [tag, depth of equal tags]

    def flush() -> None:
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                out["marked" if skip_depth else "main" if main_tags else "open"].append(text)
            piece.clear()

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            piece.append(html.unescape(page[at : token.start()]))
        at = token.end()
        tag = token["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br" or tag in ("td", "th"):
            piece.append(" ")
        closing = token["close"] == "/"
        if tag in _BLOCK or tag in ("article", "main"):
            flush()
        if closing:
            if skip_depth:
                if tag == skip_tag:
                    skip_depth -= 1
                elif tag in ("body", "html"):
                    skip_depth = 0
                continue
            for k in range(len(main_tags) - 1, -1, -1):
                if main_tags[k][0] == tag:
                    main_tags[k][1] -= 1
                    if main_tags[k][1] == 0:
                        flush()
                        del main_tags[k:]
                    break
            continue
        if tag in _VOID or token["attrs"].endswith("/"):
            continue
        named = _names(token["attrs"]) if tag in _HOLDERS else ""
        if skip_depth:
            if tag == skip_tag:
                skip_depth += 1
                continue
            # An unclosed part ends where the article starts; comments may hold articles.
            if tag not in ("article", "main") or skip_comments or _MARKED.search(named):
                continue
            skip_depth = 0
        outside_header = tag == "header" and not main_tags
        if tag in _DROPPED or outside_header or (named and not _MAIN.search(named) and _MARKED.search(named)):
            flush()
            skip_tag, skip_depth, skip_comments = tag, 1, bool(_COMMENTS.search(named))
            continue
        if main_tags and tag == main_tags[-1][0]:
            main_tags[-1][1] += 1
        elif tag in ("article", "main") or (named and _MAIN.search(named)):
            flush()
            main_tags.append([tag, 1])
    if at < len(page):
        piece.append(html.unescape(page[at:]))
    flush()
    return out["main"], out["open"], out["marked"]


def _names(attributes: str) -> str:
    if "=" not in attributes and "hidden" not in attributes.lower():
        return ""
    found = []
    for name, value in _ATTRIBUTE.findall(attributes):
        found.append("popup" if name.lower() == "hidden" else value.strip("\"'"))
    return " ".join(found)


# -- suffix array of a host -------------------------------------------------------------


def ranked(streams: list[list[str]], long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, owner, start): for each token of the concatenated streams the rank of its suffix
    by the first ``long`` tokens, and its stream; for each stream its first place.

    Prefix doubling sorts by the first 1, 2, 4, ... tokens; suffixes of equal rank then share
    ``long``. Each stream ends in a separator of its own, so no shared stretch crosses one.
    """
    numbers: dict[str, int] = {}
    parts = [[numbers.setdefault(t, len(numbers)) for t in stream] for stream in streams]
    lengths = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    flat: list[int] = []
    for k, part in enumerate(parts):
        flat += part
        flat.append(len(numbers) + k)
    rank = np.array(flat, dtype=np.int64)
    size, n = 1, len(rank)
    while size < long:
        step = min(size, long - size)
        after = np.full(n, -1, dtype=np.int64)
        after[: max(n - step, 0)] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.ones(n, dtype=np.int64)
        new[1:] = (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        size += step
    return rank, np.repeat(np.arange(len(parts)), lengths), np.cumsum(lengths) - lengths


def owners_of(rank: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per rank the number of different streams that hold it."""
    if not len(rank):
        return np.zeros(0, dtype=np.int64)
    count = int(owner.max()) + 1
    return np.bincount(np.unique(rank * count + owner) // count, minlength=int(rank.max()) + 1)


def stretches(starts: np.ndarray, long: int) -> np.ndarray:
    """Which places lie within ``long`` places from a start."""
    edges = np.zeros(len(starts) + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, np.minimum(at + long, len(starts)), -1)
    return np.cumsum(edges[:-1]) > 0


def covered(streams: list[list[str]], long: int = LONG, least: int = 2) -> list[np.ndarray]:
    """Per stream, which tokens lie in a stretch of ``long`` or more tokens that occurs in
    ``least`` streams or more."""
    rank, owner, start = ranked(streams, long)
    hit = stretches(owners_of(rank, owner)[rank] >= least, long) if len(rank) else np.zeros(0, dtype=bool)
    return [hit[at : at + len(s)] for s, at in zip(streams, start.tolist(), strict=True)]


def needed(pages: int, share: float = SHARE, main_share: float = MAIN_SHARE) -> tuple[int, int]:
    """How many of a host's different pages make a stretch boilerplate in open and in main blocks."""
    return max(2, int(np.ceil(share * pages))), max(MAIN_LEAST, int(np.ceil(main_share * pages)))


Page = tuple[list[str], list[str], list[str]]


def _stream(page: Page) -> list[str]:
    return [t for part in page for block in part for t in block.split(" ")]


def _kept(page: Page, in_open: list[bool], in_main: list[bool]) -> str:
    """The text of a page, given for each of its tokens whether it is boilerplate."""
    main, opened, _ = page
    kept, at = [], 0
    for block in main:
        size = block.count(" ") + 1
        if not all(in_main[at : at + size]):
            kept.append(block)
        at += size
    if main and not kept:
        kept = list(main)
    if not main:
        for block in opened:
            tokens = block.split(" ")
            run = [t for t, gone in zip(tokens, in_open[at : at + len(tokens)], strict=True) if not gone]
            at += len(tokens)
            if run:
                kept.append(" ".join(run))
    return "\n\n".join(kept)


def _texts_of(pages: list[Page], rank: np.ndarray, start: np.ndarray, for_open: np.ndarray, for_main: np.ndarray, long: int) -> list[str]:
    """Texts of pages, given which ranks are boilerplate in open and in main blocks."""
    if not pages:
        return []
    hits = [stretches(flags[rank], long).tolist() for flags in (for_open, for_main)]
    stops = np.append(start[1:], len(rank)).tolist()
    return [
        _kept(page, hits[0][a : b - 1], hits[1][a : b - 1])
        for page, a, b in zip(pages, start.tolist(), stops, strict=False)
    ]


def host_texts(pages: list[Page], long: int = LONG, share: float = SHARE, main_share: float = MAIN_SHARE) -> list[str]:
    """Main texts of the different pages of one host, blocks joined by two line feeds."""
    rank, owner, start = ranked([_stream(p) for p in pages], long)
    count = owners_of(rank, owner)
    least, main_least = needed(len(pages), share, main_share)
    return _texts_of(pages, rank, start, count >= least, count >= main_least, long)


def proposals(pages: list[Page], long: int = LONG, share: float = SHARE) -> list[str]:
    """Stretches of ``long`` tokens that are on a ``share`` of a shard's different pages; all
    stretches where that share is less than two pages."""
    streams = [_stream(p) for p in pages]
    rank, owner, start = ranked(streams, long)
    count = owners_of(rank, owner)
    frequent = count >= share * len(pages) if share * len(pages) >= 2 else count >= 1
    places = np.flatnonzero(frequent[rank])
    _, first = np.unique(rank[places], return_index=True)
    out = []
    for place in places[first].tolist():
        stream = streams[owner[place]]
        at = place - int(start[owner[place]])
        if at + long <= len(stream):
            out.append(" ".join(stream[at : at + long]))
    return out


def counted(pages: list[Page], grams: list[str], long: int = LONG) -> list[int]:
    """On how many of the pages each of the different stretches is."""
    rank, owner, start = ranked([_stream(p) for p in pages] + [g.split(" ") for g in grams], long)
    count = owners_of(rank, owner)
    return (count[rank[start[len(pages) :]]] - 1).tolist()


def shard_texts(pages: list[Page], grams: list[str], for_main: list[bool], long: int = LONG) -> list[str]:
    """Texts of the pages, given the host's boilerplate and which of it counts in main blocks."""
    rank, _, start = ranked([_stream(p) for p in pages] + [g.split(" ") for g in grams], long)
    heads = rank[start[len(pages) :]]
    flags = np.zeros((2, int(rank.max()) + 1 if len(rank) else 0), dtype=bool)
    flags[0, heads] = True
    flags[1, heads[np.array(for_main, dtype=bool)]] = True
    return _texts_of(pages, rank, start, flags[0], flags[1], long)


# -- tables -----------------------------------------------------------------------------

_ROW = "page_id bigint, url string, host string, digest binary"
_DISTINCT = "host string, shards int, digest binary, packed binary"
_TEXTS = "host string, digest binary, text binary"


def _content(page: str | None) -> bytes:
    return json.dumps(blocks(page), ensure_ascii=False).encode("utf-8", "surrogatepass")


def _identify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [xxhash.xxh3_128_digest(_content(p)) for p in batch.column("html").to_pylist()]
        columns = [batch.column(n) for n in ("page_id", "url", "host")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary())], ["page_id", "url", "host", "digest"])


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages' blocks, without most copies of pages that the task has met."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    seen: set[tuple[str, bytes]] = set()
    for batch in batches:
        rows: list[tuple] = []
        columns = (batch.column(n).to_pylist() for n in ("host", "shards", "html"))
        for host, shards, page in zip(*columns, strict=True):
            content = _content(page)
            digest = xxhash.xxh3_128_digest(content)
            if (host, digest) in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add((host, digest))
            rows.append((host, shards, digest, pack(content)))
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
        arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "shards", "digest", "packed"])


def _pages(table: pa.Table) -> list[Page]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [json.loads(unpack(p)) for p in table.column("packed").to_pylist()]


def _text_table(table: pa.Table, texts: list[str]) -> pa.Table:
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    packed = pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
    return pa.table({"host": table.column("host"), "digest": table.column("digest"), "text": packed})


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts = pa.array([unpack(t).decode("utf-8", "replace") for t in batch.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])


def main_texts(
    pages: DataFrame,
    long: int = LONG,
    shard_pages: int = SHARD_PAGES,
    share: float = SHARE,
    main_share: float = MAIN_SHARE,
) -> DataFrame:
    """page_id, url and text (empty if none) for every row of ``pages``.

    Null html is empty; pages without a url, or with one that names no host, count as pages
    of one host; repeated rows appear again and get equal texts. ``shard_pages`` has no
    influence on results.
    """
    host = F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host.alias("host"), "html")
    least = max(shard_pages, pages.count() // MAX_HOSTS)
    large = rows.groupBy("host").count().where(F.col("count") > least)
    shards = F.broadcast(large.select("host", F.ceil(F.col("count") / least).cast("int").alias("shards")))

    def distinct(found: DataFrame) -> DataFrame:
        one = found.select("host", "shards", "html").mapInArrow(_parse, _DISTINCT)
        dealt = one.withColumn("shard", F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int"))
        return dealt.repartition("host", "shard").dropDuplicates(["host", "shard", "digest"])

    small = distinct(rows.join(shards, "host", "left_anti").withColumn("shards", F.lit(1)))
    whole = small.groupby("host", "shard").applyInArrow(
        lambda t: _text_table(t, host_texts(_pages(t), long, share, main_share)), _TEXTS
    )
    dealt = distinct(rows.join(shards, "host"))
    texts = whole.union(_sharded(dealt, shards, long, share, main_share))
    ids = rows.select("page_id", "url", "host", "html").mapInArrow(_identify, _ROW)
    joined = ids.join(texts, ["host", "digest"]).select("page_id", "url", "text")
    return joined.mapInArrow(_unpack, "page_id bigint, url string, text string")


def _sharded(dealt: DataFrame, shards: DataFrame, long: int, share: float, main_share: float) -> DataFrame:
    """host, digest and text of the pages of hosts that are dealt into shards."""

    def propose(table: pa.Table) -> pa.Table:
        grams = proposals(_pages(table), long, share)
        names = pa.array([table.column("host")[0].as_py()] * len(grams), pa.string())
        return pa.table({"host": names, "gram": pa.array(grams, pa.string())})

    def count(table: pa.Table, asked: pa.Table) -> pa.Table:
        grams = asked.column("gram").to_pylist() if table.num_rows else []
        found = counted(_pages(table), grams, long) if grams else []
        rows = [(g, n) for g, n in zip(grams, found, strict=True) if n]
        if table.num_rows:
            rows.append((None, table.num_rows))  # all pages of the shard
        names = pa.array([table.column("host")[0].as_py()] * len(rows) if rows else [], pa.string())
        columns = pa.array([g for g, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())
        return pa.table({"host": names, "gram": columns[0], "n": columns[1]})

    def apply(table: pa.Table, known: pa.Table) -> pa.Table:
        grams, for_main = known.column("gram").to_pylist(), known.column("for_main").to_pylist()
        return _text_table(table, shard_texts(_pages(table), grams, for_main, long) if table.num_rows else [])

    def everywhere(found: DataFrame) -> DataFrame:
        spread = found.join(shards, "host").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        return spread.drop("shards")

    def beside(found: DataFrame):
        return dealt.groupby("host", "shard").cogroup(everywhere(found).groupby("host", "shard"))

    grams = dealt.groupby("host", "shard").applyInArrow(propose, "host string, gram string").distinct()
    sums = beside(grams).applyInArrow(count, "host string, gram string, n bigint").groupBy("host", "gram").agg(F.sum("n").alias("n"))
    pages = F.max(F.when(F.col("gram").isNull(), F.col("n"))).over(Window.partitionBy("host"))
    least, main_least = F.ceil(F.lit(share) * F.col("pages")), F.ceil(F.lit(main_share) * F.col("pages"))
    known = (
        sums.withColumn("pages", pages)
        .where(F.col("gram").isNotNull() & (F.col("n") >= F.greatest(F.lit(2), least)))
        .select("host", "gram", (F.col("n") >= F.greatest(F.lit(MAIN_LEAST), main_least)).alias("for_main"))
    )
    return beside(known).applyInArrow(apply, _TEXTS)
