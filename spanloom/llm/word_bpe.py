"""Byte-level BPE by a global shuffle of distinct words.

Merges never cross the pre-tokens of the splitting pattern, so a text's ids are those of
its pre-tokens, each encoded once for the whole corpus:

1. Tasks split texts into pre-tokens. A chunk of documents becomes its distinct words, by
   frequency, and the positions of the words as numbers into that list.
2. The words of a chunk are dealt by hash into buckets. A bucket meets the words of all
   chunks, encodes every distinct word once, and sends each chunk the ids of its words.
   A word is in a chunk's list once, so no word is hot, and there are as many buckets as
   the lists need at ``BUCKET_WORDS`` entries each.
3. Each chunk joins its ids back and reassembles its documents by position. Decoding joins
   the ids of the distinct words with the token-byte table, then does the same.

Chunks are bounded in characters (one document at least), and what travels is compressed.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import store

CHUNK_CHARS = 32 << 20
BUCKET_WORDS = 250_000
_FLUSH_BYTES = 4 << 20
_LEVEL = 9
_encodings: dict[tuple, object] = {}


# -- vocabulary -------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a tiktoken rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: entry ``id`` holds the bytes of the token (empty: no such id)."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _encoding(ranks: dict[bytes, int], pattern: str):
    """One encoder per Python worker and vocabulary."""
    import tiktoken

    key = (pattern, len(ranks), zlib.crc32(b"\n".join(ranks)))
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


# -- arrays and byte strings ------------------------------------------------------------


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def squeeze_ranks(ranks: np.ndarray) -> bytes:
    """Ranks as one byte each, 255 standing for a larger one that follows in byte planes.

    Frequent words have small ranks, so most numbers are one byte that compresses well.
    """
    first = np.minimum(ranks, 255).astype(np.uint8)
    packed = zstandard.ZstdCompressor(level=_LEVEL).compress(first.tobytes())
    return len(packed).to_bytes(8, "little") + packed + squeeze(ranks[first == 255] - np.uint32(255))


def unsqueeze_ranks(data: bytes) -> np.ndarray:
    size = 8 + int.from_bytes(data[:8], "little")
    first = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:size]), dtype=np.uint8)
    ranks = first.astype(np.uint32)
    ranks[first == 255] += unsqueeze(data[size:])
    return ranks


def join_words(words: list[bytes]) -> tuple[bytes, bytes]:
    lengths = np.fromiter(map(len, words), dtype=np.uint32, count=len(words))
    return squeeze(lengths), zstandard.ZstdCompressor(level=_LEVEL).compress(b"".join(words))


def split_words(lengths: bytes, data: bytes) -> list[bytes]:
    joined = zstandard.ZstdDecompressor().decompress(data)
    stops = np.cumsum(unsqueeze(lengths), dtype=np.int64).tolist()
    return [joined[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)] if stops else []


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The pieces ``wanted`` of ``flat``, one after another."""
    sizes = lengths[wanted]
    total = int(sizes.sum())
    base = np.repeat(starts[wanted] - (np.cumsum(sizes) - sizes), sizes)
    return flat[base + np.arange(total)]


# -- steps ------------------------------------------------------------------------------

_CHUNK = "chunk string, n_words bigint, lengths binary, words binary, doc_ids binary, no_ids binary, sizes binary, places binary"


def _chunker(pattern: str, chunk_chars: int):
    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        numbers: dict[str, int] = {}
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            places = np.concatenate(parts)
            counts = np.bincount(places, minlength=len(numbers))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = list(numbers)
            lengths, joined = join_words([words[k].encode("utf-8", "surrogatepass") for k in order.tolist()])
            row = (
                uuid.uuid4().hex,
                len(words),
                lengths,
                joined,
                np.array([i or 0 for i in ids], dtype="<i8").tobytes(),
                np.array([i is None for i in ids], dtype=np.uint8).tobytes(),
                np.array([len(p) for p in parts], dtype="<i8").tobytes(),
                squeeze_ranks(rank[places] if len(places) else np.zeros(0, dtype=np.uint32)),
            )
            names = [x.split()[0] for x in _CHUNK.split(", ")]
            return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row, strict=True)})

        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc, text in zip(docs, texts, strict=True):
                found = find(text) if text else []
                ids.append(doc)
                parts.append(
                    np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), dtype=np.uint32, count=len(found))
                )
                chars += len(text or "")
                if chars >= chunk_chars:
                    yield flush()
                    numbers, ids, parts, chars = {}, [], [], 0
        if ids:
            yield flush()

    return chunks


_DEALT = "bucket bigint, chunk string, at binary, lengths binary, words binary"


def _dealer(buckets: int):
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = split_words(row["lengths"], row["words"])
                bucket = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out: dict[str, list] = {n: [] for n in ("bucket", "chunk", "at", "lengths", "words")}
                for b in np.unique(bucket).tolist():
                    at = order[edges[b] : edges[b + 1]]
                    lengths, joined = join_words([words[k] for k in at.tolist()])
                    steps = np.diff(at, prepend=0)
                    for name, value in zip(out, (b, row["chunk"], squeeze(steps), lengths, joined), strict=True):
                        out[name].append(value)
                if out["bucket"]:
                    yield pa.RecordBatch.from_pydict(out)

    return deal


_CODED = "chunk string, at binary, counts binary, ids binary"


def _coder(ranks: dict[bytes, int], pattern: str):
    def code(group: pd.DataFrame) -> pd.DataFrame:
        """All lists of one bucket: every distinct word is encoded once."""
        encode = _encoding(ranks, pattern).encode_ordinary
        known: dict[bytes, np.ndarray] = {}
        rows = []
        for chunk, at, lengths, joined in zip(
            group["chunk"], group["at"], group["lengths"], group["words"], strict=True
        ):
            found = []
            for word in split_words(lengths, joined):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = np.array(encode(word.decode("utf-8", "surrogatepass")), dtype=np.uint32)
                found.append(ids)
            counts = np.fromiter(map(len, found), dtype=np.uint32, count=len(found))
            rows.append((chunk, at, squeeze(counts), squeeze(np.concatenate(found))))
        return pd.DataFrame(rows, columns=["chunk", "at", "counts", "ids"])

    return code


def _assembler(table: list[bytes]):
    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(row, table)

    return assemble


def _documents(row: dict, table: list[bytes]) -> Iterator[pa.RecordBatch]:
    n_words = row["n_words"]
    counts = np.zeros(n_words, dtype=np.int64)
    pieces = []
    for part in row["coded"] or []:
        at = np.cumsum(unsqueeze(part["at"]), dtype=np.int64)
        sizes = unsqueeze(part["counts"]).astype(np.int64)
        counts[at] = sizes
        pieces.append((at, sizes, unsqueeze(part["ids"])))
    starts = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()), dtype=np.uint32)
    for at, sizes, ids in pieces:
        flat[np.repeat(starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
    tokens = flat.tolist()
    decoded = [b"".join([table[t] for t in tokens[a : a + n]]) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]

    doc_ids = np.frombuffer(row["doc_ids"], dtype="<i8")
    no_ids = np.frombuffer(row["no_ids"], dtype=np.uint8)
    sizes = np.frombuffer(row["sizes"], dtype="<i8")
    places = unsqueeze_ranks(row["places"])
    out: dict[str, list] = {"doc_id": [], "ids": [], "decoded": []}
    at = waiting = 0
    for k, size in enumerate(sizes.tolist()):
        part = places[at : at + size]
        at += size
        out["doc_id"].append(None if no_ids[k] else int(doc_ids[k]))
        out["ids"].append(gather(flat, starts, counts, part).astype("<u4").tobytes())
        out["decoded"].append(b"".join([decoded[p] for p in part.tolist()]))
        waiting += len(out["ids"][-1]) + len(out["decoded"][-1])
        if waiting >= _FLUSH_BYTES:
            yield _rows(out)
            out, waiting = {"doc_id": [], "ids": [], "decoded": []}, 0
    if out["doc_id"]:
        yield _rows(out)


def _rows(out: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(v, type=t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out)
    )


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    chunk_chars: int = CHUNK_CHARS,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers as binary) and decoded (binary).

    One row per row of ``docs``, repeated rows included; null texts are empty texts, null
    ids stay null. An empty table gives no row. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = store(texts.mapInArrow(_chunker(pattern, chunk_chars), _CHUNK), "chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    dealt = chunks.select("chunk", "lengths", "words").mapInArrow(_dealer(max(1, -(-total // bucket_words))), _DEALT)
    coded = dealt.groupBy("bucket").applyInPandas(_coder(ranks, pattern), _CODED)
    lists = coded.groupBy("chunk").agg(F.collect_list(F.struct("at", "counts", "ids")).alias("coded"))
    both = chunks.drop("lengths", "words").join(lists, "chunk", "left")
    return both.mapInArrow(_assembler(token_bytes(ranks)), "doc_id bigint, ids binary, decoded binary")


def decode(ids: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The reverse for any table (doc_id, ids): doc_id and decoded, row by row.

    Unknown ids decode to nothing; null ids decode to null.
    """
    table = token_bytes(ranks)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if b is None else b"".join([table[t] for t in np.frombuffer(b, "<u4").tolist() if t < len(table)])
                for b in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return ids.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(read, "doc_id bigint, decoded binary")
