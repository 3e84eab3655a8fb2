"""Token ids of documents in packed files: fixed-width bits, block offsets, a document index.

A file holds the ids of some documents in order. Every id takes the fewest bits that hold
the vocabulary. Ids are packed in blocks of ``BLOCK`` ids, each starting at a byte, whose
offsets are listed, so any range of ids is read by a few seeks and unpacked by numpy.

    magic | block, block, ... | doc ids, null flags, starts, block offsets | trailer

Writing: documents are range-partitioned and sorted by id, each task streams one partition
into a file of its own name, and only files named in the manifest count, so a repeated task
does no harm. The manifest has a row per file; it alone reaches the driver.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import shared_folder, store

MAGIC = b"spanids1"
BLOCK = 8192
_TRAILER = np.dtype([("bits", "<u4"), ("block", "<u4"), ("n_ids", "<u8"), ("n_docs", "<u8"), ("index", "<u8")])


# -- bits -------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit order: id ``k`` takes bits ``k * bits`` to ``(k + 1) * bits - 1``."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little")
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = flat.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


# -- files ------------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Local paths, ``file:`` and every scheme pyarrow knows (hdfs, s3, gs, abfs)."""
    local = re.match(r"^(?:file:/*(?=/))?(/.*)$", path)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


class Writer:
    """Appends documents to one file; holds a block of ids and the index in memory."""

    def __init__(self, path: str, vocabulary: int):
        system, place = _filesystem(path)
        system.create_dir(os.path.dirname(place), recursive=True)
        self.out = system.open_output_stream(place)
        self.out.write(MAGIC)
        self.bits, self.at, self.n_ids = bits_for(vocabulary), len(MAGIC), 0
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.offsets: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            self._flush(self.n_waiting // BLOCK * BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, dtype=np.uint32)
        for at in range(0, count, BLOCK):
            data = pack(ids[at : min(at + BLOCK, count)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.n_waiting = [ids[count:]], len(ids) - count

    def close(self) -> None:
        self._flush(self.n_waiting)
        self.out.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], dtype=np.uint8).tobytes())
        self.out.write(np.array(self.starts, dtype="<u8").tobytes())
        self.out.write(np.array(self.offsets, dtype="<u8").tobytes())
        trailer = np.zeros(1, dtype=_TRAILER)
        trailer[0] = (self.bits, BLOCK, self.n_ids, len(self.docs), self.at)
        self.out.write(trailer.tobytes() + MAGIC)
        self.out.close()


class Reader:
    """Random access to one file: ``ids(start, stop)`` reads and unpacks only the blocks it needs."""

    def __init__(self, path: str):
        system, place = _filesystem(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        end = self.file.read_at(_TRAILER.itemsize + len(MAGIC), size - _TRAILER.itemsize - len(MAGIC))
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is no packed id file")
        head = np.frombuffer(end[: _TRAILER.itemsize], dtype=_TRAILER)[0]
        self.bits, self.block, self.n_ids, self.n_docs, index = (int(head[n]) for n in _TRAILER.names)
        data = self.file.read_at(size - index - len(end), index)
        cut = lambda at, kind, count: np.frombuffer(data, dtype=kind, count=count, offset=at)
        self.doc_ids = cut(0, "<i8", self.n_docs)
        self.null_ids = cut(8 * self.n_docs, np.uint8, self.n_docs).astype(bool)
        self.starts = np.append(cut(9 * self.n_docs, "<u8", self.n_docs).astype(np.int64), self.n_ids)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.append(cut(17 * self.n_docs, "<u8", blocks).astype(np.int64), index)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        at = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last + 1]) - at, at)
        parts = []
        for k in range(first, last + 1):
            count = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(data[int(self.offsets[k]) - at : int(self.offsets[k + 1]) - at], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.starts[number]), int(self.starts[number + 1]))

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, read some ``ids_at_once`` at a time."""
        number = 0
        while number < self.n_docs:
            stop = int(np.searchsorted(self.starts, self.starts[number] + ids_at_once, side="right")) - 1
            stop = min(max(stop, number + 1), self.n_docs)
            base = int(self.starts[number])
            part = self.ids(base, int(self.starts[stop]))
            for k in range(number, stop):
                doc = None if self.null_ids[k] else int(self.doc_ids[k])
                yield doc, part[int(self.starts[k]) - base : int(self.starts[k + 1]) - base]
            number = stop

    def close(self) -> None:
        self.file.close()


# -- tokenizer --------------------------------------------------------------------------

_TAIL = re.compile(rb"^(.*[a-z])([!-&(-/:-@\[-`{-~]+)$", re.DOTALL)
_MEMO_WORDS = 1_000_000
_encoders: dict[tuple, WordEncoder] = {}


class WordEncoder:
    """The ids of a tokenizers file that lower-cases, drops white space and never joins
    characters across it: a text's ids are those of its words, which are remembered.

    Between an ASCII letter and ASCII marks other than an apostrophe its splitter always
    cuts, so such a word is remembered as its letters and its marks.

    With ``special`` the added tokens of the file get their ids where a text holds them, as
    written, like in the library; without, they are ordinary text.
    """

    def __init__(self, path: str, memo_words: int = _MEMO_WORDS, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # what goes to the library is ordinary text
        added = self.tokenizer.get_added_tokens_decoder() if special else {}
        self.added = {t.content.encode(): np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that are not matched as written")
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if added else None
        self.memo_words = memo_words
        self.memo: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Tokens that end a word, so that one call may encode many plain words.
        self.ends = np.zeros(size, dtype=bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[number] = token.endswith("</w>")

    def _learn(self, words: set[bytes]) -> None:
        parts: set[bytes] = set()
        joined: dict[bytes, tuple[bytes, bytes]] = {}
        for word in words:
            if found := _TAIL.match(word):
                joined[word] = found.groups()
                parts.update(found.groups())
            else:
                parts.add(word)
        new = [(w, w.decode("utf-8", "replace")) for w in parts if w not in self.memo]
        plain = [x for x in new if x[1].isascii() and x[1].isalpha()]
        if plain:
            text = " ".join(t for _, t in plain)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(plain):
                raise ValueError("the tokenizer does not mark the end of every word")
            data, at = ids.tobytes(), 0
            for (word, _), stop in zip(plain, stops.tolist(), strict=True):
                self.memo[word] = data[4 * at : 4 * stop]
                at = stop
        other = [x for x in new if not (x[1].isascii() and x[1].isalpha())]
        if other:
            found = self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)
            for (word, _), encoding in zip(other, found, strict=True):
                self.memo[word] = np.array(encoding.ids, dtype="<u4").tobytes()
        for word, (head, tail) in joined.items():
            self.memo[word] = self.memo[head] + self.memo[tail]

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """UTF-8 texts to uint32 ids; null is empty. White space is that of bytes.split()."""
        for text in texts:
            if text and self.cut and self.cut.search(text):
                # Every second part is an added token.
                parts = self.cut.split(text)
                parts[::2] = [p.tobytes() for p in self.encode(parts[::2])]
                parts[1::2] = [self.added[p] for p in parts[1::2]]
                yield np.frombuffer(b"".join(parts), dtype="<u4")
                continue
            words = text.lower().split() if text else []
            missing = {w for w in words if w not in self.memo}
            if missing:
                if len(self.memo) + len(missing) > self.memo_words:
                    self.memo.clear()
                    missing = set(words)
                self._learn(missing)
            yield np.frombuffer(b"".join(map(self.memo.__getitem__, words)), dtype="<u4")


def word_encoder(path: str) -> WordEncoder:
    """One per Python worker, kept between its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path,) not in _encoders:
        _encoders[(path,)] = WordEncoder(path, special=True)
    return _encoders[(path,)]


# -- tables -----------------------------------------------------------------------------


@dataclass(frozen=True)
class PackedIds:
    """A written corpus: its files in document order with the number of ids before each."""

    folder: str
    files: list[tuple[str, int]]


def write(
    docs: DataFrame,
    encoder: Callable[[], object],
    vocabulary: int,
    end_id: int | None = None,
    folder: str | None = None,
) -> PackedIds:
    """Encode ``text`` of every row and write the ids in ascending doc_id order.

    ``encoder()`` gives, in the task, an object with ``encode(texts)``. Null texts are
    empty, null ids come first, rows of one id follow a hash of their text; equal rows
    are written each. An empty table gives no file. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]

    def put(batches):
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
        writer, encode = None, None
        end = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        for batch in batches:
            if writer is None:
                writer, encode = Writer(name, vocabulary), encoder().encode
            ids = batch.column("doc_id").to_pylist()
            for doc, found in zip(ids, encode(batch.column("text").to_pylist()), strict=True):
                writer.add(doc, np.concatenate((found, end)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [TaskContext.get().partitionId()], "file": [name], "n_ids": [writer.n_ids]}
            )

    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    manifest = store(ordered.mapInArrow(put, "part bigint, file string, n_ids bigint"), "ids-manifest")
    files, base = [], 0
    for row in manifest.orderBy("part").collect():
        files.append((row["file"], base))
        base += row["n_ids"]
    return PackedIds(folder, files)


def read(spark: SparkSession, packed: PackedIds) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers. One task per file.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not packed.files:
        return spark.createDataFrame([], schema)

    def get(batches):
        for batch in batches:
            for path, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader = Reader(path)
                rows, at = [], base
                for doc, ids in reader.documents():
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                reader.close()
                if rows:
                    yield _batch(rows)

    files = spark.createDataFrame(packed.files, "file string, base bigint")
    return files.repartition(len(packed.files), "file").mapInArrow(get, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=names)
