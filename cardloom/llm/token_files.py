"""Token ids in files of bit planes.

A file holds the ids of a run of documents. The ids are dealt into blocks of fixed size; a block is
turned into one bit plane for each bit that its largest id needs, and every plane is compressed with
zstandard. An index at the end has each block's place, its planes' sizes, and each document's id and
number of tokens, so that any document can be read without touching other blocks.

Layout: blocks, each followed by a line end; the index as compressed JSON-free arrays; a tail of 20
bytes (magic, index size, file number) and a last line end. The line ends are what Spark's text
writer puts behind each row: it carries the bytes to any store that Spark reaches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.common import ready, text_of, written
from cardloom.llm.library_ids import LibraryIds, with_end
from cardloom.session import shared_dir

BLOCK = 1 << 16
MAGIC = b"BITPLAN1"
# Raw text that goes into one file.
FILE_BYTES = 24 << 20


def planes(ids: np.ndarray) -> list[bytes]:
    """Bit planes of a block, lowest bit first, each compressed."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    squeeze = zstandard.ZstdCompressor(level=1)
    # Rows are ids, columns their 32 bits from the lowest on.
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [squeeze.compress(np.packbits(spread[:, b], bitorder="little").tobytes()) for b in range(bits)]


def ids_of(parts: list[bytes], count: int) -> np.ndarray:
    """The block whose planes are given."""
    expand = zstandard.ZstdDecompressor()
    ids = np.zeros(count, np.uint32)
    for b, part in enumerate(parts):
        raw = expand.decompress(part, max_output_size=(count + 7) // 8)
        ids |= np.unpackbits(np.frombuffer(raw, np.uint8), count=count, bitorder="little").astype(np.uint32) << np.uint32(b)
    return ids


class FileIndex(NamedTuple):
    """What the end of a file says about it."""

    number: int
    doc_ids: np.ndarray
    has_id: np.ndarray
    tokens: np.ndarray
    block_ids: np.ndarray
    block_at: np.ndarray
    plane_sizes: list[np.ndarray]


def _arrays(*arrays: np.ndarray) -> bytes:
    packed = b"".join(struct.pack("<q", len(x)) + x.astype("<i8").tobytes() for x in arrays)
    return zstandard.ZstdCompressor().compress(packed)


class FileWriter:
    """Turns documents' ids into the rows of one file; at most one block of ids is held."""

    def __init__(self, number: int) -> None:
        self.number, self.at = number, 0
        self.rest = np.zeros(0, np.uint32)
        self.docs: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.blocks: list[tuple[int, int, list[int]]] = []

    def _block(self, ids: np.ndarray) -> bytes:
        parts = planes(ids)
        row = b"".join(parts)
        self.blocks.append((len(ids), self.at, [len(x) for x in parts]))
        self.at += len(row) + 1
        return row

    def add(self, doc_ids: np.ndarray, known: np.ndarray, tokens: np.ndarray, flat: np.ndarray) -> Iterator[bytes]:
        self.docs.append(doc_ids)
        self.known.append(known)
        self.tokens.append(tokens)
        ids = np.concatenate([self.rest, flat.astype(np.uint32)])
        whole = len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            yield self._block(ids[at : at + BLOCK])
        self.rest = ids[whole:]

    def end(self) -> Iterator[bytes]:
        if len(self.rest):
            yield self._block(self.rest)
        sizes = [np.array(x[2], np.int64) for x in self.blocks]
        none = np.zeros(0, np.int64)
        index = _arrays(
            *(np.concatenate([none, *x]) for x in (self.docs, self.known, self.tokens)),
            np.array([x[0] for x in self.blocks], np.int64),
            np.array([x[1] for x in self.blocks], np.int64),
            np.array([len(x) for x in sizes], np.int64),
            np.concatenate([none, *sizes]),
        )
        yield index + MAGIC + struct.pack("<qi", len(index), self.number)


def read_index(content: bytes) -> FileIndex:
    size, number = struct.unpack("<qi", content[-13:-1])
    if content[-21:-13] != MAGIC:
        raise ValueError("not a file of bit planes")
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(content[-21 - size : -21])
    arrays, at = [], 0
    while at < len(raw):
        (n,) = struct.unpack_from("<q", raw, at)
        arrays.append(np.frombuffer(raw, "<i8", n, at + 8))
        at += 8 + 8 * n
    docs, known, tokens, block_ids, block_at, counts, sizes = arrays
    return FileIndex(number, docs, known.astype(bool), tokens, block_ids, block_at, np.split(sizes, np.cumsum(counts)[:-1]) if len(counts) else [])


def documents_in(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a file in order, one block unpacked at a time."""
    index = read_index(content)
    blocks = zip(index.block_ids.tolist(), index.block_at.tolist(), index.plane_sizes)
    held = np.zeros(0, np.uint32)
    for doc, known, n in zip(index.doc_ids.tolist(), index.has_id.tolist(), index.tokens.tolist()):
        parts, got = [held], len(held)
        while got < n:
            count, at, sizes = next(blocks)
            bounds = np.concatenate([[0], np.cumsum(sizes)]) + at
            parts.append(ids_of([content[a:b] for a, b in zip(bounds[:-1], bounds[1:])], count))
            got += count
        if len(parts) > 1:
            held = np.concatenate(parts)
        yield (doc if known else None), held[:n]
        held = held[n:]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", words: bool = True) -> str:
    """Encode all whole texts and write their ids in ascending order of `id_col`; returns the path.

    A NULL text counts as empty and has the end id alone. NULL ids come first; rows of one id are
    ordered by their text. An empty table gives no documents. The text is shuffled
    once, by ranges of the id; it is encoded after that, inside the task that writes the file.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(max(1, -(-size // FILE_BYTES)), *order[:2]).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryIds(tokenizer, words)
        out = FileWriter(TaskContext.get().partitionId())
        any_row = False
        for batch in batches:
            any_row = True
            ids = batch.column(0)
            flat, starts = with_end(*encoder.encode(batch.column(1).to_pylist()), end_id)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            for row in out.add(ids.fill_null(0).to_numpy(), known, np.diff(starts), flat):
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["value"])
        if any_row:
            for row in out.end():
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["value"])

    # The cast keeps the bytes as they are; the writer adds a line end to each row.
    dealt.mapInArrow(encode, "value binary").select(F.col("value").cast("string")).write.text(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """file int, place int (in the file), doc_id, start_in_file, ids binary (little-endian unsigned 32-bit)."""
    ready(spark)
    files = spark.read.format("binaryFile").load(path).filter("length > 20").select("content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "place", "doc_id", "start_in_file", "ids"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for cell in batch.column(0):
                content = cell.as_py()
                number, start, held, size = read_index(content).number, 0, [], 0
                for place, (doc, ids) in enumerate(documents_in(content)):
                    held.append((number, place, doc, start, ids.astype("<u4").tobytes()))
                    start += len(ids)
                    size += len(ids)
                    if size > 1 << 20 or len(held) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)

    return files.mapInArrow(decode, "file int, place int, doc_id long, start_in_file long, ids binary")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int, **columns: str) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32 of every document.

    `start` counts the ids of all documents before it, over all files.
    """
    spark = docs.sparkSession
    path = write_token_files(docs, shared_dir(spark, "token-files"), tokenizer, end_id, **columns)
    back = read_token_files(spark, path)
    rows = back.select("file", "doc_id", "start_in_file", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    rows = written(rows, "token-digest")
    # One number for each file, as many as Spark's own list of the files.
    before, offsets = 0, []
    for number, total in sorted(map(tuple, rows.groupBy("file").agg(F.sum("n_tokens")).collect())):
        offsets.append((number, before))
        before += total
    starts = spark.createDataFrame(offsets, "file int, before long")
    return rows.join(starts, "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
