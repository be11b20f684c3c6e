"""Token ids of whole corpora in Huffman-coded files, written in ascending document order.

The files of a corpus are three Parquet folders: `codebook` (id, bits), the lengths of a canonical code made from the
global counts of the ids; `parts` (part, base), how many ids lie before each part; and `blocks`, whose files
are the parts in ascending order, one row for each run of whole documents:

    part, seq     the part, and the rank of the block's first document within it
    before        ids of the part's documents before the block
    doc_id        array of the documents, ascending
    n_tokens      array of their numbers of ids
    payload       the codes of all ids, one after another
    spans         the bits that each 64 ids take, from which bit offsets are summed
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, new_path, small_batches, text_key
from .huffman import Coder, code_lengths
from .tokens import encoder

# Ids as the plane of their low bytes and that of the rest, which compress well apart.
TOKENS = "doc_id long, text_key long, n_tokens int, low binary, high binary"
BLOCK = "part int, seq long, before long, doc_id array<long>, n_tokens array<int>, payload binary, spans binary"
MAX_BITS = 16
BLOCK_IDS = 1 << 18
# Bytes of ids in a part, as long as that makes no more than MAX_PARTS parts; beyond that parts grow with the corpus.
PART_BYTES, MAX_PARTS = 8 << 20, 8192


def part_count(n_bytes: int, part_bytes: int = PART_BYTES, most: int = MAX_PARTS) -> int:
    return max(1, min(most, -(-n_bytes // part_bytes)))


def planes(ids: bytes, dtype: np.dtype) -> tuple[bytes, bytes]:
    parts = np.frombuffer(ids, np.uint8).reshape(-1, dtype.itemsize)
    return parts[:, 0].tobytes(), parts[:, 1:].tobytes()


def from_planes(low: bytes, high: bytes, dtype: np.dtype) -> np.ndarray:
    parts = np.empty((len(low), dtype.itemsize), np.uint8)
    parts[:, 0] = np.frombuffer(low, np.uint8)
    parts[:, 1:] = np.frombuffer(high, np.uint8).reshape(len(low), -1)
    return parts.reshape(-1).view(dtype)


def tokenize(docs: DataFrame, path: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Ids by document, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in enc.ids([t or "" for t in batch.column(2).to_pylist()])]
            n = [len(x) // enc.dtype.itemsize for x in ids]
            low, high = zip(*(planes(x, enc.dtype) for x in ids)) if ids else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], ["doc_id", "text_key", "n_tokens", "low", "high"])

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text), F.col(text).alias("text")).mapInArrow(run, TOKENS)


def counts(tokens: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids that occur, and how often. One row an id of each task, summed by Spark; the vocabulary bounds what is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, dtype = np.zeros(1 << 16, np.int64), encoder(path).dtype
        for batch in batches:
            for k in range(0, len(batch), 64):
                got = np.bincount(np.concatenate([from_planes(*row, dtype) for row in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns))]))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = tokens.select("low", "high").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    return np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> None:
    """Write the ids of all docs to `path`.

    Texts are tokenized where they are read; their ids are then sorted by ranges of (doc_id, hash of the text, row), as many as
    `part_bytes` of ids ask for (at most MAX_PARTS, whose sorts then spill), so that no id, however often it occurs, makes a part of its own. Null text counts as empty, null
    doc_id comes first; rows that repeat a doc_id stay next to one another. A document of any length is in one block. An
    empty table gives an empty corpus. Other columns of docs, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer, end_id, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "ids", "zstd")
    symbols, n = counts(tokens, tokenizer)
    bits = code_lengths(n, max(MAX_BITS, int(len(n)).bit_length()))
    spark.createDataFrame(list(zip(symbols.tolist(), bits.tolist())), "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    parts = part_count(int(n.sum()) * encoder(tokenizer).dtype.itemsize, part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, dtype, part = Coder(symbols, bits), encoder(tokenizer).dtype, TaskContext.get().partitionId()
        held: list[tuple] = []
        size = before = seq = 0

        def block() -> pa.RecordBatch:
            payload, spans = coder.encode(np.concatenate([from_planes(r[2], r[3], dtype) for r in held]))
            row = [[part], [seq], [before], [[r[0] for r in held]], [[r[1] for r in held]], [payload], [spans]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()])], ["part", "seq", "before", "doc_id", "n_tokens", "payload", "spans"])

        for batch in batches:
            for k in range(0, len(batch), 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    held.append(row)
                    size += row[1]
                    if size >= BLOCK_IDS:
                        yield block()
                        before, seq = before + size, seq + len(held)
                        held, size = [], 0
        if held:
            yield block()

    order = ["doc_id", "text_key", "row"]
    tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "low", "high").mapInArrow(run, BLOCK).write.parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCK).parquet(f"{path}/blocks").select("part", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row a part
    bases = np.cumsum([0, *(r.n for r in sizes)])[:-1].tolist()
    spark.createDataFrame([(r.part, b) for r, b in zip(sizes, bases)], "part int, base long").coalesce(1).write.parquet(f"{path}/parts")
    discard(tokens)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document's doc_id, start and ids (little-endian 32-bit bytes), decoded block by block."""
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").collect()  # as many rows as the vocabulary at most
    base = {r.part: r.base for r in spark.read.schema("part int, base long").parquet(f"{path}/parts").collect()}  # one row a part
    symbols, bits = np.array([r.id for r in book], np.int64), np.array([r.bits for r in book], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(symbols, bits)
        for batch in batches:
            for k in range(len(batch)):
                part, before, doc_id, n, payload, spans = (c[k].as_py() for c in batch.columns)
                ends = np.cumsum(n, dtype=np.int64)
                ids = coder.decode(payload, spans, int(ends[-1])).astype("<u4").tobytes()
                cut = (ends - n) * 4
                yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(base[part] + before + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array([ids[a : a + 4 * m] for a, m in zip(cut.tolist(), n)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").select("part", "before", "doc_id", "n_tokens", "payload", "spans").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs to files in the shared folder and return what read() gives, with the CRC-32 of each document's ids."""
    path = new_path(docs.sparkSession, "corpus")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
