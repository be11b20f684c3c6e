"""Benchmark passages in documents, by winnowing.

Both sides are words (digits, ASCII letters in lower case, all characters beyond ASCII). Of the hashes of
K consecutive words, each window of SPAN - K + 1 hashes keeps its least, the last of equals. Two texts that
share SPAN words share the kept hash of that window, so a join of kept hashes finds every shared span; each
hit is then extended to the spans of SPAN words around it, which are joined with the items' own windows by their words.
Items of fewer than SPAN words are one window of their length; its hash is joined with those of all runs of that length.

One pass reads the documents. Its tasks look each fingerprint up in a bit map of the benchmark's before they pass it on
with the words around it, so that little but hits is shuffled; the map has a fixed largest size, and where the benchmark
outgrows it more fingerprints are passed on, to the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, discard, materialize, small, small_batches, text_key, without
from .words import run_hashes, word_hashes

SPAN, K = 10, 5
# The bit map has 32 bits for each fingerprint, up to 2 ** MAP_BITS of them (32 MB).
MAP_BITS = 28
_U = np.uint64
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the hashes that winnowing keeps, ascending."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    # The last of equals: the least of the reversed window comes first there.
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


def fingerprints(words: list[bytes], span: int, k: int, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes): for n = span the winnowed k-word hashes, for each shorter n in sizes those of all runs of n words."""
    h = word_hashes(words)
    for n in sizes:
        if n > len(h):
            continue
        if n < span:
            yield n, np.arange(len(h) - n + 1), run_hashes(h, n) ^ _U(n)
        else:
            runs = run_hashes(h, k)
            at = winnow(runs, span - k + 1)
            yield n, at, runs[at]


def joined(words: list[bytes], a: int, b: int) -> str:
    return b" ".join(words[max(0, a) : b]).decode()


_STRINGS = pa.list_(pa.string())
ITEMS = "row long, n int, prints array<long>, runs array<string>"


def item_windows(items: DataFrame, span: int, k: int, text: str) -> DataFrame:
    """Of every item with words: the length n of its windows, its different fingerprints, and its different windows as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                if words:
                    n = min(span, len(words))
                    ((_, _, prints),) = fingerprints(words, span, k, [n])
                    runs = sorted({joined(words, i, i + n) for i in range(len(words) - n + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([n], pa.int32()), pa.array([np.unique(prints).view(np.int64)], pa.list_(pa.int64())), pa.array([runs], _STRINGS)], ["row", "n", "prints", "runs"])

    return items.select("row", F.col(text).alias("text")).mapInArrow(run, ITEMS)


def bit_map(prints: DataFrame, bits: int) -> np.ndarray:
    """Which low `bits` of hashes occur, as 64-bit words. Spark makes the words; their number is bounded by 2 ** (bits - 6)."""
    words = prints.select(F.expr(f"shiftright(hash & {(1 << bits) - 1}L, 6)").alias("at"), F.expr("shiftleft(1L, cast(hash & 63L as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(_U)


def in_map(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & _U(64 * len(words) - 1)
    return (words[(low >> _U(6)).astype(np.int64)] >> (low & _U(63)) & _U(1)).astype(bool)


FOUND = "doc_id long, text_key long, n_words long, found array<struct<n:int,hash:long,at:int,place:int,words:string>>"
_FOUND = pa.list_(pa.struct([("n", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("place", pa.int32()), ("words", pa.string())]))


def scan(docs: DataFrame, held: np.ndarray, sizes: list[int], span: int, k: int) -> DataFrame:
    """Of every document its number of words and the fingerprints that the map has: n, hash, and the words from `at` on that any window with it can have, itself at `place`."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                n_words, found = [], []
                for t in some.column(2).to_pylist():
                    words = words_of(t)
                    n_words.append(len(words))
                    hits: list[dict] = []
                    for n, places, hashes in fingerprints(words, span, k, sizes):
                        for i in np.flatnonzero(in_map(held, hashes)).tolist():
                            p = int(places[i])
                            left, right = (p - (span - k), p + span) if n == span else (p, p + n)
                            hits.append({"n": n, "hash": int(hashes[i].view(np.int64)), "at": max(0, left), "place": p, "words": joined(words, left, right)})
                    found.append(hits)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n_words, pa.int64()), pa.array(found, _FOUND)], ["doc_id", "text_key", "n_words", "found"])

    return small_batches(docs).mapInArrow(run, FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, map_bits: int = MAP_BITS, max_broadcast_rows: int = MAX_BROADCAST_ROWS, keyed: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, spans (merged ranges of hit words), items (different, sorted, as strings).

    Null and empty texts have no words, items without words no windows. The windows of items without an id count
    for spans, but name no item. Rows that repeat a doc_id each keep a row; a null doc_id stays null. Documents and items of any length
    are read whole; one very long document's hits are rows of their own until they are merged. Empty tables give no rows
    or no hits; other columns aren't read. With keyed each row also has its text_key.
    """
    rows = materialize(benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("row")), "items")
    made = materialize(item_windows(rows, span, k, "text"), "item-windows")
    prints = materialize(made.select("n", F.explode("prints").alias("hash")).distinct(), "prints")
    sizes = sorted(r.n for r in made.select("n").distinct().collect())  # span of them at most
    many = prints.count()
    held = bit_map(prints, max(6, min(map_bits, (32 * many).bit_length())))

    todo = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text), F.col(text).alias("text"))
    seen = materialize(scan(todo, held, sizes, span, k), "scanned")
    # Equal texts under one id have equal hits, which are found once.
    hits = seen.where(F.size("found") > 0).select("doc_id", "text_key", F.explode("found").alias("f")).select("doc_id", "text_key", "f.*").distinct()
    hits = materialize(hits.join(small(prints, max_broadcast_rows), ["n", "hash"], "left_semi"), "hits")

    # Extension: every window of n words that holds the place, by its words among the items' windows.
    words = F.split("words", " ")
    tried = hits.select("doc_id", "text_key", "n", "at", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(words) - F.col("n") + 1), lambda i: F.array_join(F.slice(words, i, F.col("n")), " "))).alias("i", "run"))
    tried = tried.select("doc_id", "text_key", "n", (F.col("at") + F.col("i")).alias("start"), "run").distinct()
    item_runs = made.select("row", "n", F.explode("runs").alias("run"))
    known = materialize(item_runs.select("n", "run").distinct(), "runs")
    exact = materialize(tried.join(small(known, max_broadcast_rows), ["n", "run"], "left_semi"), "exact")

    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = exact.select("doc_id", "text_key", "start", (F.col("start") + F.col("n")).alias("end")).distinct().withColumn("fresh", F.when(before >= F.col("start"), 0).otherwise(1))
    spans = spans.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    # Which items: first those that have a window that was hit at all, then by document, each once.
    used = exact.select("n", "run").distinct()
    named = item_runs.join(used, ["n", "run"], "left_semi").join(rows.select("row", "item_id").where("item_id is not null"), "row").select("n", "run", "item_id").distinct()
    named = materialize(named, "named")
    items = exact.select("doc_id", "text_key", "n", "run").distinct().join(small(named, max_broadcast_rows), ["n", "run"]).select("doc_id", "text_key", "item_id").distinct().groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("item_id")).alias("items"))

    same = lambda side: F.col("d.doc_id").eqNullSafe(F.col(f"{side}.doc_id")) & F.col("d.text_key").eqNullSafe(F.col(f"{side}.text_key"))
    both = materialize(spans.alias("d").join(items.alias("i"), same("i"), "left").select("d.doc_id", "d.text_key", "spans", "items"), "contaminated-documents")
    out = seen.select("doc_id", "text_key", "n_words").alias("d").join(small(both, max_broadcast_rows).alias("b"), same("b"), "left")
    for df in (made, rows, prints, hits, known, exact, named):
        discard(df)
    return out.select("d.doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *([F.col("d.text_key").alias("text_key")] if keyed else []))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that have a window of any benchmark item; all columns stay."""
    return without(docs, contamination(docs, benchmark, keyed=True).where(F.size("spans") > 0), "contaminated")
