"""Packing of documents into token sequences by vector best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
GROUP = 20_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every document and end_id, cut into pieces of `size`; only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.ids([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.frombuffer(ids + end, enc.dtype).astype("<u4").tobytes()
                cuts = [0, *range((len(ids) // 4 - 1) % size + 1, len(ids) // 4 + 1, size)]
                rows += [(doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


# How a bin's fit is weighed: tokens, documents, attention cost, and the rule. A group is packed by each, and the fewest sequences are kept.
CHOICES = (((1.0, 0.002, 0.02), "norm"), ((1.0, 0.05, 0.2), "norm"), ((1.0, 0.01, 0.05), "dot"))


def best_fit(lengths: np.ndarray, size: int, max_docs: int, max_cost: int, weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first.

    A piece needs its tokens, one document and its attention cost (length squared). Among the open
    bins that hold all three, the one is taken whose residual after it has the least weighted norm
    (rule "norm"), or whose residual before it is nearest to the piece in direction, by weighted dot product as a share of its norm ("dot").
    Ties go to the oldest bin.
    """
    cap = np.array([size, max_docs, max_cost], np.float64)
    weight = np.array(weights, np.float64)[:, None]
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min(initial=size))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((3, 1024), np.float64)
    names, n, made = np.empty(1024, np.int64), 0, 0
    for k, i in enumerate(order.tolist()):
        item = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        open_ = left[:, :n]
        fits = np.flatnonzero((open_[0] >= item[0]) & (open_[1] >= 1) & (open_[2] >= item[2])) if n else ()
        if len(fits):
            rest, share = open_[:, fits] / cap[:, None], (item / cap)[:, None]
            if rule == "norm":
                at = fits[int((weight * (rest - share) ** 2).sum(0).argmin())]
            else:
                at = fits[int(((weight * rest * share).sum(0) / (weight * rest**2).sum(0)).argmax())]
        else:
            if n == len(names):
                left, names = np.concatenate([left, np.empty_like(left)], 1), np.concatenate([names, np.empty_like(names)])
            at, names[n], left[:, n] = n, made, cap
            n, made = n + 1, made + 1
        bins[i], offsets[i] = names[at], size - left[0, at]
        left[:, at] -= item
        if k % 512 == 511:  # bins that can hold no more are left behind
            keep = np.flatnonzero((left[0, :n] >= least) & (left[1, :n] >= 1))
            left[:, : len(keep)], names[: len(keep)], n = left[:, keep], names[keep], len(keep)
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, max_docs: int | None = None, max_cost: int | None = None, choices: tuple = CHOICES, group: int = GROUP) -> DataFrame:
    """Every piece of every document, with the sequence that it goes to and its offset there.

    Bins hold `size` tokens, max_docs pieces (by default as many as there are tokens) and max_cost attention cost (by
    default that of one piece of `size`); a piece takes its share of all three. Pieces are dealt by row into groups of about `group`, each packed by
    itself under every choice of weights and rule, of which the first with the fewest sequences is kept; every group fills its
    bins nearly to the end, so the groups cost next to nothing. Null text counts as empty (the end id alone), null and repeated
    ids and repeated rows are packed each for itself, documents of any length are cut into pieces, an empty table gives no rows, other columns aren't read.
    """
    cut = materialize(pieces(docs, tokenizer, end_id, size).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group))
    docs_cap, cost_cap = max_docs or size, max_cost or size * size

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        tried = (best_fit(rows["length"].to_numpy(), size, docs_cap, cost_cap, weights, rule) for weights, rule in choices)
        bins, offsets = min(tried, key=lambda t: t[0].max(initial=-1))
        return rows[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    dealt = cut.withColumn("bin_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("bin_group").applyInPandas(run, PIECES + ", sequence_id long, offset long")
