"""Language by rank-order profiles of character n-grams (one to three letters, words padded by a space).

A language's profile ranks its PROFILE most frequent n-grams over all training texts. A document's
own n-grams are ranked the same way, and the out-of-place distance to a profile sums how far each stands
from its rank there, PROFILE where it has none. The nearest profile names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
UNKNOWN = "und"
# Distinct n-grams that a task holds before it passes its counts on.
MAX_HELD = 2_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: itself if a letter, else a space."""
    points = np.arange(0x110000, dtype=np.int64)
    points[[not chr(c).isalpha() for c in range(0x110000)]] = 32
    return points


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams, in no order; none without a letter."""
    points = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")]
    gap = points == 32
    points = np.concatenate([[32], points[~(gap & np.concatenate([[True], gap[:-1]]))], [32]])
    if len(points) > 2 and points[-2] == 32:
        points = points[:-1]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    inner = b != 32
    two = points[:-1] << 21 | points[1:]
    return np.concatenate([b[inner], two, (a << 42 | b << 21 | c)[inner]])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent first; of equal counts the lower code."""
    return codes[np.argsort(-counts, kind="stable")[:top]]


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, mod parts, is part; null counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def profiles(docs: DataFrame, top: int = PROFILE, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, place, code): the ranked profile of each non-null lang, counted over all docs. Texts are counted whole, whatever their length; null ones have nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(name: str, codes: np.ndarray) -> None:
            new, n = np.unique(codes, return_counts=True)
            if name in held:
                both = np.concatenate([held[name][0], new])
                new, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, np.concatenate([held[name][1], n])).astype(np.int64)
            held[name] = new, n

        def out() -> Iterator[pa.RecordBatch]:
            for name, (codes, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])
            held.clear()

        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, len(whole), 256)):
            waiting: dict[str, list[np.ndarray]] = {}
            size = 0
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(name, []).append(grams(t))
                size += len(waiting[name][-1])
                if size > 4_000_000:
                    for k, v in waiting.items():
                        add(k, np.concatenate(v))
                    waiting, size = {}, 0
            for k, v in waiting.items():
                add(k, np.concatenate(v))
            if sum(len(c) for c, _ in held.values()) > MAX_HELD:
                yield from out()
        yield from out()

    counted = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang).mapInArrow(run, "lang string, code long, n long")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select("lang", "place", "code")


class Ranks:
    def __init__(self, rows: list, top: int):
        self.langs = sorted({r.lang for r in rows})
        self.codes = np.unique(np.array([r.code for r in rows], np.int64))
        self.top = top
        self.place = np.full((len(self.langs), len(self.codes)), -1, np.int64)
        for r in rows:
            self.place[self.langs.index(r.lang), np.searchsorted(self.codes, r.code)] = r.place - 1

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language, and 1 less its distance as a share of the largest possible one; of equal distances the first name."""
        codes = grams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        mine = ranked(*np.unique(codes, return_counts=True), self.top)
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        place = np.where(self.codes[at] == mine, self.place[:, at], -1)
        far = np.where(place < 0, self.top, np.abs(place - np.arange(len(mine)))).sum(1)
        best = int(far.argmin())
        return self.langs[best], 1.0 - float(far[best]) / (self.top * len(mine))


def identify(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text", top: int = PROFILE) -> DataFrame:
    """One row a document: doc_id, lang_pred, score. Profiles come from `training` (text, lang).

    `und` with score 0 for texts that are null or have no letter, and for all where nothing could be
    learned. As many rows as languages times `top` are collected. Null ids and repeated rows keep a row each; an empty
    table gives no rows; other columns aren't read.
    """
    model = docs.sparkSession.sparkContext.broadcast(Ranks(profiles(training, top).collect(), top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (batch.slice(at, 256) for batch in batches for at in range(0, len(batch), 256)):
            got = [model.value.nearest(t) for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """identify() learned from the documents that aren't held out (crc32 of the id mod 4 is not 2), for all."""
    out = held_out(F.col("doc_id"), 4, 2)
    return identify(docs, docs.where(~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
