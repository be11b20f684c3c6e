"""Alignment of two tokenizers' tokens by a sweep over their end offsets.

A token ends at a byte offset of its document. The end events of both tokenizers are dealt by document and sorted by
offset; a machine reads them as a stream and closes a group wherever both end at once. What it holds is the open group and
at most a run of each side, however long the document is. Events travel in runs of up to RUN, as ids behind the offset where
the run begins: an id's length gives the offsets, so that a token takes two bytes in the shuffle.

A link is a pair of an A and a B token of one group. How many documents hold a pair of ids is counted over the whole corpus, added up within a task
before anything is shuffled. The counts go back to the documents in slices of A ids that hold at most SLICE pairs, by
a broadcast of one slice at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

RUN = 4096
STRETCH = 1 << 16
SLICE = 2_000_000
# A group with more links than this is expanded from its distinct ids.
WIDE = 1 << 20
# Distinct pairs that a counting task gathers before it passes them on.
GATHER = 4_000_000
_KEY = 1 << 40


# Fixed value: how the byte-level tokenizer parts a text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """A byte-level BPE whose special tokens' strings in a text are ordinary text. entries: each id's bytes.

    Where every merge makes a token of its own and they come in order of their ids, as is usual, ids are ranks and texts are encoded by those; else by the file's own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = set(self.tokenizer.get_added_tokens_decoder())
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        spelled = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.entries = [bytes(of[c] for c in t) if i not in special and all(c in of for c in t) else t.encode() for i, t in enumerate(spelled)]
        with open(path) as f:
            whole = json.load(f)
        merged = [whole["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in whole["model"]["merges"]]
        plain = whole.get("normalizer") is None and whole["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        ranked = plain and all(x < y for x, y in zip(merged, merged[1:])) and len(merged) + 256 + len(special) == len(spelled)
        self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={e: i for i, e in enumerate(self.entries) if i not in special}, special_tokens={}) if ranked else None

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranks:
            return [self.ranks.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """A sentencepiece BPE. entries: each id's bytes. Long texts are cut before a space, which no entry spans, so that a call's memory is bounded."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.entries = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)]
        self.apart = not any(re.search("[^▁]▁", p) for p in spelled)

    def _stretches(self, text: str) -> list[str]:
        out, at = [], 0
        while self.apart and len(text) - at > STRETCH:
            p = text.find(" ", at + STRETCH)
            while p > 0 and text[p - 1] == " ":
                p = text.find(" ", p + 1)
            if p < 0 or p + 1 == len(text):
                break
            out.append(text[at:p])  # the space comes back as the one that every call adds
            at = p + 1
        return [*out, text[at:]]

    def ids(self, texts: list[str]) -> list[list[int]]:
        cut = [self._stretches(t) for t in texts]
        got = iter(self.model.encode([s for ss in cut for s in ss], num_threads=1))
        return [next(got) if len(ss) == 1 else [i for _ in ss for i in next(got)] for ss in cut]


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


@lru_cache(maxsize=2)
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)


def id_type(entries: int) -> str:
    return "<u4" if entries > 1 << 16 else "<u2"


EVENTS = "row long, doc_id long, first long, side tinyint, base long, ids binary"


def end_events(docs: DataFrame, a_path: str, b_path: str, doc_id: str, text: str) -> DataFrame:
    """Runs of end events of both sides; `first` is where a run's first token ends, `base` where it begins. A document without tokens gives one empty run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokens(a_path), piece_tokens(b_path)
        lengths, kinds = [np.array([len(e) for e in t.entries]) for t in (a, b)], [id_type(len(t.entries)) for t in (a, b)]
        entry = b.entries.__getitem__
        for batch in batches:
            for k in range(0, len(batch), 128):
                part = batch.slice(k, 128)
                texts = [t or "" for t in part.column(2).to_pylist()]
                out: list[tuple] = []
                for row, doc, t, *both in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, a.ids([" " + t for t in texts]), b.ids(texts)):
                    whole = (" " + t).encode()
                    ids = [np.array(x, kind) for x, kind in zip(both, kinds)]
                    ends = [np.cumsum(n[x]) for n, x in zip(lengths, ids)]
                    # Bytes are all that A knows, so that it gives back a text of the same length.
                    if not t or any(e[-1:].sum() != len(whole) for e in ends) or b"".join(map(entry, both[1])) != whole:
                        out.append((row, doc, 0, 0, 0, b""))
                        continue
                    for side in range(2):
                        for at in range(0, len(ids[side]), RUN):
                            out.append((row, doc, int(ends[side][at]), side, int(ends[side][at - 1]) if at else 0, ids[side][at : at + RUN].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.binary()])], ["row", "doc_id", "first", "side", "base", "ids"])

    return small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, EVENTS)


class _Document:
    """What is known of the document whose events are being read."""

    def __init__(self, row: int, doc: int | None):
        self.row, self.doc = row, doc
        self.n = [0, 0, 0, 0]
        self.digest = None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, n: list[int], text: bytes, pairs: np.ndarray, times: np.ndarray) -> None:
        self.n = [x + y for x, y in zip(self.n, n)]
        if self.digest is None:
            self.digest = hashlib.sha256(text)
        else:
            self.digest.update(b";" + text)
        self.pairs.append((pairs, times))
        if len(self.pairs) > 1:
            at, inverse = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
            self.pairs = [(at, np.bincount(inverse, np.concatenate([t for _, t in self.pairs])).astype(np.int64))]

    def result(self, kind: str) -> tuple:
        pairs, times = self.pairs[0] if self.pairs else (np.zeros(0, np.int64),) * 2
        return self.row, self.doc, *self.n, self.digest.hexdigest() if self.digest else "", np.diff(pairs, prepend=0).astype(kind).tobytes(), times.astype("<u4").tobytes()


def expanded(ga: np.ndarray, ia: np.ndarray, gb: np.ndarray, ib: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as (group, A id, B id, how many), by group."""
    wide = np.flatnonzero(n_a * n_b > WIDE)
    narrow_a, narrow_b = (~np.isin(g, wide) if len(wide) else np.ones(len(g), bool) for g in (ga, gb))
    first_b = np.cumsum(n_b) - n_b
    g, i = ga[narrow_a], ia[narrow_a]
    reps = n_b[g]
    within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    group = np.repeat(g, reps)
    out = [(group, np.repeat(i, reps), ib[first_b[group] + within], np.ones(len(group), np.int64))]
    for w in wide.tolist():
        (a, times_a), (b, times_b) = np.unique(ia[ga == w], return_counts=True), np.unique(ib[gb == w], return_counts=True)
        out.append((np.full(len(a) * len(b), w), np.repeat(a, len(b)), np.tile(b, len(a)), np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out)) if len(out) > 1 else out[0]


def pair_type(pair_base: int) -> str:
    return "<i8" if pair_base > 1 << 32 else "<u4"


class Sweep:
    """Reads runs in order of (document, first offset); gives the rows of documents as they end."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], pair_base: int):
        self.lengths, self.pair_base, self.kind = lengths, pair_base, pair_type(pair_base)
        self.names = [str(i).encode() + s for i in range(max(map(len, lengths))) for s in (b",", b"|", b";")]
        self.current: _Document | None = None
        self.open = self._nothing()

    @staticmethod
    def _nothing() -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]

    def read(self, runs: list[tuple], last: bool = False) -> list[tuple]:
        """runs: (row, doc, first, side, base, ids). Closes all groups up to the last run's first offset; with `last`, all."""
        docs = [self.current] if self.current else []
        ends: list[list[np.ndarray]] = [[self.open[s][0]] for s in range(2)]
        ids: list[list[np.ndarray]] = [[self.open[s][1]] for s in range(2)]
        for row, doc, _, side, base, packed in runs:
            if not docs or docs[-1].row != row:
                docs.append(_Document(row, doc))
            x = np.frombuffer(packed, id_type(len(self.lengths[side]))).astype(np.int64)
            ends[side].append((len(docs) - 1) * _KEY + base + np.cumsum(self.lengths[side][x]))
            ids[side].append(x)
        if not docs:
            return []
        (ka, kb), (ia, ib) = (np.concatenate(e) for e in ends), (np.concatenate(i) for i in ids)
        cuts = np.intersect1d(ka, kb, assume_unique=True)
        if not last and runs:
            cuts = cuts[cuts < (len(docs) - 1) * _KEY + runs[-1][2]]
        done_a, done_b = (int(np.searchsorted(k, cuts[-1], "right")) if len(cuts) else 0 for k in (ka, kb))
        self._close(docs, cuts, ka[:done_a], ia[:done_a], kb[:done_b], ib[:done_b])
        shift = (len(docs) - 1) * _KEY
        self.open = self._nothing() if last else [(ka[done_a:] - shift, ia[done_a:]), (kb[done_b:] - shift, ib[done_b:])]
        self.current = None if last else docs[-1]
        return [d.result(self.kind) for d in (docs if last else docs[:-1])]

    def _close(self, docs: list[_Document], cuts: np.ndarray, ka: np.ndarray, ia: np.ndarray, kb: np.ndarray, ib: np.ndarray) -> None:
        if not len(cuts):
            return
        ga, gb = np.searchsorted(cuts, ka), np.searchsorted(cuts, kb)
        n_a, n_b = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        of = cuts // _KEY
        # Tokens in order of group and side, each with what follows it: a comma within a side, | after A, ; after B.
        last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
        codes = np.empty(len(ia) + len(ib), np.int64)
        codes[np.arange(len(ia)) + (np.cumsum(n_b) - n_b)[ga]] = ia * 3 + last_a
        codes[np.arange(len(ib)) + np.cumsum(n_a)[gb]] = ib * 3 + 2 * last_b
        names = list(map(self.names.__getitem__, codes.tolist()))
        group, a, b, times = expanded(ga, ia, gb, ib, n_a, n_b)
        code = of[group] * self.pair_base + a * len(self.lengths[1]) + b
        order = np.argsort(code, kind="stable") if len(times) and times.max() > 1 else None
        code, times = (np.sort(code), None) if order is None else (code[order], times[order])
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        times = np.diff(np.append(start, len(code))) if times is None else np.add.reduceat(times, start)
        code = code[start]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        known = of[heads]
        sums = [np.add.reduceat(x, heads).tolist() for x in (n_a, n_b, np.ones(len(of), np.int64), n_a * n_b)]
        text_at = np.append(0, np.cumsum(np.add.reduceat(n_a + n_b, heads))).tolist()
        pair_at = np.append(np.searchsorted(code, known * self.pair_base), len(code)).tolist()
        for k, d in enumerate(known.tolist()):
            pairs = code[pair_at[k] : pair_at[k + 1]] - d * self.pair_base
            docs[d].add([s[k] for s in sums], b"".join(names[text_at[k] : text_at[k + 1]])[:-1], pairs, times[pair_at[k] : pair_at[k + 1]])


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_ALIGNED_TYPES = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]


def swept(events: DataFrame, lengths: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row a document: its counts, the digest of its groups, and its distinct linked id pairs (as differences of A id * B entries + B id) with how often each is linked."""
    pair_base = len(lengths[0]) * len(lengths[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(lengths, pair_base)
        names = [c.split()[0] for c in ALIGNED.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), _ALIGNED_TYPES)], names)

        for batch in batches:
            for k in range(0, len(batch), 256):
                yield packed(sweep.read(list(zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)))))
        yield packed(sweep.read([], last=True))

    return events.repartition("row").sortWithinPartitions("row", "first", "side").mapInArrow(run, ALIGNED)


def _pairs(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a batch one after the other, and how many each row has."""
    sizes = np.array([len(x) for x in column.to_pylist()], np.int64) // np.dtype(kind).itemsize
    steps = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)
    total = np.cumsum(steps)
    before = np.append(0, total)[np.cumsum(sizes) - sizes]
    return total - np.repeat(before, sizes), sizes


def pair_counts(aligned: DataFrame, b_size: int, kind: str) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more. A task adds up before it sends; an A id has at most as many pairs as B has entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            known, inverse = np.unique(np.concatenate([known, _pairs(batch.column(0), kind)[0]]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, np.ones(len(inverse) - len(counts), np.int64)]), len(known)).astype(np.int64)
            if len(known) > GATHER:
                yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(counts)], ["pair", "n"])
                known, counts = known[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(counts)], ["pair", "n"])

    counts = materialize(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / b_size).cast("int")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    out = materialize(counts.join(most, "a").select("a", "pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")
    discard(counts)
    return out


RESULT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def looked_up(aligned: DataFrame, counts: DataFrame, low: int, high: int, kind: str) -> DataFrame:
    """aligned with n_best and count_sum over the pairs from `low` to under `high`, whose counts are broadcast (at most about SLICE)."""
    part = counts.where((F.col("pair") >= low) & (F.col("pair") < high)).select("pair", "n", "best").toArrow()
    pairs, n, best = (part.column(c).to_numpy() for c in range(3))
    order = np.argsort(pairs)
    shared = aligned.sparkSession.sparkContext.broadcast((pairs[order], n[order], best[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            got, sizes = _pairs(batch.column("pairs"), kind)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            mine = (got >= low) & (got < high)
            at = np.searchsorted(pairs, got[mine])
            of = np.repeat(np.arange(len(sizes)), sizes)[mine]
            n_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(n_best, of, times[mine] * best[at])
            np.add.at(total, of, times[mine] * n[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(n_best), pa.array(total)], [c.split()[0] for c in RESULT.split(", ")])

    return aligned.mapInArrow(run, RESULT)


def slices(counts: DataFrame, b_size: int, most: int) -> list[tuple[int, int]]:
    """Ranges of pairs, whole A ids each, of at most `most` pairs unless one A id has more (at most as many as B has entries)."""
    sizes = sorted(counts.groupBy("a").count().collect())  # at most one row an entry of A
    out, low, held = [], 0, 0
    for a, n in sizes:
        if held and held + n > most:
            out.append((low, a * b_size))
            low, held = a * b_size, 0
        held += n
    return [*out, (low, 1 << 62)]


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", max_pairs: int = SLICE) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A encodes a space and the text, B the text, to which it adds that space itself; strings of special tokens are ordinary
    text. Groups lie between offsets where tokens of both end, links are the A-B pairs of a group. n_best counts the links whose
    pair is in as many documents as any pair of its A id, count_sum adds up the documents of each link's pair.
    Texts that are null or empty, or that either tokenizer doesn't give back byte for byte, have no tokens: zeros and ''. Rows with
    null or repeated ids, and repeated rows, each count as a document of their own. An empty table gives no rows; other columns aren't read.
    Texts of any length are taken whole; what the sweep holds of one beside its row of distinct pairs doesn't grow with it.
    """
    lengths = tuple(np.array([len(e) for e in t.entries], np.int64) for t in (byte_tokens(a_path), piece_tokens(b_path)))
    b_size, kind = len(lengths[1]), pair_type(len(lengths[0]) * len(lengths[1]))
    aligned = materialize(swept(end_events(docs, a_path, b_path, doc_id, text), lengths), "aligned", "zstd")
    counts = pair_counts(aligned, b_size, kind)
    parts = [looked_up(aligned, counts, low, high, kind) for low, high in slices(counts, b_size, max_pairs)]
    if len(parts) == 1:
        return parts[0].drop("row")
    keys = [c.split()[0] for c in RESULT.split(", ")][:7]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
