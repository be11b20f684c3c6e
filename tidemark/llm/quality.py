"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own, those of the line before and those of the line
after; the chain adds a weight for each pair of neighbouring labels. The field is fitted to labelled documents, each
line taking its document's label. A document's evidence is the mean, weighted by line length, of its
lines' forward-backward marginals of `good`; a logistic curve fitted to the same documents turns its log odds into the score.

Features are made CHUNK lines at a time and at once reduced to the lines' scores, so a text of any number of
lines takes a few numbers a line; chains run side by side only as long as they fill no more than CELLS places.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, text_key, without
from .lang_id import held_out

# The sample that a fit uses: at most about so many labelled documents (by a hash where there are more), none of more
# lines than the second, and lines of all together at most the third. Documents are in it whole or not at all.
MAX_LABELLED = 8000
MAX_LINES = 2000
MAX_ALL_LINES = 200_000
CHUNK = 4096
CELLS = 1 << 16
OTHER, UPPER, LOWER, DIGIT, SPACE, STOP, SIGN, BANG, BAR, HIGH = range(10)


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.int64)
    for chars, kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"0123456789", DIGIT), (b" \t\r\n\v\f", SPACE), (b".,;:?'\"-()", STOP), (b"#$%&*@^~<>=+_\\/{}[]`", SIGN), (b"!", BANG), (b"|", BAR), (bytes(range(128, 256)), HIGH)):
        kinds[list(chars)] = kind
    return kinds


CLASSES = _classes()
N_OWN = 20
# Own features, those of the line before, those of the line after, and whether the line is first, last, any.
DIM = 3 * N_OWN + 3


def line_features(line: str, seen: set[str]) -> list[float]:
    raw = line.encode("utf-8", "replace")
    n = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=10).tolist()
    words = line.split()
    count, size = len(words), max(1, len(raw) - n[SPACE])
    most = max(Counter(words).values()) / count if count else 0.0
    kinds = len(set(words)) / count if count else 1.0
    again = sum(map(eq, words, words[1:])) / count if count else 0.0
    case = n[UPPER] / max(1, n[UPPER] + n[LOWER])
    sign = (n[SIGN] + n[BAR]) / size
    dup = float(line in seen and count > 0)
    seen.add(line)
    return [
        np.log1p(len(raw)), np.log1p(count), size / max(1, count), case, float(case > 0.6), n[DIGIT] / size, sign, float(sign > 0.05), n[STOP] / size, n[BANG] / size, n[BAR] / size,
        n[HIGH] / size, kinds, float(count > 8 and kinds < 0.5), most, float(count > 8 and most > 0.3), again, float(line.rstrip()[-1:] in (".", "?", "!", ":", '"')), float(line[:1].isupper()), dup,
    ]


def own_features(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of CHUNK lines at a time: their own features, and their lengths in characters plus one. A text without lines is one empty line."""
    seen: set[str] = set()
    lines = (text or "").split("\n")
    for at in range(0, len(lines), CHUNK):
        some = lines[at : at + CHUNK]
        yield np.array([line_features(x, seen) for x in some], np.float32), np.array([len(x) + 1 for x in some], np.float32)


def neighbours(own: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each line's own features by the weights that they have in its own score, in that of the line after, in that of the line before."""
    return own.astype(np.float64) @ weight[: 3 * N_OWN].reshape(3, N_OWN).T


def line_scores(parts: np.ndarray, first: np.ndarray, last: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores of lines of documents one after another, from neighbours(); first and last mark the ends of documents."""
    out = parts[:, 0] + weight[-1] + first * weight[-3] + last * weight[-2]
    out[1:] += np.where(first[1:], 0.0, parts[:-1, 1])
    out[:-1] += np.where(last[:-1], 0.0, parts[1:, 2])
    return out


def chains(gain: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward in log odds of `good` over `bad` on chains (chain, line) of n lines each: marginals of good, summed pair marginals, log partition (with bad lines scored 0)."""
    length = gain.shape[1]
    fore, back, total = np.zeros_like(gain), np.zeros_like(gain), np.zeros(len(gain))
    fore[:, 0] = gain[:, 0]
    end = np.where(n == 1, fore[:, 0], 0.0)
    for t in range(1, length):
        x = fore[:, t - 1]
        bad = np.logaddexp(pair[0, 0], pair[1, 0] + x)
        fore[:, t] = gain[:, t] + np.logaddexp(pair[0, 1], pair[1, 1] + x) - bad
        total += np.where(t < n, bad, 0.0)
        end = np.where(n == t + 1, fore[:, t], end)
    total += np.logaddexp(0.0, end)
    for t in range(length - 2, -1, -1):
        y = gain[:, t + 1] + back[:, t + 1]
        back[:, t] = np.where(t + 1 < n, np.logaddexp(pair[1, 0], pair[1, 1] + y) - np.logaddexp(pair[0, 0], pair[0, 1] + y), 0.0)
    good = 1 / (1 + np.exp(-np.clip(fore + back, -500, 500)))
    live = np.arange(1, length) < n[:, None]
    x, y = fore[:, :-1][live], (gain[:, 1:] + back[:, 1:])[live]
    odds = np.stack([np.full(len(x), pair[0, 0]), pair[0, 1] + y, pair[1, 0] + x, pair[1, 1] + x + y])
    odds = np.exp(odds - odds.max(0, initial=-np.inf)) if len(x) else odds
    return good, (odds / odds.sum(0)).sum(1).reshape(2, 2) if len(x) else np.zeros((2, 2)), total


def marginals(scores: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains (chain, line, label) with n lines each: marginals of `good`, summed pair marginals, log partition."""
    good, pairs, total = chains(scores[:, :, 1] - scores[:, :, 0], pair, n)
    return good, pairs, total + (scores[:, :, 0] * (np.arange(scores.shape[1]) < n[:, None])).sum(1)


def side_by_side(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents of like length in lots of at most CELLS places (one document, if it has more): their numbers, and the places of their lines."""
    order, starts = np.argsort(n, kind="stable"), np.cumsum(n) - n
    a = 0
    while a < len(order):
        fits = (np.arange(1, len(order) - a + 1) * n[order[a:]]) <= CELLS
        b = a + max(1, int(fits.argmin()) if not fits.all() else len(fits))
        lot = order[a:b]
        yield lot, starts[lot][:, None] + np.minimum(np.arange(n[lot[-1]]), n[lot][:, None] - 1)
        a = b


class Model:
    def __init__(self, weight: np.ndarray, pair: np.ndarray):
        self.weight, self.pair = weight, pair
        self.slope, self.shift = 1.0, 0.0

    def evidence(self, parts: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Log odds of the mean marginal of good, weighted by line length, of documents by neighbours() and lengths of their lines."""
        n = np.array([len(s) for s in sizes], np.int64)
        ends = np.cumsum(n)
        first, last = np.zeros(ends[-1], bool), np.zeros(ends[-1], bool)
        first[ends - n], last[ends - 1] = True, True
        gain, size = line_scores(np.concatenate(parts), first, last, self.weight), np.concatenate(sizes).astype(np.float64)
        out = np.zeros(len(n))
        for lot, at in side_by_side(n):
            live = np.arange(at.shape[1]) < n[lot][:, None]
            good, _, _ = chains(gain[at], self.pair, n[lot])
            w = size[at] * live
            p = np.clip((good * w).sum(1) / w.sum(1), 1e-6, 1 - 1e-6)
            out[lot] = np.log(p / (1 - p))
        return out

    def curve(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * evidence + self.shift)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, parts, sizes, held = [], [], [], 0
        for t in texts:
            made = [(neighbours(own, self.weight), size) for own, size in own_features(t)]
            parts.append(np.concatenate([m[0] for m in made]))
            sizes.append(np.concatenate([m[1] for m in made]))
            held += len(sizes[-1])
            if held > 4 * CELLS:
                out.append(self.evidence(parts, sizes))
                parts, sizes, held = [], [], 0
        if parts:
            out.append(self.evidence(parts, sizes))
        return self.curve(np.concatenate(out)) if out else np.zeros(0)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 100, ridge: float = 1e-3, rate: float = 0.08) -> Model:
    """Penalised likelihood by Adam on all chains at once. Both labels weigh the same in sum. docs: own features and lengths of the lines."""
    if not docs or len(set(labels.tolist())) < 2:
        model = Model(np.zeros(DIM), np.zeros((2, 2)))
        p = (float(np.sum(labels)) + 1) / (len(labels) + 2)
        model.slope, model.shift = 0.0, float(np.log(p / (1 - p)))
        return model
    own = np.concatenate([d for d, _ in docs]).astype(np.float64)
    n = np.array([len(s) for _, s in docs], np.int64)
    ends = np.cumsum(n)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[ends - n], last[ends - 1] = True, True
    # Standardised over the sample: (feature - mean) / spread, which the model's weights take in at the end.
    mean, spread = np.zeros(DIM), np.ones(DIM)
    before, after = own[:-1][~first[1:]], own[1:][~last[:-1]]
    for k, (x, missing) in enumerate(((own, 0), (before, first.sum()), (after, last.sum()))):
        m = x.sum(0) / len(own)
        mean[k * N_OWN : (k + 1) * N_OWN] = m
        spread[k * N_OWN : (k + 1) * N_OWN] = np.sqrt(np.maximum((((x - m) ** 2).sum(0) + missing * m**2) / len(own), 0))
    for k, flag in ((-3, first), (-2, last)):
        mean[k], spread[k] = flag.mean(), flag.std()
    spread[spread < 1e-6] = 1

    def folded(weight: np.ndarray) -> np.ndarray:
        out = weight / spread
        out[-1] = weight[-1] - mean[:-1] @ out[:-1]
        return out

    lots = []
    for c in (0, 1):
        of = np.flatnonzero(labels == c)
        starts = (ends - n)[of]
        for lot, _ in side_by_side(n[of]):
            at = starts[lot][:, None] + np.minimum(np.arange(n[of][lot[-1]]), n[of][lot][:, None] - 1)
            lots.append((c, 0.5 / len(of) / 8, at, n[of][lot], np.arange(at.shape[1]) < n[of][lot][:, None]))
    weight, pair = np.zeros(DIM), np.zeros((2, 2))
    moments = [np.zeros(DIM + 4), np.zeros(DIM + 4)]
    for step in range(1, steps + 1):
        now = folded(weight)
        gain = line_scores(neighbours(own, now), first, last, now)
        off, grad_p = np.zeros(len(own)), -ridge * pair
        for c, share, at, lines, live in lots:
            good, pairs, _ = chains(gain[at], pair, lines)
            off[at[live]] = share * (c - good[live])
            seen = np.zeros((2, 2))
            seen[c, c] = (lines - 1).sum()
            grad_p = grad_p + share * (seen - pairs)
        raw = np.concatenate([off @ own, off[1:][~first[1:]] @ before, off[:-1][~last[:-1]] @ after, [off[first].sum(), off[last].sum(), off.sum()]])
        grad_w = (raw - mean * off.sum()) / spread - ridge * weight
        grad = np.concatenate([grad_w, grad_p.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weight, pair = weight + move[:DIM], pair + move[DIM:].reshape(2, 2)
    model = Model(folded(weight), pair)
    e, target = model.evidence([neighbours(d, model.weight) for d, _ in docs], [s for _, s in docs]), np.asarray(labels, np.float64)
    slope, shift = 0.5, 0.0
    for _ in range(50):  # Newton's steps for the curve
        p = 1 / (1 + np.exp(-(slope * e + shift)))
        w = p * (1 - p) + 1e-9
        g = np.array([((target - p) * e).sum() - 0.01 * slope, (target - p).sum()])
        h = np.array([[(w * e * e).sum() + 0.01, (w * e).sum()], [(w * e).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        slope, shift = slope + move[0], shift + move[1]
    model.slope, model.shift = float(slope), float(shift)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES, max_all_lines: int = MAX_ALL_LINES) -> Model:
    """A model from a bounded sample of the labelled documents.

    Labels other than 0 and 1, and those of ids that have both, are passed over. Every different text of a
    labelled id takes its label, repeats of a text once. The sample has at most about max_labelled ids and as many texts, chosen by a hash
    of id and text, none of more than max_lines lines, and at most max_all_lines lines in sum. Features are made where the
    documents are; only those of the sample go to the driver, which fits. Without both labels every score is the labels' share.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other"))
    marks = marks.where("y = other").drop("other")
    place = lambda *of: F.pmod(F.xxhash64(*of, F.lit(17)), F.lit(1_000_000))
    marks = marks.where(place("__id") < int(1_000_000 * min(1.0, max_labelled / max(1, marks.count()))))
    whole = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"), text_key(text))
    found = whole.join(F.broadcast(marks), F.col("__doc") == F.col("__id"))  # about max_labelled rows
    found = found.groupBy("__id", "text_key").agg(F.first("y").alias("y"), F.first("__text").alias("__text"))
    lines = F.coalesce(F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1, F.lit(1))
    found = materialize(found.select("y", "__text", place("__id", "text_key").alias("place"), lines.alias("n")).where(F.col("n") <= max_lines), "labelled")
    share = int(1_000_000 * min(1.0, max_labelled / max(1, found.count())))
    held, upto = 0, 0
    for r in found.where(F.col("place") < share).groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").collect():  # about max_labelled rows
        held += r.n
        if held > max_all_lines:
            break
        upto = r.place + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, size = (np.concatenate(x) for x in zip(*own_features(t)))
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([len(size)], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([size.tobytes()], pa.binary())], ["y", "n", "x", "size"])

    rows = sorted(found.where(F.col("place") < upto).select("y", "__text").mapInArrow(run, "y int, n int, x binary, size binary").collect(), key=lambda r: (r.n, bytes(r.x), r.y))
    discard(found)
    made = [(np.frombuffer(r.x, np.float32).reshape(r.n, -1), np.frombuffer(r.size, np.float32)) for r in rows]
    return fit(made, np.array([r.y for r in rows], np.int64))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """One row a document: doc_id, score (0 to 1), with keyed its text_key.

    Null texts count as empty (one empty line); a text of any number of lines is one chain; equal texts get equal scores up to rounding; ids may be
    null or repeat; an empty table gives no rows; other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                texts = batch.column(1)[at : at + 256].to_pylist()
                own = [c[at : at + 256] for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256].cast(pa.int64()), pa.array(held.value.score(texts), pa.float64()), *own], ["doc_id", "score", "text_key"][: 2 + len(own)])

    own = [text_key(text)] if keyed else []
    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *own).mapInArrow(run, "doc_id long, score double" + ", text_key long" * keyed)


def report(docs: DataFrame, labels: DataFrame, keyed: bool = False) -> DataFrame:
    """score() learned from labels of documents that aren't held out (crc32 of the id mod 3 is not 1), for all."""
    out = held_out(F.col("doc_id"), 3, 1)
    model = train(docs, labels.where(~out))
    return score(docs, model, keyed=keyed).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *["text_key"] * keyed)


def drop_bad(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the classifier rejects (score under 0.5); all columns stay."""
    return without(docs, report(docs, labels, keyed=True).where("predicted = 0"), "rejected")
