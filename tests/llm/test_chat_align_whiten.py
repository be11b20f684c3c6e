import collections
import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import alignment, chat_format, tokens, whitening

CHAT = "conv_id long, turn long, role string, text string, body string, n long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def chat_rows():
    rnd = random.Random(5)
    odd = ["\\", "#", "##", "###", "####", "</turn>", "</turn>\n", "<", "</turn", "\\</turn>", "### user ###\n", " ###\n", "a\nb", "", "é𝒳", "<\\/turn>", "\\\\#"]
    rows = []
    for c in range(12):
        for t in range(rnd.randrange(1, 40)):
            role = "system" if t == 0 and c % 2 else rnd.choice(["user", "assistant", "system", "### x ###\n", "a:b", None])
            rows.append((c, t, role, None if rnd.random() < 0.05 else "".join(rnd.choice(odd) + rnd.choice(["", "word ", "zwei "]) for _ in range(rnd.randrange(6))), "x", 1))
    rows += [(20, 0, "user", "same", "x", 1)] * 3 + [(20, 0, "assistant", "b", "x", 1), (20, None, "user", "first", "x", 1), (None, 1, "assistant", "z", "x", 1), (None, 0, "user", None, "x", 1)]
    rows += [(30, 0, "assistant", "long words " * 20_000, "x", 1), (30, 1, "user", "ok", "x", 1)]
    return rows


def conversations(rows):
    out = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        out[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: sorted(r) for c, r in out.items()}


def plain_digest(rows):
    out = {}
    for c, turns in conversations(rows).items():
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize("setting", [{}, {"budget": 60, "history": 30}, {"budget": 60, "history": 30, "hot_bytes": 0}, {"budget": 1, "history": 0, "hot_bytes": 300}, {"budget": 40, "history": 100, "max_broadcast_rows": 0, "hot_bytes": 300}])
def test_chat_comes_back_whole(spark, setting):
    rows = chat_rows()
    windows = chat_format.format_windows(spark.createDataFrame(rows, CHAT), **setting)
    assert {r[0]: tuple(r)[1:5] for r in chat_format.digest(windows).collect()} == plain_digest(rows)


@pytest.mark.parametrize("hot_bytes", [1 << 20, 0])
def test_windows_hold_to_budget_and_history(spark, hot_bytes):
    rows = [(c, t, "system" if t == 0 and c else ("assistant" if t % 2 else "user"), " ".join(["word"] * ((c * 7 + t * 5) % 23)), "x", 1) for c in range(3) for t in range(600 if c else 50)]
    got = chat_format.format_windows(spark.createDataFrame(rows, CHAT), budget=80, history=30, hot_bytes=hot_bytes).orderBy("conv_id", "block", "window").collect()
    by = collections.defaultdict(list)
    for w in got:
        by[w.conv_id].append(w)
    for c, ws in by.items():
        assert [w.first_turn for w in ws] == [1, *(w.last_turn + 1 for w in ws[:-1])]
        assert max(w.block for w in ws) == 0 if hot_bytes else max(w.block for w in ws) > 0 or c == 0
        for k, w in enumerate(ws):
            assert w.over == (w.n_tokens > 80) and (not w.over or w.first_turn == w.last_turn)
            assert w.text.count("</turn>\n") == w.repeated + w.last_turn - w.first_turn + 1
            assert w.text.startswith("### system") == (c > 0)
            assert len(w.mask) == sum(t % 2 == 0 for t in range(w.first_turn, w.last_turn + 1))
            if k and w.repeated > (c > 0):  # history is the last of what the window before has
                assert ws[k - 1].text.endswith("</turn>\n".join(w.text.split("</turn>\n")[(c > 0) : w.repeated]) + "</turn>\n")
        assert any(w.repeated > 1 for w in ws)


def test_chat_of_nothing_and_given_counts(spark):
    docs = spark.createDataFrame(chat_rows(), CHAT)
    assert chat_format.format_windows(docs.limit(0)).count() == 0
    assert chat_format.digest(chat_format.format_windows(docs.limit(0))).count() == 0
    one = chat_format.format_windows(docs.where("conv_id = 20"), budget=2, history=1, tokens="n").orderBy("window").collect()
    assert [(w.first_turn, w.last_turn, w.repeated, w.n_tokens) for w in one] == [(1, 2, 0, 2), (3, 3, 1, 2), (4, 4, 1, 2), (5, 5, 1, 2)]


A, B = tokens.default_path(), alignment.piece_path()
DOCS = "doc_id long, text string, row long, side string"


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    # Independent of the library's own tables: both decode their single tokens.
    import base64

    import public_tokenizers as P

    a_bytes = {int(k): base64.b64decode(v) for v, k in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    b_bytes = lambda i: bytes([int(b_of.id_to_piece(i)[1:-1], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("\u2581", " ").encode()
    docs, count = [], collections.Counter()
    for d, text, *_ in rows:
        text = text or ""
        a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
        groups = []
        if text and b"".join(a_bytes[i] for i in a) == b"".join(map(b_bytes, b)) == (" " + text).encode():
            ga, gb, at_a, at_b, i, j = [], [], 0, 0, 0, 0
            while i < len(a) or j < len(b):
                if at_a <= at_b:
                    ga, at_a, i = [*ga, a[i]], at_a + len(a_bytes[a[i]]), i + 1
                else:
                    gb, at_b, j = [*gb, b[j]], at_b + len(b_bytes(b[j])), j + 1
                if at_a == at_b:
                    groups.append((ga, gb))
                    ga, gb = [], []
        docs.append((d, groups))
        count.update({(p, q) for x, y in groups for p in x for q in y})
    most = collections.defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for d, groups in docs:
        links = [(p, q) for x, y in groups for p in x for q in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sha(text) if groups else "", sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links)))
    return sorted(out, key=str)


def odd_documents():
    rnd = random.Random(3)
    parts = ["the ", "Straße ", "été", "  ", "\n", "\t", "𝒳", "漢字", "<|endoftext|>", "</s>", "<s>", "<unk>", "don't ", "1234567", "!!", "=====", "aaaaaaaa", "\u00a0", "\u0000", "internationalization "]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(30))), 1, "s") for i in range(150)]
    rows += [(3, "twice", 1, "s"), (3, "twice", 1, "s"), (None, "no id", 1, "s"), (None, None, 1, "s"), (400, "", 1, "s"), (401, " ", 1, "s"), (402, "\u2581", 1, "s"), (403, "lines\r\nand  spaces  ", 1, "s"), (404, "x" * 500, 1, "s")]
    return rows


@pytest.mark.parametrize("run,most", [(4096, alignment.SLICE), (3, 40)])
def test_alignment_is_that_of_a_plain_walk(spark, monkeypatch, run, most):
    monkeypatch.setattr(alignment, "RUN", run)
    rows = [*odd_documents(), (500, "a long text of many words " * 800, 1, "s")]
    got = alignment.align(spark.createDataFrame(rows, DOCS), A, B, max_pairs=most)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == plain_alignment(rows)
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).count() == 0


def test_wide_groups_and_stretches(monkeypatch):
    ga, ia, gb, ib = np.array([0, 0, 1, 2]), np.array([7, 7, 8, 9]), np.array([0, 0, 0, 1, 2, 2]), np.array([1, 2, 1, 3, 4, 4])
    n_a, n_b = np.array([2, 1, 1]), np.array([3, 1, 2])

    def counted():
        out = collections.Counter()
        for g, a, b, n in zip(*alignment.expanded(ga, ia, gb, ib, n_a, n_b)):
            out[int(g), int(a), int(b)] += int(n)
        return out

    whole = counted()
    monkeypatch.setattr(alignment, "WIDE", 1)
    assert counted() == whole == {(0, 7, 1): 4, (0, 7, 2): 2, (1, 8, 3): 1, (2, 9, 4): 2}
    monkeypatch.setattr(alignment, "STRETCH", 5)
    pieces, text = alignment.piece_tokens(B), "ab cd  ef   gh\n ij" * 7 + "  "
    assert len(pieces._stretches(text)) > 10 and pieces.ids([text, "", " "]) == [pieces.model.encode(t) for t in (text, "", " ")]


VECTORS = "vec_id long, embedding array<double>, x string, n string"


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors))
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - fit.sum(0)) ** 2).sum(1), (x - mean) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("decay,passes", [(0.5, False), (1.0, True)])
def test_whitening_is_that_of_the_full_covariance(spark, monkeypatch, decay, passes):
    """A steep spectrum is done within the thin basis, a flat one needs all dimensions."""
    seen, whole = [], whitening.times_covariance
    monkeypatch.setattr(whitening, "times_covariance", lambda *a: seen.append(a[3].shape[1]) or whole(*a))
    v = (np.random.default_rng(2).normal(size=(400, 30)) * 9 * decay ** np.arange(30)).tolist()
    v += v[:50]  # equal vectors count once in the fit
    rows = whitening.whiten(spark.createDataFrame([(i, x, "c", "c") for i, x in enumerate(v)], VECTORS)).collect()
    n, deviation, whitened, share = plain_whitening(v)
    assert (30 in seen) == passes and len(rows) == 4 * len(v)
    got = np.zeros((len(v), 4))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[r.vec_id]) and abs(r.explained - share[r.component - 1]) < 1e-12 and r.identity_error < 1e-9
    assert np.abs(got * np.sign((got * whitened).sum(0)) - whitened).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-inf, 1.0]), (6, [])]
    usable = [(10, [0.0, 1.0]), (10, [0.0, 1.0]), (None, [2.0, -3.0]), (12, [-0.0, 1.0]), (13, [5.5, 0.25]), (14, [1.0, 2.0, 3.0]), (15, [1.0, 2.0, 3.0])]
    make = lambda rows: spark.createDataFrame([(i, v, "c", "c") for i, v in rows], VECTORS)
    rows = whitening.whiten(make(odd + usable)).collect()
    # Two dimensions give two components; the pair of equal vectors of three has no variance and no rows.
    assert sorted((r.vec_id or -1, r.component) for r in rows) == sorted((i, c) for i in (10, 10, -1, 12, 13) for c in (1, 2))
    assert {r.n for r in rows} == {3}
    assert whitening.whiten(make(odd)).count() == 0 and whitening.whiten(make([])).count() == 0
    far = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e12, 0.0]), (4, [0.0, 0.0])])).collect()
    assert {r.vec_id for r in far} == {1, 2, 3, 4} and {r.deviation for r in far} == {None}
    x = np.array([[5 << 29, 1], [0, 5]])
    assert whitening.deviations(x, 2, [5 << 29, 6]) == [(5 << 29) ** 2 + 16, (5 << 29) ** 2 + 16]
    assert whitening.deviations(np.array([[1 << 62]]), 1, [-(1 << 62)]) == [None]
