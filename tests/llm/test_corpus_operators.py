"""The corpus operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns, against plain Python."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import common, decontam, exact_dedup, html_text, huffman, lang_id, packing, pii, quality, token_files, tokens, url_rules
from tidemark.llm.dom import parse

PATH = tokens.default_path()
TEXTS = [(5, "a  b\tc"), (3, "a b c"), (3, "a b c"), (None, "a b\n\nc"), (9, None), (8, ""), (7, "x" * 40_000), (11, "x" * 40_000 + "y"), (12, " it's  _odd_ ²½ 你好\x1c z\n\n "), (13, "\u00a0<|endoftext|>"), (14, "only one")]


def docs_of(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, 1, "s", "k") for i, t in rows], "doc_id long, text string, n_tokens int, sha string, kept string")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest_all,bound", [(True, 1000), (False, 1000), (False, 0)])
def test_exact_dedup(spark, digest_all, bound):
    got = exact_dedup.exact_dedup(docs_of(spark), digest_all=digest_all, max_broadcast_rows=bound).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in TEXTS:
        ids = groups[norm(t)]
        least = min((x for x in ids if x is not None), default=None)
        want.append((i, least if len(ids) > 1 else i, len(ids), i == least or len(ids) == 1))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted(want, key=str)
    if digest_all:
        assert {r.text_sha256 for r in got} == {hashlib.sha256(norm(t).encode()).hexdigest() for _, t in TEXTS}
    assert exact_dedup.exact_dedup(docs_of(spark).limit(0)).count() == 0


def test_drop_copies_keeps_columns(spark):
    d = docs_of(spark)
    out = exact_dedup.drop_copies(d)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {3, 8, 7, 11, 12, 13, 14}


def library_ids(t, tokenizer):
    return tokenizer.encode(t or "", add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Zé_'s1\n\t!?²你\u00a0\x1c|<>")), max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_library(texts):
    e = tokens.encoder(PATH)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.ids(texts)] == [library_ids(t, e.tokenizer) for t in texts]


def test_token_files(spark):
    tok = tokens.encoder(PATH).tokenizer
    got = {(r.doc_id, r.start): r for r in token_files.round_trip(docs_of(spark), PATH).collect()}
    assert len(got) == len(TEXTS)
    at = 0
    for (i, start), r in sorted(got.items(), key=lambda x: x[0][1]):
        assert start == at
        at += r.n_tokens
        ok = [zlib.crc32(np.array([*library_ids(t, tok), 0], "<u4").tobytes()) for j, t in TEXTS if j == i]
        assert r.ids_crc32 in ok
    ids = [k[0] for k in sorted(got, key=lambda x: x[1])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert token_files.round_trip(docs_of(spark).limit(0), PATH).count() == 0


def test_token_files_in_many_parts(spark):
    """One id in a third of all rows, several parts: file names ascend with the ids, starts have no gaps."""
    rows = [(7 if i % 3 == 0 else i, f"text {i % 5} of it " * (i % 40)) for i in range(300)]
    path = common.new_path(spark, "corpus")
    token_files.write(docs_of(spark, rows), path, PATH, part_bytes=2000)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    parts = sorted((r.file, r.doc_id[0], r.doc_id[-1]) for r in spark.read.parquet(f"{path}/blocks").selectExpr("_metadata.file_name as file", "doc_id").collect())
    assert len(parts) > 3 and all(a[2] <= b[1] for a, b in zip(parts, parts[1:]))
    want = sorted((i, np.array([*library_ids(t, tokens.encoder(PATH).tokenizer), 0], "<u4").tobytes()) for i, t in rows)
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == want


@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=200), st.integers(8, 16))
@settings(max_examples=100, deadline=None)
def test_code_lengths(counts, most):
    bits = huffman.code_lengths(np.array(counts), most)
    assert bits.max() <= most and (2.0**-bits).sum() <= 1
    if most == 16 and len(counts) > 1:
        import heapq

        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert (bits * counts).sum() >= cost and (bits.max() == most or (bits * counts).sum() == cost)


@given(st.lists(st.integers(0, 300), max_size=400), st.integers(9, 16))
@settings(max_examples=100, deadline=None)
def test_coder_round_trip(ids, most):
    ids = np.array(ids, np.int64)
    symbols, n = np.unique(ids, return_counts=True)
    coder = huffman.Coder(symbols, huffman.code_lengths(n, most)) if len(ids) else huffman.Coder(np.array([0]), np.array([1]))
    payload, spans = coder.encode(ids)
    assert coder.decode(payload, spans, len(ids)).tolist() == ids.tolist()


def test_packing(spark):
    tok = tokens.encoder(PATH).tokenizer
    got = packing.pack(docs_of(spark), PATH, end_id=2, size=64).collect()
    by_doc, seqs = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for i, t in TEXTS:
        ids = [*library_ids(t, tok), 2]
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        want = {(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
        assert want <= {(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]}
    assert packing.pack(docs_of(spark).limit(0), PATH).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_every_capacity(rule):
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 64, 500)
    bins, offsets = packing.best_fit(lengths, 64, 4, 2500, (1.0, 0.2, 0.5), rule)
    for b in np.unique(bins):
        at = bins == b
        assert lengths[at].sum() <= 64 and at.sum() <= 4 and (at.sum() == 1 or (lengths[at] ** 2).sum() <= 2500)
    loose, _ = packing.best_fit(lengths, 64, 64, 64 * 64, (1.0, 0.0, 0.0), rule)
    assert len(np.unique(loose)) <= -(-lengths.sum() // 64) * 1.03 + 1


def test_the_vector_decides():
    """After 40 | 20 20 the piece of 10 fits both bins to the last token: by cost the fuller one is that of 40, by documents that of two pieces."""
    place = lambda w: packing.best_fit(np.array([40, 20, 20, 10]), 50, 50, 2500, w)[0].tolist()
    assert place((1.0, 0.0, 1.0)) == [0, 1, 1, 0] and place((1.0, 1.0, 0.0)) == [0, 1, 1, 1]


def test_packing_is_no_worse_than_by_tokens_alone():
    rnd = np.random.default_rng(5)
    lengths = np.concatenate([np.minimum(rnd.lognormal(5.5, 1.2, 3000).astype(int) + 1, 1024), rnd.integers(1, 1025, 1000)])
    count = lambda w, rule: packing.best_fit(lengths, 1024, 1024, 1024**2, w, rule)[0].max()
    assert min(count(w, r) for w, r in packing.CHOICES) <= count((1.0, 0.0, 0.0), "norm")


def test_url_rules(spark):
    urls = ["http://a.example.com/en/x?q", "https://www.Example.COM/en/", "http://x.www.example.com/en/y", "ftp://site.net/es/", "http://net/fr/#a", "http://com", "http://xcom/", "nothing", None, "://", "http://.com/", "http://example.com?/en/", "a://b.net/es", "http://com.", "http://Ünet.net/es/1"]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, "http://com/", "x", "y"), (0, urls[0], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    rules = url_rules.RULES
    want = []
    for i, u, *_ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        want.append((i, host, path, best[2] if best else None, best[3] if best else "allow"))
    got = [tuple(r) for r in url_rules.judge(pages, url_rules.rule_table(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark)).count() == 0
    none = url_rules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), default="block").collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"block"}


def brute_hits(text, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, inside, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(span, len(v))
        grams = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else set()
        for a in range(len(w) - n + 1) if n else ():
            if tuple(w[a : a + n]) in grams:
                inside |= set(range(a, a + n))
                found.add(str(i))
    return len(w), len(inside), sorted(found)


@pytest.mark.parametrize("bits,bound", [(28, 10**6), (1, 0)])
def test_contamination(spark, bits, bound):
    """Also with a map so small that it tells nothing, and with all joins shuffled."""
    rnd = random.Random(8)
    word = lambda: rnd.choice(["un", "deux", "Trois", "vier", "fünf", "six7", "x"])
    items = [(i, " ".join(word() for _ in range(rnd.choice((3, 9, 10, 11, 25))))) for i in range(12)] + [(50, None), (51, "--- ..."), (None, "no id here at all"), (None, "nor here")]
    texts = [(i, ", ".join([word() for _ in range(rnd.randrange(30))] + (items[i % 12][1].split() if i % 3 else []) + [word() for _ in range(20)])) for i in range(30)] + [(100, None), (101, ""), (0, "x"), (None, items[3][1]), (200, "Nor, here!"), (7, items[4][1]), (7, items[4][1])]
    docs = spark.createDataFrame([(i, t, "q") for i, t in texts], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, map_bits=bits, max_broadcast_rows=bound).collect()
    want = [(i, *brute_hits(t, items)[:2], brute_hits(t, [x for x in items if x[0] is not None])[2]) for i, t in texts]
    assert sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in got), key=str) == sorted(want, key=str)
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_winnow_keeps_one_in_every_window():
    h = np.array([5, 3, 3, 9, 1, 7, 7, 7, 2, 8], np.uint64)
    kept = decontam.winnow(h, 4)
    assert all(any(a <= k < a + 4 for k in kept) for a in range(len(h) - 3))
    assert decontam.winnow(np.array([4, 4, 4, 4], np.uint64), 4).tolist() == [3]


def test_languages(spark):
    rnd = random.Random(2)
    make = {"aa": "abcdea", "bb": "vwxyzv"}
    rows = [(i, " ".join("".join(rnd.choice(make[n]) for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(1, 60))), n) for i, n in enumerate(["aa", "bb"] * 60)]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", "aa"), (None, "abca", None), (903, "abc abd" * 9000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lang_id.report(docs).collect()}
    assert sum(got[i].lang_pred == n for i, _, n in rows) >= 118
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[7].held_out == (zlib.crc32(b"7") % 4 == 2)
    assert {r.lang_pred for r in lang_id.identify(docs, docs.limit(0)).collect()} == {"und"}


def test_rank_order_distance():
    class R:
        def __init__(self, lang, place, code):
            self.lang, self.place, self.code = lang, place, code

    grams = lambda t: lang_id.ranked(*np.unique(lang_id.grams(t), return_counts=True), 5).tolist()
    rows = [R(n, k + 1, c) for n, t in (("aa", "abab abc"), ("bb", "xyxy xyz")) for k, c in enumerate(grams(t))]
    m = lang_id.Ranks(rows, 5)
    mine = grams("abab x")
    far = {n: sum(abs(k - [r.code for r in rows if r.lang == n].index(c)) if c in [r.code for r in rows if r.lang == n] else 5 for k, c in enumerate(mine)) for n in ("aa", "bb")}
    assert m.nearest("abab x") == (min(far, key=far.get), pytest.approx(1 - min(far.values()) / 25))


def test_line_field(spark):
    rnd = random.Random(4)
    good = lambda: "\n".join("".join(rnd.choice("etaoin") for _ in range(5)).capitalize() + " " + " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(12)) + "." for _ in range(rnd.randint(1, 6)))
    bad = lambda: "\n".join(" | ".join(["BUY!!"] * rnd.randint(3, 20)) for _ in range(rnd.randint(1, 6)))
    rows = [(i, good() if i % 3 else bad()) for i in range(150)]
    docs = spark.createDataFrame(rows + [(500, None), (501, ""), (None, good())], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i, _ in rows if i % 2 == 0] + [(None, 1, None), (499, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert len(got) == 153 and sum(got[i].predicted == int(i % 3 > 0) for i, _ in rows) >= 147
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[1].held_out == (zlib.crc32(b"1") % 3 == 1)
    none = quality.report(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}


def test_marginals_sum_over_all_labelings():
    rnd = np.random.default_rng(1)
    scores, pair = rnd.normal(size=(2, 4, 2)), rnd.normal(size=(2, 2))
    n = np.array([4, 3])
    good, pairs, total = quality.marginals(scores, pair, n)
    want_pairs = np.zeros((2, 2))
    for c in range(2):
        z, m = 0.0, np.zeros(n[c])
        own = np.zeros((2, 2))
        for code in range(2 ** n[c]):
            y = [(code >> k) & 1 for k in range(n[c])]
            w = np.exp(sum(scores[c, k, y[k]] for k in range(n[c])) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            z += w
            m += w * np.array(y)
            for a, b in zip(y, y[1:]):
                own[a, b] += w
        assert total[c] == pytest.approx(np.log(z)) and good[c, : n[c]] == pytest.approx(m / z)
        want_pairs += own / z
    assert pairs == pytest.approx(want_pairs)


def test_pages(spark):
    page = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>A &amp; B</h1><p>First   para\n<b>bold</b>face, with quite some words in it.<br>More of it here, and then some.<p>Second para: 1 &lt; 2 &copy; and a few more words to read.</article><div class="comments"><p>I like this page very much, thank you.</p></div><footer>&copy; all rights</footer></body></html>'
    rows = [(1, "u", page, "t"), (2, None, None, "t"), (3, "v", "", "t"), (None, "w", "plain < text & more", "t"), (1, "u", page, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    one = "A & B First para boldface, with quite some words in it. More of it here, and then some. Second para: 1 < 2 © and a few more words to read."
    assert [r.text for r in got if r.page_id == 1] == [one, one]
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == 5
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_held_out_pages_and_consistent_labels():
    rnd, trees, right, all_ = random.Random(123), html_text.model(), 0, 0
    for _ in range(60):
        html, main = html_text.sample_page(rnd)
        nodes = parse(html)
        keep = html_text.decode(nodes, trees.score(html_text.features(nodes)))
        assert all(keep[x.parent] or not k for x, k in zip(nodes[1:], keep[1:]))
        runs = [k for x, k in zip(nodes, keep) if not x.tag]
        right += sum((i in main) == k for i, k in enumerate(runs))
        all_ += len(runs)
    assert right / all_ > 0.96


KEY = b"k"


@given(st.integers(2, 10**12), st.data())
@settings(max_examples=100, deadline=None)
def test_permutation_inverts(size, data):
    x = data.draw(st.integers(0, size - 1))
    y = pii.permute(x, size, KEY, "t")
    assert 0 <= y < size and pii.permute(y, size, KEY, "t", back=True) == x


def test_permutation_is_one_to_one():
    assert sorted(pii.permute(x, 100, KEY, "t") for x in range(100)) == list(range(100))


def test_pseudonyms(spark):
    card, iban = "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"
    a = f"Mail été.12@mail.example.com or +1 (551) 555-0826, card {card}, ip 10.20.30.40, born 1984-02-29; token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\""
    b = f"Again (551) 555-0826 and 4111111111111111 and {iban}."
    clean = "Order 4111111111111112 of 2021-02-30, version 1.2.3, 300.1.1.1, page 3817, call 12-34."
    rows = [(1, a, 1), (2, b, 1), (3, clean, 1), (4, None, 1), (5, "", 1), (None, a, 1), (6, "z" * 100_000 + " x@y.example.org", 1)]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string, n_found int"), KEY).collect()}
    assert [f.kind for f in got[1].found] == ["mail", "phone", "card", "address", "date", "secret"]
    for secret in ("été.12@", "555-0826", card, "10.20.30.40", "1984-02-29", "b44e15"):
        assert secret not in got[1].text
    assert len(got[2].found) == 3 and got[3].text == clean and got[3].n_found == 0
    assert got[4].text is None and got[5].text == "" and got[None].text == got[1].text and got[6].n_found == 1
    digits = lambda t: re.sub(r"\D", "", t)
    new = re.search(r"card ([\d ]+),", got[1].text)[1]
    assert new[4] == " " and digits(new) in digits(got[2].text) and pii.luhn(digits(new)[:-1]) == int(digits(new)[-1])
    assert pii.iban_ok(re.search(r"GB[A-Z0-9 ]+", got[2].text)[0].strip().replace(" ", ""))
    for make, v in ((pii.card, card), (pii.iban, iban), (pii.phone, "551-555-0826"), (pii.social, "123-45-6789"), (pii.address, "1.2.3.4"), (pii.calendar, "02/13/1999"), (pii.calendar, "2000-02-29"), (pii.mail, "a.b9@x.org"), (pii.foreign_phone, "+49 30 1234567")):
        assert make(make(v, KEY), KEY, True) == v and make(v, KEY) != v


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("call +15551234567 now", "phone", "+15551234567"),
        ("call +1 5515550826.", "phone", "+1 5515550826"),
        ("call +4915123456789 now", "phone", "+4915123456789"),
        ("call +7 916 123-45-67 now", "phone", "+7 916 123-45-67"),
        ("call +79161234567 now", "phone", "+79161234567"),
        ("at 2024-01-05T10:00:00Z", "date", "2024-01-05"),
        ("on 3/4/2020,", "date", "3/4/2020"),
        ("on 3/14/2020,", "date", "3/14/2020"),
        ("on 14.3.2020", "date", "14.3.2020"),
        ("access_token = abcdef123456", "secret", "abcdef123456"),
        ("client_secret: abcdef123456", "secret", "abcdef123456"),
        ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG", "secret", "wJalrXUtnFEMI/K7MDENG"),
    ],
)
def test_forms_of_personal_data(text, kind, value):
    ((a, b, k, new),) = pii.find(text, KEY)
    assert (k, text[a:b]) == (kind, value) and new != value and len(new) == len(value)
    changed = text[:a] + new + text[b:]
    ((c, d, _, _),) = pii.find(changed, KEY)
    make = {"date": pii.calendar, "secret": pii.secret, "phone": pii.phone if value.startswith("+1") else pii.foreign_phone}[kind]
    assert changed[c:d] == new and make(new, KEY, True) == value


@pytest.mark.parametrize("text", ["mytoken = abcdef123456", "on 31/4/2020", "2024-01-05Tuesday", "+5 1 2 3", "13/13/2020"])
def test_forms_that_are_none(text):
    assert pii.find(text, KEY) == []


def best_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h), len(p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, default=(0, 0, "allow", None))[:1:-1]


def test_nested_rules_and_hot_hosts(spark):
    """Rules nested and side by side under one host, many pages of it in several sweeps, nothing broadcast."""
    rnd = random.Random(6)
    path = lambda n: "/" + "".join(rnd.choice("ab/é") for _ in range(rnd.randrange(n)))
    rules = sorted({(h, path(5)): (h, path(5), rnd.choice(("allow", "block"))) for h in ("com", "a.com", "b.a.com", "net") for _ in range(12)}.values())
    rules = [*rules, *((h, p, v) for (h, p), v in {("a.com", "/a"): "block", ("a.com", "/ab"): "allow", ("a.com", "/abb"): "block"}.items())]
    once = {(h, p): max(v for a, b, v in rules if (a, b) == (h, p)) for h, p, _ in rules}
    rules = [(h, p, v) for (h, p), v in once.items()]
    urls = [f"http://{rnd.choice(('com', 'a.com', 'x.a.com', 'b.a.com', 'y.b.a.com', 'net', 'org', 'aa.com'))}{path(9)}" for _ in range(400)] + ["http://a.com/ab" + "b" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [best_rule(u, rules) for u in urls]
    for bound in (10**6, 0):
        got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, url_rules.rule_table(spark, rules), share=20, max_broadcast_rows=bound).collect()}
        assert [got[i] for i in range(len(urls))] == want


def test_many_rules_of_one_host(spark):
    rules = spark.range(100_000).selectExpr("'example.com' as host", "concat('/', lpad(cast(id as string), 6, '0'), '/') as path", "if(id % 2 = 0, 'block', 'allow') as verdict")
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://www.example.com/', lpad(cast(id * 333 as string), 6, '0'), '/x') as url")
    got = url_rules.judge(pages, rules, default="none").collect()
    assert len(got) == 300 and all(r.rule == f"example.com/{r.page_id * 333:06d}/" and r.verdict == ("block" if r.page_id * 333 % 2 == 0 else "allow") for r in got)


def test_reader_keeps_words_whole():
    runs = lambda s: [x.text for x in parse(s) if not x.tag]
    for html, want in (
        ("<p>super<wbr>cali</p>", ["supercali"]), ("<p>b<img src=x>c</p>", ["bc"]), ("<p>a<script>x<p>y</p></script>b <x-y>c</x-y>d</p>", ["ab cd"]), ("<p>one</p><a title=it's>two</a>", ["one", "two"]),
        ('<div class="a>two</div>', ["two"]), ("<p>x<svg><text>no</text></svg>y</p>", ["xy"]), ("<head><title>t</title><body>hello", ["hello"]), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]), ("<p>1 < 2 &amp; 3<br>x</p", ["1 < 2 & 3 x"]),
    ):
        assert runs(html) == want, html


def test_deep_pages_take_linear_time():
    import time

    for unit, end in (("<div>", "</div>"), ("<p><div>", ""), ("<ul><li>", ""), ("<b><i>", ""), ("<td>", ""), ("<svg>", "")):
        began = time.time()
        assert parse(unit * 100_000 + "x" + end * 100_000)[-1].text == "x"
        assert time.time() - began < 30


def test_pages_without_telling_attributes():
    """Pages of the composer without any attribute, and with words that WORDS doesn't have."""
    trees = html_text.model()
    for put in ("", ' class="qx zab"'):
        rnd, right, all_ = random.Random(77), 0, 0
        for _ in range(60):
            html, main = html_text.sample_page(rnd)
            nodes = parse(re.sub(r' (class|id)="?[^">]*"?', put, html))
            keep = html_text.decode(nodes, trees.score(html_text.features(nodes)))
            runs = [k for x, k in zip(nodes, keep) if not x.tag]
            right, all_ = right + sum((i in main) == k for i, k in enumerate(runs)), all_ + len(runs)
        assert right / all_ > 0.94


def test_a_text_of_many_lines_is_one_chain():
    model = quality.Model(np.random.default_rng(0).normal(size=quality.DIM) * 0.1, np.array([[0.5, -0.5], [-0.5, 0.5]]))
    long = "\n".join(f"line {i} of it." for i in range(20_000))
    together = model.score([long, *["a b\nc"] * 63, None, ""])
    alone = np.concatenate([model.score([t]) for t in (long, "a b\nc", None, "")])
    assert np.allclose(together[[0, 1, 64, 65]], alone) and together[64] == together[65]


SF = "/root/testdata/sf0.01"


def test_held_out_languages_and_labels(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r.lang_pred == lang[r.doc_id] for r in lang_id.report(docs).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(got) > 200 and np.mean(got) >= 0.99
    mark = {r.doc_id: r.quality for r in labels.collect()}
    got = [r.predicted == mark[r.doc_id] for r in quality.report(docs, labels).collect() if r.held_out and r.doc_id in mark]
    assert len(got) > 100 and np.mean(got) >= 0.98


def plain_finds(text):
    """What the documents' own forms of personal data look like, found word by word."""
    words = re.split(r"(\s+)", text)
    for i, w in enumerate(words):
        bare = w.strip('.,;:"|')
        if re.fullmatch(r"\S+@\S+\.[a-z]+", bare):
            yield bare
        elif re.fullmatch(r"\d{16}", bare) and bare[0] == "4" and pii.luhn(bare[:-1]) == int(bare[-1]):
            yield bare
        elif re.fullmatch(r"\d+(\.\d+){3}", bare) and all(int(p) < 256 and p == str(int(p)) for p in bare.split(".")):
            yield bare
        elif re.fullmatch(r"[0-9a-f]{40}", bare):
            yield bare
        elif w == "+1" and i + 4 < len(words):
            yield "".join(words[i : i + 5]).rstrip('.,;:"|')


def test_personal_data_of_the_documents(spark):
    docs = common.table(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    hit = clean = 0
    for r in pii.pseudonymize(docs, KEY).collect():
        want = list(plain_finds(text[r.doc_id] or ""))
        assert all(w not in r.text for w in want)
        clean, hit = clean + (not want), hit + (not want and r.n_found > 0)
    assert clean > 500 and hit / clean < 0.01


def test_one_value_in_all_its_forms():
    same = lambda make, forms, of: len({of(make(f, KEY)) for f in forms}) == 1
    digits = lambda t: re.sub(r"\D", "", t)[-10:]
    day = lambda t: tuple(sorted(map(int, re.split("[-/.]", t))))
    assert same(pii.phone, ["(123) 456-7890", "+1 (123) 456-7890", "+11234567890", "123-456-7890"], digits)
    assert same(pii.calendar, ["2001-05-13", "13.05.2001", "05/13/2001", "13/5/2001"], day) and same(pii.calendar, ["3/4/2020", "2020-04-03"], day)
    assert same(pii.mail, ["A.b9@X.org", "a.B9@x.ORG"], str.lower)
    assert pii.find("password: required, token: yesterday, Version 1.2.3.4, published 2020-01-02", KEY) == []


def test_parts_of_token_files_grow_with_the_corpus():
    count = token_files.part_count
    assert count(0) == 1 and count(8 << 20) == 1 and count((8 << 20) + 1) == 2
    assert count(100 * (1 << 40)) == count(10_000 * (1 << 40)) == token_files.MAX_PARTS


def test_huffman_codes_are_made_at_once():
    """A coder is made for each part of a corpus; it takes less than one loop over the symbols."""
    import time

    rnd = np.random.default_rng(4)
    symbols = np.sort(rnd.choice(60_000, 50_000, replace=False))
    bits = huffman.code_lengths(rnd.integers(1, 100_000, 50_000), 16)

    def looped():
        codes, code, last, table = {}, 0, 0, np.zeros(1 << int(bits.max()), np.int64)
        for k in np.lexsort((symbols, bits)).tolist():
            code, last = code << int(bits[k]) - last, int(bits[k])
            codes[int(symbols[k])] = code
            table[code << int(bits.max()) - last : (code + 1) << int(bits.max()) - last] = int(symbols[k]) << 5 | last
            code += 1
        return codes, table

    def quickest(f):
        out = []
        for _ in range(5):
            began = time.process_time()
            got = f()
            out.append(time.process_time() - began)
        return min(out), got

    slow, (codes, table) = quickest(looped)
    fast, coder = quickest(lambda: huffman.Coder(symbols, bits))
    assert {s: int(coder.code[s]) for s in codes} == codes and (coder.table == table).all()
    assert fast < slow / 3
    one = huffman.Coder(np.array([7]), np.array([1]))
    ids = np.full(100, 7)
    assert (one.decode(*one.encode(ids), 100) == ids).all()
    assert len(huffman.Coder(np.zeros(0, np.int64), np.zeros(0, np.int64)).table) == 2


KINDS = "ab Z's'tmdrevl12 \n\t\r!?.é×÷ÿɏ«‐⁞₠"


@given(st.lists(st.text(alphabet=st.sampled_from(list(KINDS)), max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_pieces_are_those_of_the_librarys_pattern(texts):
    data = np.frombuffer("\0".join([*texts, ""]).encode(), np.uint8)
    at = [*tokens.splits(data).tolist(), len(data)] if texts else []
    cut = tokens.encoder(PATH).tokenizer.pre_tokenizer.pre_tokenize_str
    want = [p for t in texts for p in [*(t[a:b].encode() for _, (a, b) in cut(t)), b"\0"]]
    assert [data[a:b].tobytes() for a, b in zip(at, at[1:])] == want


def test_encoder_begins_new_memories_and_cuts_long_texts(monkeypatch):
    for name, value in (("CHARS", 7), ("MAX_WORDS", 40), ("MAX_IDS", 100)):
        monkeypatch.setattr(tokens, name, value)
    rnd, e = random.Random(3), tokens.Encoder(PATH)
    for _ in range(30):
        texts = ["".join(rnd.choices(KINDS + "²你", [9] * len(KINDS) + [1, 1], k=rnd.randrange(60))) for _ in range(20)]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.ids(texts)] == [library_ids(t, e.tokenizer) for t in texts]
    assert len(e.known.number) + len(e.older.number) < 600


def test_known_words_cost_less_than_a_pattern():
    """Pieces are cut, told apart and given their ids in less time than it takes to list them by a pattern."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("etaoinshr", k=rnd.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=400)) + ".\n" for _ in range(600)]
    pattern = re.compile(f" [{tokens.LETTERS}]++|[{tokens.LETTERS}]++| ?[^ \t\n\r0-9{tokens.LETTERS}]++|[ \t\n\r]+")
    e = tokens.Encoder(PATH)
    e.ids(texts)

    def least(f):
        took = []
        for _ in range(5):
            t = time.process_time()
            f()
            took.append(time.process_time() - t)
        return min(took)

    assert least(lambda: e.ids(texts)) < least(lambda: [pattern.findall(t) for t in texts])
