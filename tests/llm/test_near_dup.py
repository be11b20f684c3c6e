import random
import re

import pytest

from tidemark.llm import near_dup


def word_sets(rows, k=5):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute(rows, percent):
    sets = word_sets(rows)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed, n, words=60, base=0):
    """Texts that come of one another by a few edits, so that some are like the first and some only like one another."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = [[word() for _ in range(words)]]
    for _ in range(n - 1):
        t = list(rnd.choice(texts[:1] if rnd.random() < 0.5 else texts))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
            kind, at = rnd.random(), rnd.randrange(len(t))
            if kind < 0.6:
                t[at] = word()
            elif kind < 0.8:
                del t[at]
            else:
                t.insert(at, word())
        texts.append(t)
    return [(base + i, " ".join(t).upper() if i % 7 == 0 else " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent,bands,rows", [(85, 21, 6), (80, 25, 5)])
def test_components_are_those_of_all_pairs(spark, percent, bands, rows):
    data = family(1, 120) + family(2, 60, 200, 1000) + family(3, 40, 12, 2000)
    data += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one two"), (5004, "One\ttwo"), (5005, "one two three")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_dup(docs, percent=percent, bands=bands, rows=rows).collect()}
    assert got == brute(data, percent)


def test_shuffled_joins_give_the_same(spark):
    data = family(4, 50)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_dup(docs, max_broadcast_rows=0).collect()}
    assert got == brute(data, 85)


def test_odd_rows(spark):
    data = [(3, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "A b c d e f", 3), (None, "x y z q r s", 4), (7, "lone words here that nobody else has", 5), (7, "lone words here that nobody else has", 6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_shingles long")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_dup(docs).collect()), key=str)
    assert got == sorted([(3, 1, False), (1, 1, True), (None, 1, False), (None, None, True), (7, 7, True), (7, 7, True)], key=str)
    assert near_dup.near_dup(docs.limit(0)).count() == 0
    kept = near_dup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 7]


def test_one_bucket_of_many_unlinked_texts(spark):
    """Texts alike in half of their shingles share buckets but no link; among them a few pairs that are linked with one another, not with the leader."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    common = [word() for _ in range(60)]
    texts = [common + [word() for _ in range(45)] for _ in range(150)]
    texts += [t[:-1] + [word()] for t in texts[100:120]] + [t[:-3] + [word()] for t in texts[110:125]]
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    # Bands of one coordinate put nearly all texts into common buckets.
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_dup(docs, bands=40, rows=1).collect()}
    assert got == brute(data, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_one_bucket_of_near_copies_with_uneven_edits(spark, percent):
    """Many copies of one text, edited too much or just not too much to be linked with it, at places that some of them share."""
    rnd = random.Random(percent)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    first = [word() for _ in range(100)]
    shared = [(rnd.randrange(100), word()) for _ in range(8)]
    texts = [first]
    for n in range(160):
        t = list(first)
        for at, w in rnd.sample(shared, rnd.randrange(5)) + [(rnd.randrange(100), word()) for _ in range(rnd.randrange(4))]:
            t[at] = w
        texts.append(t[: 100 - rnd.randrange(12)] if n % 5 == 0 else t + [word() for _ in range(rnd.randrange(8))] if n % 5 == 1 else t)
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_dup(docs, percent=percent, bands=40, rows=1).collect()}
    assert got == brute(data, percent)


@pytest.mark.parametrize("bands,rows", [(1, 1), (40, 1)])
def test_repeated_rows_and_ids_change_no_component(spark, bands, rows):
    """Every row three times over, and an id under two texts: a bucket's prefixes must not be used up by repeats."""
    first, rnd = family(21, 1, 100)[0][1].split(), random.Random(4)
    shared = [(rnd.randrange(100), w) for w in ("qqqq", "rrrr", "ssss", "tttt", "uuuu", "vvvv")]
    data = []
    for n in range(40):
        t = list(first)
        for at, w in rnd.sample(shared, rnd.randrange(1, 5)) + [(rnd.randrange(100), f"w{n}") for _ in range(rnd.randrange(3))]:
            t[at] = w
        data.append((n, " ".join(t)))
    once = {r.doc_id: r.component_id for r in near_dup.near_dup(spark.createDataFrame(data, "doc_id long, text string"), bands=bands, rows=rows).collect()}
    if bands > 1:
        assert once == {i: c for i, (_, c) in brute(data, 85).items()}
    thrice = near_dup.near_dup(spark.createDataFrame(data * 3, "doc_id long, text string"), bands=bands, rows=rows).collect()
    assert len(thrice) == 120 and {r.doc_id: r.component_id for r in thrice} == once
    other = [*data * 2, *((i, f"another text under the id {i} " + " ".join(f"x{i}y{k}" for k in range(30))) for i, _ in data)]
    got = near_dup.near_dup(spark.createDataFrame(other, "doc_id long, text string"), bands=bands, rows=rows).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted([*once.items()] * 2 + [(i, i) for i in once])
