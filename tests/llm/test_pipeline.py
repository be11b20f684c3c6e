"""Each stage of the pipeline against plain Python over the stage's own input."""

from test_near_dup import brute, family
from test_corpus_operators import brute_hits, norm

import corpus_pipeline as P
from tidemark.llm import decontam, exact_dedup, near_dup, quality
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stage = dict(P.STAGES)
    assert list(stage) == ["quality", "exact_dedup", "near_dup", "decontam", "packing"]

    scored = {r.doc_id: r.predicted for r in quality.report(docs, table(spark, SF, "labels")).collect()}
    kept = stage["quality"](spark, docs, SF)
    assert kept.columns == columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) == {i for i, p in scored.items() if p == 1}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert sum(labels[i] == scored[i] for i in labels if i in scored) >= 0.97 * len(labels)

    once = stage["exact_dedup"](spark, kept, SF)
    first = {}
    for i in sorted(rows):
        first.setdefault(norm(rows[i]), i)
    assert once.columns == columns and {r.doc_id for r in once.collect()} == set(first.values())

    apart = stage["near_dup"](spark, once, SF)
    left = [(i, rows[i]) for i in sorted(first.values())]
    want = {i for i, (_, c) in brute(left, 80).items() if c == i}
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == want

    clean = stage["decontam"](spark, apart, SF)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = {i for i in want if not brute_hits(rows[i], items)[2]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want

    packed = stage["packing"](spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == want
    seqs = {}
    for r in packed:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 1024
    assert len(seqs) <= -(-sum(r.length for r in packed) // 1024) + 2


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def clean_and_bad(spark, good, other, bad, more=()):
    """A bad and a clean text under no id, the same under one id, and other rows; and what is to stay."""
    data = [(None, bad), (None, good), (90_001, bad), (90_001, other), *more]
    return spark.createDataFrame(data, "doc_id long, text string"), sorted([(None, good), (90_001, other), *more], key=str)


def test_quality_drops_rows_not_ids(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    text = {r.doc_id: r.text for r in docs.collect()}
    order = [text[r.doc_id] for r in quality.report(docs, labels).orderBy("score", "doc_id").collect()]
    more, want = clean_and_bad(spark, order[-1], order[-2], order[0])
    assert [x for x in left(quality.drop_bad(docs.unionByName(more), labels)) if x[0] in (None, 90_001)] == want


def test_exact_copies_drop_rows_not_ids(spark):
    docs, want = clean_and_bad(spark, "nobody else has this", "nor this", "a  b", [(1, "a b")])
    assert left(exact_dedup.drop_copies(docs)) == want


def test_near_copies_drop_rows_not_ids(spark):
    a, b, c = (family(seed, 1)[0][1] for seed in (11, 12, 13))
    docs, want = clean_and_bad(spark, b, c, a, [(1, a)])
    assert left(near_dup.drop_near_copies(docs)) == want


def test_near_copies_of_two_texts_of_one_id_stay_apart(spark):
    a, b = (family(seed, 1)[0][1] for seed in (11, 12))
    data = [(3, a), (7, a + " more"), (7, b + " more"), (9, b)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_dup(docs).collect()) == [(3, 3, True), (7, 3, False), (7, 7, True), (9, 7, False)]
    assert left(near_dup.drop_near_copies(docs)) == [(3, a), (7, b + " more")]


def test_contamination_drops_rows_not_ids(spark):
    passage = " ".join(f"word{i}" for i in range(14))
    items = spark.createDataFrame([("q", passage)], "item_id string, text string")
    docs, want = clean_and_bad(spark, "nothing of it", "nor of it", f"so {passage} then")
    assert left(decontam.drop_contaminated(docs, items)) == want


def test_of_repeated_rows_one_stays(spark):
    a, b = (family(seed, 1)[0][1] for seed in (11, 12))
    data = [(1, a)] * 3 + [(2, a), (7, "x y"), (7, "x  y"), (7, "x y"), (8, b), (8, b), (9, ""), (9, ""), (None, "n o"), (None, "n o"), (None, b + " more")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = left(exact_dedup.drop_copies(docs))
    assert len(got) == 6 and {(i, (t or "").replace("  ", " ")) for i, t in got} == {(1, a), (7, "x y"), (8, b), (9, ""), (None, "n o"), (None, b + " more")}
    near = left(near_dup.drop_near_copies(docs))
    # Rows without an id take part only through an equal text.
    assert [i for i, _ in near].count(1) == 1 and [i for i, _ in near].count(8) == 1 and near.count((None, b + " more")) == 1


def test_stages_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
