"""Commits, incremental tables and generations of scores."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ledger as L
from tidemark.sources.scratch import new_path


@pytest.fixture
def ledger(spark):
    return L.Ledger(spark, new_path(spark, "ledger"))


def source(spark, rows):
    return spark.createDataFrame(rows, "k long, v long")


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_what_moved_is_computed_again(spark, ledger):
    seen = []

    def total(rows):
        seen.append(sorted(r.k for r in rows.select("k").distinct().collect()))
        return rows.groupBy("k").agg(F.sum("v").alias("total"))

    refresh = lambda params=1: ledger.refresh("totals", ["raw"], "k", params, total)
    assert refresh() is None and ledger.read("totals", "k") is None
    ledger.put("raw", source(spark, [(1, 1), (1, 2), (2, 5), (3, 7)]), "k")
    assert refresh() == 2 and seen == [[1, 2, 3]] and told(ledger.read("totals", "k")) == [(1, 3), (2, 5), (3, 7)]
    assert refresh() is None and len(seen) == 1
    ledger.put("raw", source(spark, [(2, 6), (4, 1)]), "k")
    assert refresh() == 4 and seen[-1] == [2, 4] and told(ledger.read("totals", "k")) == [(1, 3), (2, 6), (3, 7), (4, 1)]
    # The files of keys that didn't move aren't read.
    reads = ledger.read("raw", "k", source(spark, [(4, 0)])).inputFiles()
    part = ledger.commits()[2]["part"]
    assert all(part in f for f in reads if "/rows/" in f)
    assert refresh(2) == 5 and seen[-1] == [1, 2, 3, 4]  # other settings
    fresh = source(spark, [(1, 1), (1, 2), (2, 6), (3, 7), (4, 1)]).groupBy("k").agg(F.sum("v").alias("total"))
    assert told(ledger.read("totals", "k")) == told(fresh)


def test_a_run_that_dies_changes_nothing_and_is_run_again(spark, ledger):
    ledger.put("raw", source(spark, [(1, 1)]), "k")
    double = lambda rows: rows.select("k", (F.col("v") * 2).alias("w"))
    ledger.refresh("twice", ["raw"], "k", 1, double)
    ledger.put("raw", source(spark, [(1, 5)]), "k")

    def dies(rows):
        return double(rows).select("k", F.raise_error(F.lit("lost")).cast("long").alias("w"))

    with pytest.raises(Exception, match="lost"):
        ledger.refresh("twice", ["raw"], "k", 1, dies)
    ledger._commit, kept = (lambda *a: (_ for _ in ()).throw(RuntimeError("before the flip"))), ledger._commit
    with pytest.raises(RuntimeError, match="flip"):
        ledger.refresh("twice", ["raw"], "k", 1, double)
    ledger._commit = kept
    assert told(ledger.read("twice", "k")) == [(1, 2)]
    assert ledger.refresh("twice", ["raw"], "k", 1, double) == 4 and told(ledger.read("twice", "k")) == [(1, 10)]


def test_of_two_writers_one_is_told(spark, ledger):
    ledger.put("raw", source(spark, [(1, 1)]), "k", after=0)
    with pytest.raises(L.Conflict):
        ledger.put("raw", source(spark, [(1, 2)]), "k", after=0)
    assert told(ledger.read("raw", "k")) == [(1, 1)]


def test_keys_that_end_empty_go_out(spark, ledger):
    ledger.put("raw", source(spark, [(1, 1), (2, -1)]), "k")
    positive = lambda rows: rows.where("v > 0")
    ledger.refresh("positive", ["raw"], "k", 1, positive)
    assert told(ledger.read("positive", "k")) == [(1, 1)] and ledger.refresh("positive", ["raw"], "k", 1, positive) is None
    ledger.put("raw", source(spark, [(1, -3), (2, 4)]), "k")
    ledger.refresh("positive", ["raw"], "k", 1, positive)
    assert told(ledger.read("positive", "k")) == [(2, 4)]


def test_generations_and_what_ratings_do_to_them(spark):
    scores = L.Scores(spark, new_path(spark, "scores"))
    windows = lambda shift: spark.createDataFrame([(r, t + shift, t + shift + 10) for r in (1, 2) for t in (0.0, 100.0)], "recording_id long, t_start double, t_end double")
    current = lambda: sorted((r.recording_id, r.generation, r.t_start) for r in scores.candidates().where("is_current").collect())
    scores.score(windows(0.0), "a", 50.0)
    scores.score(windows(1.0), "a", 50.0)
    assert current() == [(r, 1, t) for r in (1, 2) for t in (1.0, 101.0)] and scores.candidates().count() == 4  # nothing was rated: the same again
    one = scores.candidates().where("is_current and recording_id = 1 and t_start = 101").select("id", F.lit(2).alias("rating"))
    scores.rate(one)
    scores.score(windows(2.0), "a", 50.0)
    # Where a rating was, a new generation has it passed on, and the old one stays.
    assert current() == [(1, 2, 2.0), (1, 2, 102.0), (2, 1, 2.0), (2, 1, 102.0)] and scores.candidates().count() == 6
    rated = scores.candidates().join(scores.ratings(), "id")
    assert sorted((r.recording_id, r.generation, r.t_start, r.rating, r.source) for r in rated.collect()) == [(1, 1, 101.0, 2, "operator"), (1, 2, 102.0, 2, "inherited")]
    before = current()
    scores.ledger._commit, kept = (lambda *a: (_ for _ in ()).throw(RuntimeError("before the flip"))), scores.ledger._commit
    with pytest.raises(RuntimeError, match="flip"):
        scores.score(windows(3.0), "b", 50.0)
    scores.ledger._commit = kept
    assert current() == before
    scores.score(windows(3.0), "b", 50.0)
    assert current() == [(1, 3, 3.0), (1, 3, 103.0), (2, 2, 3.0), (2, 2, 103.0)]
    assert scores.candidates().join(scores.ratings(), "id").where("is_current").count() == 1
