import random

import duckdb
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import aggregates as A
from tidemark.operators import graphs as G
from tidemark.operators import joins as J
from tidemark.operators import peaks, recursive
from tidemark.operators.groups import each_group


def test_groups_over_several_batches(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice((None, "a", "b", "c")), rnd.randrange(3), k, rnd.choice((None, rnd.random()))) for k in range(500)]
    df = spark.createDataFrame(rows, "name string, n long, i long, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        run = lambda key, c: [(*key, c["i"].tolist(), c["x"].tolist()[0])]
        got = each_group(df, ["name", "n"], ["i"], run, "name string, n long, i array<long>, x double").collect()
        assert each_group(df.limit(0), ["name"], ["i"], run, "name string, i array<long>, x double").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for name, n, i, x in rows:
        want.setdefault((name, n), ([], x))[0].append(i)
    assert len(got) == len(want) and {(r.name, r.n): (r.i, r.x) for r in got} == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_groups_make_no_frames_of_their_own(spark):
    n = spark.createDataFrame([(1, "a", 0)], "graph long, node string, rank long")
    e = spark.createDataFrame([(1, "a", "a")], "graph long, node string, needs string")
    s = spark.range(40).select(F.lit(1).cast("long").alias("recording_id"), F.lit("p").alias("profile"), F.col("id").alias("i"), F.sin("id").alias("composite"))
    sections = recursive.band_sections(2, 0.2, 0.5, 2.0)
    made = [G.topological_order(n, e), peaks.candidates(s, 1.0, 1, 5, 1.0, 9.0, 2.0), recursive._pass(s.select("recording_id", "i", F.col("composite").alias("x")), ["recording_id"], "i", sections, 16, -1)]
    for df in made:
        assert "InPandas" not in plan(df) and df.count() > 0


def test_boxes_against_all_pairs(spark):
    rnd = random.Random(6)
    few = [(rnd.randrange(40), rnd.randrange(40), rnd.randrange(0, 12), rnd.randrange(1, 12)) for _ in range(12)]
    rows = [(rnd.choice("gh"), k, *rnd.choice(few)) for k in range(160)] + [(None, 900, 1, 1, 5, 5), ("g", 901, 1, 1, None, 5)]
    df = spark.createDataFrame(rows, "g string, id long, x int, y int, w int, h int")
    got = sorted(map(tuple, J.overlapping_boxes(df, "g", "id", "x", "y", "w", "h", 7, block=3, parts=4).collect()))
    want = []
    for a in rows[:160]:
        for b in rows[:160]:
            (g, i, x, y, w, h), (k, j, u, v, p, q) = a, b
            if g == k and i < j and x < u + p and u < x + w and y < v + q and v < y + h:
                want.append((i, j, (min(x + w, u + p) - max(x, u)) * (min(y + h, v + q) - max(y, v))))
    assert len(want) > 500 and got == sorted(want)


def test_a_bucket_of_boxes_is_shared_among_tasks(spark):
    df = spark.createDataFrame([("g", k, 3, 4, 2, 2) for k in range(400)], "g string, id long, x int, y int, w int, h int")
    got = J.overlapping_boxes(df, "g", "id", "x", "y", "w", "h", 7, block=10, parts=8)
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 400 * 399 // 2 and max(tasks) < sum(tasks) / 2
    assert got.distinct().count() == sum(tasks) and got.where("id < other and area = 4").count() == sum(tasks)
    assert J.overlapping_boxes(df, "g", "id", "x", "y", "w", "h", 7, parts=8, each=10_000).rdd.getNumPartitions() >= 16


def test_parts_grow_with_the_rows(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 50)
    assert J.dealt(df, ["k"], 5_000_001).rdd.getNumPartitions() == 21
    x = df.select("k", F.col("id").alias("a"), F.col("id").alias("b"), "id")
    assert A.rank_agreement(x, ["k"], "a", "b", 1, "id").count() == 50


def test_files_without_a_directory_count_by_name(spark, tmp_path):
    spark.createDataFrame([(1, None), (51, 3), (101, 2), (2, 4), (151, 7)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1,), (51,), (51,), (2,), (3,), (None,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(map(tuple, plans.queries()["m10_located"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(plans.oracle_sql()["m10_located"]).fetchall(), key=str)
