"""Logs read from files: order of lines, counters, days, and recordings in text logs."""

import json

from pyspark.sql import functions as F

from tidemark.sources import logs

DAY = 86_400_000


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def sample(ms, keys=1.0, **more):
    return json.dumps({"epoch_ms": ms, "keys_per_s": keys, "clicks_per_s": 2, "mouse_vel_px_s": 3.5} | more)


def test_lines_keep_their_order_in_split_files(spark, tmp_path):
    write(tmp_path / "in/a.txt", [f"line {n} {'x' * (n % 50)}" for n in range(4000)])
    write(tmp_path / "in/b.txt", ["only"])
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = logs.numbered(logs.files(spark, str(tmp_path / "in"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    a = sorted((r for r in got if r.file.endswith("a.txt")), key=lambda r: r.number)
    assert [int(r.line.split()[1]) for r in a] == list(range(4000)) and [r.number for r in a] == list(range(1, 4001)) and len(got) == 4001


def test_samples_of_one_recording_out_of_daily_files(spark, tmp_path):
    start = 1_700_000_000_000 - 1_700_000_000_000 % DAY + DAY // 2
    write(tmp_path / "in/machine=1/day=2023-11-14/log.jsonl", [sample(start - 1), sample(start), sample(start + 500, 4), "", "{", sample(start, "x"), sample(True), sample(start, None)])
    write(tmp_path / "in/machine=1/day=2023-11-15/log.jsonl", [sample(start + DAY // 2 + 7), sample(start + DAY), sample(start + DAY + 1)])
    write(tmp_path / "in/machine=1/day=2023-11-17/log.jsonl", [sample(start + 3 * DAY)] * 5)
    write(tmp_path / "in/machine=2/day=2023-11-14/log.jsonl", [sample(start)])
    recordings = spark.createDataFrame([(1, start, 86_400.0)], "machine int, anchor long, duration double")
    lines = logs.cut(logs.files(spark, str(tmp_path / "in")), recordings, "machine", "day", "anchor", "duration")
    rows, seen = logs.observed(logs.input_samples(lines, "line", "anchor", "duration"), "samples", ("kept", "before", "after", "malformed", "blank"))
    kept = sorted((r.t, r.rate, r.velocity) for r in rows.where("state = 'kept'").collect())
    assert kept == [(0.0, 3.0, 3.5), (0.5, 6.0, 3.5), (43_200.007, 3.0, 3.5), (86_400.0, 3.0, 3.5)]
    assert seen.get == {"lines": 11, "kept": 4, "before": 1, "after": 1, "malformed": 4, "blank": 1}


def test_live_files_give_what_the_batch_gives(spark, tmp_path):
    for n in range(3):
        write(tmp_path / f"in/{n}.jsonl", [sample(1_700_000_000_000 + k * 100 + n, k) for k in range(20)] + ["{"])
    parsed = lambda df: logs.input_samples(df.withColumn("anchor", F.lit(1_700_000_000_000)).withColumn("duration", F.lit(1.0)), "line", "anchor", "duration").select("t", "rate", "state")
    out = []
    live = logs.files(spark, str(tmp_path / "in"), live=True)
    q = parsed(live).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = parsed(logs.files(spark, str(tmp_path / "in"))).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, want), key=str) and len(out) == 63


def test_recordings_and_their_paths(spark):
    said = ["path /early", "path /late", "start", "stop", "stop", "start", "path /inside", "start", "path /third", "nothing", "path /fourth", "stop", "path /lost"]
    rows = [("f", n, w.split()[0], (w.split() + [None])[1], None if n == 20 else float(n)) for n, w in enumerate(said)] + [("g", 0, "stop", None, 1.0), ("g", 1, "start", None, None), ("g", 2, "start", None, 5.0)]
    df = spark.createDataFrame(rows, "file string, number int, what string, value string, clock double")
    got = sorted(tuple(r) for r in logs.recorded(df, "file", "number").collect())
    assert got == [("f", 1, 2.0, 3.0, "/late"), ("f", 2, 5.0, None, "/inside"), ("f", 3, 7.0, 11.0, "/fourth"), ("g", 1, 5.0, None, None)]
