"""Line-based logs: marker presses, input rates, and text logs classified by patterns. What falls out is counted by reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_MS_FLOOR = 1_577_836_800_000


def relative_seconds(ms: Column, anchor_ms: Column) -> Column:
    return (ms - anchor_ms) / F.lit(1000.0)


def anchor_state(anchor: Column) -> Column:
    """Of a JSON anchor: ok, or what is wrong with it. Milliseconds before 2020 are taken for seconds."""
    a = F.from_json(anchor, "schema int, record_start_epoch_ms long")
    ms = a["record_start_epoch_ms"]
    return F.when(a.isNull() | ms.isNull(), "malformed").when(F.coalesce(a["schema"], F.lit(-1)) != 1, "unknown schema").when(ms < EPOCH_MS_FLOOR, "seconds, not milliseconds").otherwise("ok")


def markers(lines: DataFrame, line: str, anchor: str, duration: str, kinds: tuple[str, ...] = ("marker_maybe", "marker_definite")) -> DataFrame:
    """Adds t, kind and state: blank, malformed, unknown kind, before, after, or kept. Out-of-range presses are dropped, not clamped."""
    j = F.from_json(F.col(line), "epoch_ms long, kind string", {"mode": "PERMISSIVE"})
    t = relative_seconds(j["epoch_ms"], F.col(anchor))
    state = (
        F.when(F.trim(line) == "", "blank").when(j["epoch_ms"].isNull(), "malformed").when(~F.coalesce(j["kind"], F.lit("")).isin(*kinds), "unknown kind").when(t < 0, "before").when(t > F.col(duration), "after").otherwise("kept")
    )
    return lines.withColumn("kind", j["kind"]).withColumn("t", t).withColumn("state", state)


def classified(lines: DataFrame, key: str, order: str, line: str, patterns: dict[str, str]) -> DataFrame:
    """Adds what (the first pattern that fits, else none), its first group, the line's clock in seconds (null if it has none), and the last path seen before."""
    what = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        fits = F.regexp_like(line, F.lit(p))
        what, value = F.when(fits, name).otherwise(what), F.when(fits, F.regexp_extract(line, p, 1)).otherwise(value)
    clock = F.regexp_extract(line, r"^(\d+):(\d+):(\d+(?:\.\d+)?)", 0)
    part = lambda k: F.regexp_extract(line, r"^(\d+):(\d+):(\d+(?:\.\d+)?)", k).try_cast("double")
    out = lines.withColumn("what", what).withColumn("value", value).withColumn("clock", F.when(clock != "", part(1) * 3600 + part(2) * 60 + part(3)))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("path", F.last(F.when(F.col("what") == "path", F.col("value")), ignorenulls=True).over(w))


def files(spark: SparkSession, path: str, live: bool = False) -> DataFrame:
    """Lines of text logs under path, with the file they are in and the columns that its folders name (`machine=7/day=2024-01-05/`).

    place orders the lines of a file: the byte where the part that a task reads begins, then the line's order in it. live: files are read as they come, without a place.
    """
    read = (spark.readStream if live else spark.read).option("recursiveFileLookup", "false")
    rows = read.schema("value string").text(path) if live else read.text(path)
    at = [] if live else [F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place")]
    return rows.select(F.col("value").alias("line"), *(c for c in rows.columns if c != "value"), F.col("_metadata.file_path").alias("file"), *at)


def numbered(lines: DataFrame) -> DataFrame:
    """Adds number, from 1 in each file."""
    return lines.withColumn("number", F.row_number().over(Window.partitionBy("file").orderBy("place")))


def input_samples(lines: DataFrame, line: str, anchor: str, duration: str) -> DataFrame:
    """Adds t, rate (keys and clicks a second), velocity and state: blank, malformed, before, after or kept. What lies outside the recording is dropped, not clamped."""
    j = F.from_json(F.col(line), "epoch_ms long, keys_per_s double, clicks_per_s double, mouse_vel_px_s double")
    t, rate = relative_seconds(j["epoch_ms"], F.col(anchor)), j["keys_per_s"] + j["clicks_per_s"]
    state = F.when(F.trim(line) == "", "blank").when(j["epoch_ms"].isNull(), "malformed").when(t < 0, "before").when(t > F.col(duration), "after").when(rate.isNull() | j["mouse_vel_px_s"].isNull(), "malformed").otherwise("kept")
    return lines.withColumn("t", t).withColumn("rate", rate).withColumn("velocity", j["mouse_vel_px_s"]).withColumn("state", state)


def observed(rows: DataFrame, name: str, states: tuple[str, ...]) -> tuple[DataFrame, Observation]:
    """rows, and how many of each state come by when they are read, without a second pass."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("lines"), *(F.count_if(F.col("state") == s).alias(s) for s in states)), seen


def cut(lines: DataFrame, recordings: DataFrame, key: str, day: str, anchor: str, duration: str) -> DataFrame:
    """Lines of daily files (key and day are folder names) beside each recording of the key that reaches into the day, so that files of other days aren't read."""
    at = lambda ms: F.to_date(F.timestamp_millis(ms))
    last = (F.col(anchor) + F.col(duration) * 1000).cast("long")
    wanted = recordings.withColumn(day, F.explode(F.sequence(at(F.col(anchor)), at(last))))
    return lines.withColumn(day, F.col(day).cast("date")).join(wanted, [key, day])


def recorded(lines: DataFrame, file: str, order: str) -> DataFrame:
    """(file, n, start, stop, path) of the recordings in classified lines (what: start, stop or path; value; clock).

    A start without a stop stays open, also when the next one begins; lines without a clock start and stop nothing. A path belongs to the recording that
    is open, else to the next to start; the last one counts.
    """
    w = Window.partitionBy(file).orderBy(order)
    upto, timed = w.rowsBetween(Window.unboundedPreceding, 0), F.col("clock").isNotNull()
    turn = F.when(timed & F.col("what").isin("start", "stop"), F.col("what"))
    rows = lines.withColumn("_n", F.sum(F.when(turn == "start", 1).otherwise(0)).over(upto))
    rows = rows.withColumn("_open", F.coalesce(F.last(turn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == "start", F.lit(False)))
    rows = rows.withColumn("_of", F.when((F.col("what") == "path") & ~F.col("_open"), F.col("_n") + 1).otherwise(F.col("_n")))
    start, stop, path = (F.when(turn == "start", F.col("clock")), F.when((turn == "stop") & F.col("_open"), F.col("clock")), F.when(F.col("what") == "path", F.col("value")))
    out = rows.groupBy(file, F.col("_of").alias("n")).agg(F.max(start).alias("start"), F.min(stop).alias("stop"), F.max_by(path, F.when(path.isNotNull(), F.col(order))).alias("path"))
    return out.where("start is not null")
