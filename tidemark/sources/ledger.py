"""Tables of immutable files behind a log of commits: what is current changes in one step, and only what has moved is computed again.

A commit is a file `<number>.json` in the log, put there by a rename that fails if the number is taken; it names a folder of rows and a folder of the
keys that it covers. A key's head is the last commit that covers it. Whatever a writer leaves behind without a commit is never read, so a run that died can simply be run again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import written
from .store import carried, next_generation


class Conflict(RuntimeError):
    """Another writer took the number first; read again and decide anew."""


def settings_hash(params: object) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def commits(self) -> list[dict]:
        """All commits in order. There is one for each write, not for each row."""
        log = self._path("log")
        fs = log.getFileSystem(self._conf)
        if not fs.exists(log):
            return []
        names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(log)) if n[:1].isdigit())
        return [json.loads(r[0]) for r in self.spark.read.text([f"{self.root}/log/{n}" for n in names], wholetext=True).orderBy(F.input_file_name()).collect()] if names else []

    def _commit(self, seq: int, entry: dict) -> None:
        jvm, draft, final = self.spark._jvm, self._path(f"log/draft-{uuid.uuid4().hex}"), self._path(f"log/{seq:010d}.json")
        out = draft.getFileSystem(self._conf).create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"commit {seq} is taken") from e
            raise

    def put(self, table: str, rows: DataFrame, key: str, keys: DataFrame | None = None, params: str = "", after: int | None = None) -> int:
        """Writes rows as the new content of their keys, and of `keys` beyond those that have rows now. The number of the commit, which must be the one after `after` (by default the last there is)."""
        seq = ((self.commits() or [{"seq": 0}])[-1]["seq"] if after is None else after) + 1
        part = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{part}/rows")
        saved = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{part}/rows")
        covered = saved.select(key) if keys is None else saved.select(key).unionByName(keys.select(key))
        covered.distinct().write.parquet(f"{self.root}/{part}/keys")
        self._commit(seq, {"seq": seq, "table": table, "part": part, "params": params, "schema": rows.schema.json()})
        return seq

    def _of(self, table: str) -> list[dict]:
        return [c for c in self.commits() if c["table"] == table]

    def heads(self, table: str, key: str) -> DataFrame | None:
        """(key, seq, params): the last commit of each key."""
        parts = [self.spark.read.parquet(f"{self.root}/{c['part']}/keys").select(key, F.lit(c["seq"]).alias("seq"), F.lit(c["params"]).alias("params")) for c in self._of(table)]
        if not parts:
            return None
        return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.max_by("params", "seq").alias("params"), F.max("seq").alias("seq"))

    def everything(self, table: str, only: set[int] | None = None) -> DataFrame | None:
        """All rows ever committed, with their seq; of the commits in `only`, if given."""
        parts = [self.spark.read.schema(StructType.fromJson(json.loads(c["schema"]))).parquet(f"{self.root}/{c['part']}/rows").withColumn("seq", F.lit(c["seq"])) for c in self._of(table) if only is None or c["seq"] in only]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def read(self, table: str, key: str, keys: DataFrame | None = None) -> DataFrame | None:
        """The current rows, with `keys` of those keys alone: only commits that are the head of any of them are read."""
        heads = self.heads(table, key)
        if heads is None:
            return None
        heads = (heads if keys is None else heads.join(keys.select(key).distinct(), key, "left_semi")).select(key, "seq")
        live = {r[0] for r in heads.select("seq").distinct().collect()}  # at most one for each commit
        rows = self.everything(table, live or {self._of(table)[-1]["seq"]})
        return rows.join(heads, [key, "seq"], "left_semi").drop("seq")

    def refresh(self, table: str, needs: list[str], key: str, params: object, compute: Callable[..., DataFrame]) -> int | None:
        """Brings a derived table up to date: compute(rows of each need) for the keys that are new, whose settings changed, or of which a need was committed after them. Keys that a need lost go out.

        Returns the commit, or None where all is up to date; then no rows are read. Replays are harmless: nothing is stale any more once the commit is there.
        """
        last, want = (self.commits() or [{"seq": 0}])[-1]["seq"], settings_hash(params)
        ups = [self.heads(n, key) for n in needs]
        if any(u is None for u in ups):
            return None
        newest = reduce(lambda a, b: a.join(b.withColumnRenamed("up", "_b"), key).select(key, F.greatest("up", "_b").alias("up")), [u.select(key, F.col("seq").alias("up")) for u in ups])
        mine = self.heads(table, key)
        if mine is None:
            stale = newest.select(key)
        else:
            both = newest.join(mine, key, "full")
            lost = F.col("up").isNull() & (F.col("params") != "")
            stale = both.where(F.col("seq").isNull() | lost | (F.col("up").isNotNull() & ((F.col("params") != want) | (F.col("up") > F.col("seq"))))).select(key)
        if not stale.limit(1).count():
            return None
        alive = stale.join(newest.select(key), key, "left_semi")
        return self.put(table, compute(*(self.read(n, key, alive) for n in needs)), key, stale, want, last)


class Scores:
    """Generations of scored windows by recording, with the ratings on them. Old generations stay; which one is current changes with the commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.ledger = Ledger(spark, root)

    def candidates(self) -> DataFrame | None:
        """Every generation's rows, with is_current. A generation that was scored again has its last rows."""
        rows, heads = self.ledger.everything("candidates"), self.ledger.heads("candidates", "recording_id")
        if rows is None:
            return None
        last = rows.groupBy("recording_id", "generation").agg(F.max("seq").alias("seq"))
        current = heads.select("recording_id", F.col("seq").alias("head"))
        return rows.join(last, ["recording_id", "generation", "seq"], "left_semi").join(current, "recording_id").withColumn("is_current", F.col("seq") == F.col("head")).drop("head", "seq")

    def ratings(self) -> DataFrame | None:
        """id, rating, source of every rating; of several the last."""
        rows = self.ledger.everything("ratings")
        return None if rows is None else rows.groupBy("id").agg(F.max_by(F.struct("rating", "source"), "seq").alias("r")).select("id", "r.*")

    def rate(self, ratings: DataFrame) -> int:
        """Ratings (id, rating) by an operator."""
        return self.ledger.put("ratings", ratings.select("id", "rating", F.lit("operator").alias("source")), "id")

    def score(self, windows: DataFrame, config: str, width: float) -> int:
        """Windows (recording_id, t_start, t_end and more) as their recordings' current generation under `config`: the same again where nothing was rated and the settings are
        the same, else a new one, onto which ratings pass from the windows before that overlap best. Ratings are committed first, so that whoever sees the new generation sees them.
        """
        last = (self.ledger.commits() or [{"seq": 0}])[-1]["seq"]
        old, rated = self.candidates(), self.ratings()
        ids = F.lit((last + 2) << 40) + F.monotonically_increasing_id()
        spark = self.ledger.spark
        none = spark.createDataFrame([], "id long, rating int, source string")
        if old is None:
            new = windows.withColumn("generation", F.lit(1))
        else:
            numbers = next_generation(old, none if rated is None else rated, config).select("recording_id", F.col("generation").cast("int").alias("generation"))
            new = windows.join(numbers, "recording_id", "left").withColumn("generation", F.coalesce("generation", F.lit(1)))
        new = written(new.withColumn("config_version", F.lit(config)).withColumn("id", ids), "scored")
        if rated is not None:
            before = old.where("is_current").join(rated, "id").select("recording_id", F.col("id").alias("old_id"), F.col("t_start").alias("old_start"), F.col("t_end").alias("old_end"), F.col("rating").alias("old_rating"))
            passed = carried(new.select("recording_id", "id", "t_start", "t_end", F.lit(None).cast("int").alias("rating"), F.lit(None).cast("string").alias("source")), before, width)
            last = self.ledger.put("ratings", passed.where("rating is not null").select("id", "rating", "source"), "id", after=last)
        return self.ledger.put("candidates", new, "recording_id", windows.select("recording_id").distinct(), config, last)

