"""What the corpus operators share: tables, written intermediate results, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its rows were counted and found to be at most this many.
MAX_BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Batches that go to Python hold at most so many rows, and about so many bytes unless one row is longer.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches kept small, so that JVM and Python hold little of whole texts at a time. What the session sets itself stays."""
    for key, value in BATCH.items():
        if df.sparkSession.conf.get(key, None) is None:
            df.sparkSession.conf.set(key, value)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session has none and runs inside one machine (tests), a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder for one run's use in the shared folder; it is deleted when the application ends, if it wasn't before."""
    name = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage at files that survive a lost executor, and that live until discard() or the end of the application.
    """
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files under a result of materialize() that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most max_rows rows, else df as it is (a shuffled join)."""
    return F.broadcast(df) if df.count() <= max_rows else df


def text_key(text: str) -> Column:
    """What tells a row's text from others under the same id."""
    return F.xxhash64(F.col(text)).alias("text_key")


def without(docs: DataFrame, gone: DataFrame, tag: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose id and text both are those of a row (doc_id, text_key) of gone; ids may be null or repeat."""
    gone = materialize(gone.select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct(), tag)
    return docs.join(small(gone), docs[doc_id].eqNullSafe(F.col("__gone")) & (F.xxhash64(docs[text]) == F.col("__key")), "left_anti")


def once(docs: DataFrame, repeated: DataFrame, tag: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row, whichever, of those that share an id and a text named in repeated (doc_id, text_key); ids may be null."""
    repeated = materialize(repeated.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), tag)
    if not repeated.limit(1).count():
        return docs
    on, keys = docs[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__key")), small(repeated)
    return docs.join(keys, on, "left_anti").unionByName(docs.join(keys, on, "left_semi").dropDuplicates([doc_id, text]))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
