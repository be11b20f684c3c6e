"""Exact duplicates by progressive refinement: length, then prefix hash, then the hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, materialize, once, small, text_key, without

PREFIX = 128


def normalized(text: Column) -> Column:
    """Every run of space, tab, line feed, vertical tab, form feed and carriage return as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_all: bool = False, max_broadcast_rows: int = MAX_BROADCAST_ROWS, keyed: bool = False) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after normalized(). Of equal texts the row with the
    smallest doc_id stays. A first scan keeps only the length in bytes and a hash of the first PREFIX
    characters; lengths that occur once go out, then prefixes that occur once within a length. Only
    what survives is hashed whole, in a second scan that looks up the surviving (length, prefix)
    keys: broadcast while a count shows few enough, otherwise every text is hashed in the scan so
    that no text is ever shuffled. With digest_all every text is hashed in the first scan, since its
    digest is wanted in the result; the refinement then runs on these narrow rows.

    text_sha256 is null for texts that were never hashed. Rows with a null doc_id are grouped like
    others; they stay only if their whole group has none. Rows that repeat a doc_id with the same text
    get the same decision. An empty table gives no rows; other columns of docs aren't read.
    With keyed each row also has its text_key.
    """
    norm = normalized(F.col(text))
    sha = F.sha2(norm, 256)
    key = [F.octet_length(norm).alias("bytes"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix")]
    own = ["text_key"] if keyed else []
    cols = [F.col(doc_id).alias("doc_id"), *([text_key(text)] if keyed else []), *key]
    seen = materialize(docs.select(*cols, *([sha.alias("sha")] if digest_all else [])), "sketch")

    lengths = materialize(seen.groupBy("bytes").count().where("count > 1").select("bytes"), "lengths")
    alike = seen.join(small(lengths, max_broadcast_rows), "bytes", "left_semi")
    prefixes = materialize(alike.groupBy("bytes", "prefix").count().where("count > 1").select("bytes", "prefix"), "prefixes")
    few = prefixes.count() <= max_broadcast_rows
    side = F.broadcast(prefixes) if few else prefixes

    if digest_all:
        rows = seen
        hashed = seen.join(side, ["bytes", "prefix"], "left_semi")
    elif few:
        hashed = materialize(docs.select(*cols, norm.alias("norm")).join(side, ["bytes", "prefix"], "left_semi").select("doc_id", *own, F.sha2("norm", 256).alias("sha")), "digests")
        rows = seen.join(side, ["bytes", "prefix"], "left_anti").select("doc_id", *own, F.lit(None).cast("string").alias("sha")).unionByName(hashed)
    else:
        rows = materialize(docs.select(*cols, sha.alias("sha")), "digests")
        hashed = rows.join(side, ["bytes", "prefix"], "left_semi")

    groups = materialize(hashed.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "copies")
    # Both sides come from files, so that a digest which a large share of the rows have is split by the skew join.
    return rows.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("first_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *own,
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay. Of equal texts under one id, or under none where no copy has one, a single row stays too."""
    told = materialize(exact_dedup(docs, doc_id, text, keyed=True).where("text_sha256 is not null").select("doc_id", "text_key", "text_sha256", "kept"), "copies-told")
    again = told.where("kept").groupBy("doc_id", "text_sha256").agg(F.min("text_key").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialize(again, "copies-again")
    same = told["doc_id"].eqNullSafe(again["doc_id"]) & (told["text_sha256"] == again["text_sha256"]) & (told["text_key"] != again["first"])
    gone = told.where("not kept").select("doc_id", "text_key").unionByName(told.where("kept").join(small(again), same, "left_semi").select("doc_id", "text_key"))
    return once(without(docs, gone, "copies-gone", doc_id, text), again.select("doc_id", F.col("first").alias("text_key")), "copies-once", doc_id, text)
