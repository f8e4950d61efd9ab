"""Exact deduplication by merged counting quotient filters and byte verification."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quotient import bitmap, hit
from .workspace import Workspace

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL)


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", normalised(F.col("text")).alias("norm"))


def classes(docs: DataFrame, bits) -> DataFrame:
    """Groups of equal texts among the rows that the filters route here: sha, keep_id, group_size.

    Rows are grouped by the whole normalised text, so equality is that of bytes; copies within
    a task become one row before the shuffle.
    """
    routed = _prepared(docs).where(hit(F.xxhash64("norm"), bits))
    groups = routed.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.select(F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")


def large(groups: DataFrame, size: str, n_rows: int) -> DataFrame:
    """The groups that would crowd a task of an evenly dealt join: each has more than half a task's share of all rows, so there are at most twice as many of them as tasks, whatever the data."""
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.where(F.col(size) > n_rows / (2 * tasks))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row.

    Null texts are empty texts and equal each other. The largest doc_id of equal texts stays (null
    ids sort below all); of rows that repeat that id with that text, one stays. An empty table gives
    an empty result; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "exact-dedup")
    rows = work.save(_prepared(docs).select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")))
    bits = bitmap(rows, repeated=True)
    found = work.save(classes(docs, bits))
    # rows of large groups meet their group where they are
    hot = F.broadcast(large(found, "group_size", rows.count()))
    crowded = rows.join(hot, rows.text_sha256 == hot.sha)
    others = rows.join(hot, rows.text_sha256 == hot.sha, "left_anti")
    joined = others.join(found, others.text_sha256 == found.sha, "left").unionByName(crowded)
    nth = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("row"))
    keep = F.when(F.col("sha").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & (nth == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops, with all their columns, whatever their names; nulls, ties and repeated rows as there. Texts that the filters show to be unique are never shuffled."""
    work = Workspace(docs.sparkSession, "drop-copies")
    fp = F.xxhash64(normalised(F.col("text")))
    bits = bitmap(docs.select(fp.alias("fp")), repeated=True)
    found = work.save(classes(docs, bits))
    tagged = docs.withColumn("__maybe", hit(fp, bits))
    sure = tagged.where(~F.col("__maybe")).drop("__maybe")
    rest = tagged.where("__maybe").withColumn("__sha", F.sha2(normalised(F.col("text")), 256))
    # joined by text and id together, so copies are dealt to as many tasks as they have ids
    rest = rest.join(found.select("sha", "keep_id"), (F.col("__sha") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    return sure.unionByName(rest.dropDuplicates(["__sha", "doc_id"]).select(*[F.col("`" + c + "`") for c in docs.columns]))
