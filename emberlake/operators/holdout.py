"""Holding fires out within each year, by size class."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform

SEED = 42


def size_class(acres: Column) -> Column:
    """0 to 3: how many of the strict limits 100, 1000 and 10000 acres are passed."""
    return sum(((acres > x).cast("int") for x in (1000, 10000)), (acres > 100).cast("int"))


def split_by_year(fires: DataFrame, fraction: float = 0.3, seed: int = SEED, stratify: bool = True) -> DataFrame:
    """fires with `holdout`. Each year holds out max(1, floor(n * fraction)) fires, or max(1, floor(that * class share)) of each size class; which, a hash of fire_id says. Without gis_acres no classes."""
    if "year_" not in fires.columns:
        raise ValueError("fires have no year")
    stratify = stratify and "gis_acres" in fires.columns
    df = fires.withColumn("__c", size_class(F.col("gis_acres")) if stratify else F.lit(0)).withColumn("__u", uniform("holdout", F.col("fire_id"), seed=seed))
    # counts come from an aggregate, so only the draw needs a window, and that by year and class
    counts = df.groupBy("year_", "__c").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__t", F.sum("__n").over(Window.partitionBy("year_")))
    quota = F.greatest(F.lit(1), F.floor(F.col("__t") * F.lit(fraction)))
    counts = counts.withColumn("__q", F.greatest(F.lit(1), F.floor(quota * F.col("__n") / F.col("__t"))) if stratify else quota)
    df = df.join(counts.select(F.col("year_").alias("__y"), F.col("__c").alias("__d"), "__q"), F.col("year_").eqNullSafe(F.col("__y")) & F.col("__c").eqNullSafe(F.col("__d")))
    nth = F.row_number().over(Window.partitionBy("year_", "__c").orderBy("__u", "fire_id"))
    return df.withColumn("holdout", nth <= F.col("__q")).select(*fires.columns, "holdout")


def holdout_set(fires: DataFrame, years: tuple[int, int], fraction: float = 0.3, seed: int = SEED) -> DataFrame:
    """part: train outside the years, holdout for the fires held out within them, neither for the others."""
    inside = F.col("year_").between(*years)
    a = fires.where(~inside).withColumn("part", F.lit("train"))
    b = split_by_year(fires.where(inside), fraction, seed).withColumn("part", F.when(F.col("holdout"), "holdout").otherwise("neither")).drop("holdout")
    return a.unionByName(b)


def statistics(split: DataFrame) -> DataFrame:
    """One row: sizes, acres and years of both parts."""
    h = F.col("holdout")
    n = F.count(F.lit(1))
    return split.agg(
        F.count_if(~h).alias("n_train"), F.count_if(h).alias("n_holdout"), F.round(F.count_if(h) / n, 6).alias("fraction"),
        F.round(F.avg(F.when(~h, F.col("gis_acres"))), 3).alias("train_mean_acres"), F.round(F.avg(F.when(h, F.col("gis_acres"))), 3).alias("holdout_mean_acres"),
        F.round(F.sum(F.when(h, F.col("gis_acres"))), 1).alias("holdout_acres"), F.array_join(F.array_sort(F.collect_set(F.when(h, F.col("year_")))), ",").alias("holdout_years"),
    )


def balanced(split: DataFrame, shift: float = 0.5) -> DataFrame:
    """One row: whether the medians differ by no more than `shift` and every held-out year is in training."""
    h = F.col("holdout")
    m = split.agg(F.percentile(F.when(~h, F.col("gis_acres")), 0.5).alias("a"), F.percentile(F.when(h, F.col("gis_acres")), 0.5).alias("b"), F.size(F.array_except(F.collect_set(F.when(h, F.col("year_"))), F.collect_set(F.when(~h, F.col("year_"))))).alias("missing"))
    return m.select(F.round("a", 6).alias("train_median"), F.round("b", 6).alias("holdout_median"), F.col("missing").cast("int").alias("missing_years"), ((F.abs(F.col("b") - F.col("a")) <= shift * F.col("a")) & (F.col("missing") == 0)).alias("balanced"))
