"""Verification of probabilities: discrimination, calibration, skill, curves. Input: label 0/1, prob; rows with null or NaN are left out."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 10


def valid(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("label").isNotNull() & F.col("prob").isNotNull() & ~F.isnan("prob"))


def left_closed_bin(p: Column, n: int = BINS) -> Column:
    """How many inner edges i * (1/n), as doubles, are <= p; the last bin also holds 1."""
    return reduce(lambda a, b: a + b, [F.when(p >= F.lit(i * (1.0 / n)), 1).otherwise(0) for i in range(1, n)])


def right_closed_bin(p: Column, n: int = BINS) -> Column:
    return reduce(lambda a, b: a + b, [F.when(p > F.lit(i * (1.0 / n)), 1).otherwise(0) for i in range(1, n)])


def _by_prob(scored: DataFrame, by: list[str]) -> DataFrame:
    """Counts for each distinct probability: what every threshold metric is made of, far fewer rows than the input."""
    return valid(scored).groupBy(*by, "prob").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n1"))


def _falling(counts: DataFrame, by: list[str]) -> DataFrame:
    """With tp and fp at each threshold, and the totals. Distinct probabilities are summed within ranges first, so a global curve doesn't pass through one task row by row."""
    w = Window.partitionBy(*by)
    run = w.orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    if not by:
        # ranges between quantiles of the distinct probabilities, which may crowd a small part of [0, 1]
        cuts = sorted(set(counts.agg(F.percentile_approx("prob", [k / 64 for k in range(1, 64)], 2000)).first()[0] or [0.5]))
        counts = counts.withColumn("__range", reduce(lambda a, b: a + b, [(F.col("prob") >= c).cast("int") for c in cuts]))
        sums = counts.groupBy("__range").agg(F.sum("n").alias("sn"), F.sum("n1").alias("s1"))
        above = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
        all_ = Window.partitionBy()
        sums = sums.select("__range", F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("an"), F.coalesce(F.sum("s1").over(above), F.lit(0)).alias("a1"), F.sum("sn").over(all_).alias("total"), F.sum("s1").over(all_).alias("positives"))
        run = Window.partitionBy("__range").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
        df = counts.join(F.broadcast(sums), "__range")  # a row for each range, 64 at most
        return df.select("prob", "n", "n1", (F.col("a1") + F.sum("n1").over(run)).alias("tp"), (F.col("an") - F.col("a1") + F.sum(F.col("n") - F.col("n1")).over(run)).alias("fp"), "total", "positives")
    return counts.select(*by, "prob", "n", "n1", F.sum("n1").over(run).alias("tp"), F.sum(F.col("n") - F.col("n1")).over(run).alias("fp"), F.sum("n").over(w).alias("total"), F.sum("n1").over(w).alias("positives"))


def discrimination(scored: DataFrame, threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    """AUC with ties averaged, average precision, Brier score, and the rates at prob >= threshold; for each group of `by`. Without positives AUC is 0.5."""
    by = list(by)
    d = _falling(_by_prob(scored, by), by)
    n0 = F.col("n") - F.col("n1")
    hit = F.col("prob") >= threshold
    # twice the number of (positive, negative) pairs in the right order, ties once
    below = F.col("total") - F.col("positives") - F.col("fp")
    sums = d.groupBy(*by).agg(
        F.max("total").alias("n"),
        F.max("positives").alias("p"),
        F.sum(F.col("n1") * (2 * below + n0)).alias("pairs"),
        F.sum(F.col("n1") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.sum(F.col("n1") * (1 - F.col("prob")) ** 2 + n0 * F.col("prob") ** 2).alias("brier"),
        F.coalesce(F.sum(F.when(hit, F.col("n1"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, n0)), F.lit(0)).alias("fp"),
    )
    q, fn = F.col("n") - F.col("p"), F.col("p") - F.col("tp")
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return sums.select(
        *by,
        F.col("n").cast("long").alias("n"),
        F.col("p").cast("long").alias("n_positive"),
        F.round(F.coalesce(F.try_divide(F.col("pairs").cast("double"), (2 * F.col("p") * q).cast("double")), F.lit(0.5)), 6).alias("auc"),
        rate(F.col("ap"), F.col("p")).alias("average_precision"),
        F.round(F.col("brier") / F.col("n"), 8).alias("brier"),
        rate(F.col("tp"), F.col("p")).alias("recall"),
        rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        rate(q - F.col("fp"), q).alias("specificity"),
        rate(F.col("tp") + q - F.col("fp"), F.col("n")).alias("accuracy"),
        rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn).alias("f1"),
    )


def bins(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    return valid(scored).groupBy(*by, left_closed_bin(F.col("prob")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("p"), F.avg(F.col("label").cast("double")).alias("y"))


def calibration_curve(scored: DataFrame) -> DataFrame:
    return bins(scored).select(F.col("bin").cast("int").alias("bin"), "n", F.round("p", 6).alias("mean_prob"), F.round("y", 6).alias("mean_label"), F.round(F.abs(F.col("p") - F.col("y")), 6).alias("gap"))


def reliability_diagram(scored: DataFrame) -> DataFrame:
    """Right-closed bins, those that hold something."""
    g = valid(scored).groupBy(right_closed_bin(F.col("prob")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("p"), F.avg(F.col("label").cast("double")).alias("y"))
    return g.select(F.col("bin").cast("int").alias("bin"), "n", F.round("p", 6).alias("prob_pred"), F.round("y", 6).alias("prob_true"))


def calibration_error(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Expected and largest gap over the bins that hold something."""
    by = list(by)
    gap = F.abs(F.col("p") - F.col("y"))
    return bins(scored, by).groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"))


def skill(scored: DataFrame, climatology: float | None = None) -> DataFrame:
    """Brier score, skill against climatology (the base rate if none is given), and the score's parts over ten bins."""
    v = valid(scored).withColumn("b", left_closed_bin(F.col("prob")))
    g = v.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("prob").alias("sp"), F.sum("label").alias("sy"), F.sum((F.col("prob") - F.col("label")) ** 2).alias("se"))
    total = g.agg(F.sum("n").alias("tn"), F.sum("sy").alias("ty"), F.sum("se").alias("te"))
    j = g.crossJoin(F.broadcast(total))  # one row
    o = F.col("ty") / F.col("tn")
    s = j.agg(
        F.max("tn").alias("n"),
        F.max(o).alias("o"),
        F.max(F.col("te") / F.col("tn")).alias("brier"),
        F.sum(F.col("n") * (F.col("sp") / F.col("n") - F.col("sy") / F.col("n")) ** 2 / F.col("tn")).alias("rel"),
        F.sum(F.col("n") * (F.col("sy") / F.col("n") - o) ** 2 / F.col("tn")).alias("res"),
    )
    c = F.lit(climatology) if climatology is not None else F.col("o")
    reference = F.col("o") * (1 - c) ** 2 + (1 - F.col("o")) * c**2
    return s.where("n > 0").select("n", F.round("brier", 8).alias("brier"), F.round(F.when(reference > 0, 1 - F.col("brier") / reference).otherwise(0.0), 6).alias("bss"), F.round("rel", 6).alias("reliability"), F.round("res", 6).alias("resolution"), F.round(F.col("o") * (1 - F.col("o")), 6).alias("uncertainty"))


def roc_curve(scored: DataFrame) -> DataFrame:
    """A point for each distinct probability, from the highest."""
    d = _falling(_by_prob(scored, []), [])
    q = F.col("total") - F.col("positives")
    return d.select(F.round("prob", 6).alias("threshold"), F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.round(F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")), 6).alias("tpr"), F.round(F.try_divide(F.col("fp").cast("double"), q.cast("double")), 6).alias("fpr"))


def pr_curve(scored: DataFrame) -> DataFrame:
    d = _falling(_by_prob(scored, []), [])
    return d.select("prob", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")).alias("recall"))


def best_f1(scored: DataFrame) -> DataFrame:
    """The threshold with the highest F1; the lowest of equals."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10)
    c = pr_curve(scored).withColumn("f1", F.round(f1, 9))
    return c.agg(F.max_by(F.struct("prob", "f1"), F.struct("f1", -F.col("prob"))).alias("b")).select(F.round("b.prob", 6).alias("threshold"), F.round("b.f1", 6).alias("f1"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit = F.col("prob") >= threshold
    return valid(scored).agg(*[F.count_if(c).alias(n) for n, c in (("tp", hit & (F.col("label") == 1)), ("fp", hit & (F.col("label") == 0)), ("fn", ~hit & (F.col("label") == 1)), ("tn", ~hit & (F.col("label") == 0)))])


def precision_recall_at(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    t = F.explode(F.array(*map(F.lit, thresholds)))
    g = _by_prob(scored, []).withColumn("threshold", t).groupBy("threshold").agg(F.sum(F.when(F.col("prob") >= F.col("threshold"), F.col("n1")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("prob") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n1").alias("p"))
    return g.select("threshold", F.round(F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("hits").cast("double")), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("p").cast("double")), F.lit(0.0)), 6).alias("recall"))


def hindcast(scored: DataFrame, group: str = "grp") -> DataFrame:
    """Discrimination and calibration for each year or other group."""
    a = discrimination(scored, by=[group])
    b = calibration_error(scored, by=[group]).drop("n")
    return a.join(b, group).select(group, "n", "n_positive", "auc", "brier", "ece", "mce")


def hindcast_summary(scored: DataFrame, group: str = "grp") -> DataFrame:
    """Mean and sample standard deviation of the groups' metrics."""
    h = hindcast(scored, group)
    return h.agg(F.count(F.lit(1)).alias("n_groups"), *[F.round(f(c), 6).alias(f"{c}_{n}") for c in ("auc", "brier", "ece") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def targets(results: DataFrame, burn_auc: float, ece: float) -> DataFrame:
    """results (auc, ece) with what is met: discrimination at least `burn_auc`, calibration error under `ece`."""
    return results.withColumn("burn_auc_met", F.col("auc") >= burn_auc).withColumn("ece_met", F.col("ece") < ece)


def validate_year(parcels: DataFrame, year: int) -> DataFrame:
    """One row: how well parcels' burn_prob_mean foretold the year's actually_burned."""
    scored = parcels.select(F.col("burn_prob_mean").alias("prob"), F.col("actually_burned").cast("int").alias("label"))
    return discrimination(scored).select(F.lit(year).alias("year"), "n", "n_positive", "auc", "brier").join(F.broadcast(calibration_error(scored).select("ece")))


def report(results: DataFrame) -> DataFrame:
    """Lines of a validation report: a row for each measure of each result."""
    names = [c for c in results.columns if c != "year"]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in names]))
    return results.select("year", each.alias("m")).select("year", "m.measure", "m.value")
