"""Metrics over scored rows, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


PARTS = 1024


def auc(df: DataFrame, y: str = "y", score: str = "score", *by: str) -> DataFrame:
    """Rank AUC, ties averaged, null for a single class; null scores are left out.

    Equal scores are counted first. Scores then fall in parts between their least and greatest, so ranks are a part's
    offset and a sum inside the part, and no task sorts all scores."""
    rows = df.where(F.col(score).isNotNull()).select(*by, F.col(score).cast("double").alias("_s"), F.col(y).cast("long").alias("_y"))
    counts = rows.groupBy(*by, "_s").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    ends = counts.groupBy(*by).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    joined = counts.join(ends, [*by]) if by else counts.crossJoin(F.broadcast(ends))  # one row
    width = F.col("_hi") - F.col("_lo")
    parts = joined.withColumn("_part", F.when(width > 0, F.floor((F.col("_s") - F.col("_lo")) / width * PARTS)).otherwise(0))
    before = Window.partitionBy(*(by or (F.lit(0),))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(*by, "_part").agg(F.sum("_neg").alias("_k")).withColumn("_under", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    inside = Window.partitionBy(*by, "_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("_in", F.coalesce(F.sum("_neg").over(inside), F.lit(0))).join(offsets, [*by, "_part"])
    won = F.sum(F.col("_pos") * (F.col("_under") + F.col("_in") + F.col("_neg") / 2.0))
    pairs = F.max("_p").cast("double") * F.max("_n")
    return ranked.groupBy(*by).agg(F.when(pairs > 0, won / pairs).alias("auc"))


def binary(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(-F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("log_loss"))


def regression(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    e = F.col(y) - F.col(pred)
    return df.agg((1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def multiclass(df: DataFrame, y: str = "y", proba: str = "proba") -> DataFrame:
    """Log loss, Brier score over all classes, balanced accuracy; y indexes proba."""
    each = df.select(F.col(y).alias("y"), F.col(proba).alias("q")).withColumn("hit", (F.array_position("q", F.array_max("q")) - 1 == F.col("y")).cast("double"))
    each = each.withColumn("b", F.expr("aggregate(transform(q, (v, i) -> pow(v - IF(i = y, 1D, 0D), 2)), 0D, (s, x) -> s + x)")).withColumn("l", -F.ln(F.expr("q[CAST(y AS INT)]")))
    g = each.groupBy("y").agg(F.avg("hit").alias("recall"), F.sum("b").alias("b"), F.sum("l").alias("l"), F.count("*").alias("n"))
    return g.agg((F.sum("l") / F.sum("n")).alias("log_loss"), (F.sum("b") / F.sum("n")).alias("brier"), F.avg("recall").alias("balanced_accuracy"))


def auc_ovr(df: DataFrame, y: str = "y", proba: str = "proba") -> DataFrame:
    """Unweighted mean over classes of one class's AUC against the rest."""
    rows = df.select(F.col(y).alias("_y"), F.posexplode(proba).alias("c", "score")).withColumn("y", (F.col("_y") == F.col("c")).cast("int"))
    return auc(rows, "y", "score", "c").agg(F.avg("auc").alias("auc_ovr"))


def reliability(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Mean prediction, mean outcome and rows of each bin that has any; bins are closed on the left, 1 is in the last.

    Inner edges are multiples of a bin's width in doubles, so 0.3 lies below the edge 3 * 0.1."""
    b = sum((F.col(p) >= F.lit(i * (1 / bins))).cast("int") for i in range(1, bins))
    return df.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"), F.count("*").alias("n"))


def bundle(df: DataFrame, task: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """A task's metrics in one row, with headline and headline_name: R2, AUC, or the mean of one-versus-rest AUCs."""
    if task == "regression":
        return regression(df, y, pred).withColumn("headline", F.col("r2")).withColumn("headline_name", F.lit("R2"))
    if task == "binary":
        one = auc(df, y, pred).join(F.broadcast(binary(df, y, pred)), F.lit(True))  # a row each
        return one.withColumn("headline", F.col("auc")).withColumn("headline_name", F.lit("AUC"))
    one = auc_ovr(df, y, pred).withColumnRenamed("auc_ovr", "auc_ovr_macro").join(F.broadcast(multiclass(df, y, pred)), F.lit(True))  # a row each
    return one.withColumn("headline", F.col("auc_ovr_macro")).withColumn("headline_name", F.lit("AUC (macro-OVR)"))


def ladder(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
