"""Scaling, centering and feature scores, globally and inside training folds, on cells (row_id, y, fold, batch, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cells(df: DataFrame, row_id: str, features: str, *keep: str) -> DataFrame:
    return df.select(F.col(row_id).alias("row_id"), *keep, F.posexplode(features).alias("j", "v")).withColumn("v", F.col("v").cast("double"))


def training(cells: DataFrame) -> DataFrame:
    """Each fold's training cells: cells of the other folds, marked by outer."""
    folds = cells.select("fold").distinct().withColumnRenamed("fold", "outer")
    return cells.join(F.broadcast(folds), F.col("fold") != F.col("outer"))  # one row a fold


def scaling(cells: DataFrame, *by: str) -> DataFrame:
    """Mean and population deviation of each feature."""
    return cells.groupBy(*by, "j").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def scaled(cells: DataFrame, stats: DataFrame, *on: str) -> DataFrame:
    return cells.join(stats, [*on, "j"]).withColumn("z", (F.col("v") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).drop("mean", "sd")


def centered(cells: DataFrame, batch: str = "batch") -> DataFrame:
    """row_id, j, centered: test cells less their batch's training mean, or the overall one for an unseen batch."""
    train = training(cells)
    by_batch = train.groupBy("outer", batch, "j").agg(F.avg("v").alias("bm"))
    overall = train.groupBy("outer", "j").agg(F.avg("v").alias("gm"))
    test = cells.withColumn("outer", F.col("fold"))
    return test.join(by_batch, ["outer", batch, "j"], "left").join(overall, ["outer", "j"]).select("row_id", "fold", "j", (F.col("v") - F.coalesce("bm", "gm")).alias("centered"))


def anova_f(cells: DataFrame, *by: str) -> DataFrame:
    """f of each feature; null where a class structure gives none."""
    g = cells.groupBy(*by, "j", "y").agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("ss"))
    s = g.groupBy(*by, "j").agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum("ss").alias("ss"), F.collect_list(F.struct("n", "m")).alias("g"))
    between = F.expr("aggregate(g, 0D, (s, x) -> s + x.n * pow(x.m - gm, 2)) / (k - 1)")
    return s.select(*by, "j", F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ss") > 0), between / (F.col("ss") / (F.col("n") - F.col("k")))).alias("f"))


def regression_f(cells: DataFrame, *by: str) -> DataFrame:
    r2 = F.pow(F.corr("v", F.col("y").cast("double")), 2)
    return cells.groupBy(*by, "j").agg((r2 / (1 - r2) * (F.count("*") - 2)).alias("f"))


def top_k(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best features; of equal ones the later, null last."""
    order = Window.partitionBy(*(by or (F.lit(0),))).orderBy(F.desc_nulls_last("f"), F.desc("j"))
    return scores.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
