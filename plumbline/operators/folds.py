"""Fold assignment. Order within a class is a hash of the row id, so folds need no driver and never change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key(row_id: str) -> F.Column:
    return F.md5(F.col(row_id).cast("string"))


def plain(df: DataFrame, row_id: str, k: int = 5) -> DataFrame:
    """df with fold, from the hash alone: rows are dealt without a sort of them all."""
    return df.withColumn("fold", (F.conv(F.substring(key(row_id), 1, 8), 16, 10).cast("long") % k).cast("int"))


def stratified(df: DataFrame, row_id: str, y: str, k: int = 5) -> DataFrame:
    """df with fold; each class is dealt in turn. A class spreads over 256 parts by its hash, each with an offset."""
    part = df.withColumn("_k", key(row_id)).withColumn("_part", F.substring("_k", 1, 2))
    before = Window.partitionBy(y).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.groupBy(y, "_part").agg(F.count("*").alias("_n")).select(F.col(y).alias("_y"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    placed = part.withColumn("_r", F.row_number().over(Window.partitionBy(y, "_part").orderBy("_k", row_id)))
    joined = placed.join(offsets, F.col(y).eqNullSafe(F.col("_y")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("fold", ((F.col("_o") + F.col("_r") - 1) % k).cast("int")).select(*df.columns, "fold")


def group_table(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """group, n, fold: groups by size, then by id, each to the lightest fold, the first of equal ones.

    Only the groups' sizes meet in one place; groups of one size are dealt as the greedy rule would."""
    from itertools import groupby

    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    kinds = [(r.n, r["count"]) for r in sizes.groupBy("n").count().orderBy(F.desc("n")).collect()]  # one row a size
    load, rows = [0] * k, []
    for n, many in kinds:
        cycle, seen = [], {}
        i = 0
        while i < many:
            state = tuple(x - min(load) for x in load)
            if state in seen:  # the rule repeats from here on
                start = seen[state]
                period = i - start
                turns = (many - i) // period
                for f in cycle[start:]:
                    load[f] += n * turns
                rows.append((n, start, period, cycle[:]))
                left = (many - i) % period
                for f in cycle[start : start + left]:
                    load[f] += n
                break
            seen[state] = i
            f = load.index(min(load))
            load[f] += n
            cycle.append(f)
            i += 1
        else:
            rows.append((n, many, 1, cycle + [0]))
    rules = df.sparkSession.createDataFrame(rows, "n long, start int, period int, cycle array<int>")
    ranked = sizes.withColumn("i", F.row_number().over(Window.partitionBy("n").orderBy(group)) - 1)
    at = F.expr("CAST(IF(i < start, i, start + (i - start) % period) AS INT)")
    return ranked.join(rules, "n").withColumn("fold", F.element_at("cycle", at + 1)).select(group, "n", "fold")


def grouped(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    return df.join(group_table(df, group, k).select(group, "fold"), group)


def straddling(df: DataFrame, group: str) -> DataFrame:
    """Groups that stand in several folds."""
    return df.groupBy(group).agg(F.count_distinct("fold").alias("folds")).agg(F.count("*").alias("n_groups"), F.count_if(F.col("folds") > 1).alias("straddling"))


def inner(df: DataFrame, row_id: str, k: int = 3) -> DataFrame:
    """outer_fold, row_id, inner_fold of each outer fold's training rows; df has fold."""
    folds = df.select("fold").distinct().withColumnRenamed("fold", "outer_fold")
    rows = df.select(F.col(row_id).alias("row_id"), "fold").join(F.broadcast(folds), F.col("fold") != F.col("outer_fold"))  # one row a fold
    inner_key = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("row_id").cast("string"), F.col("outer_fold").cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.select("outer_fold", "row_id", (inner_key % k).cast("int").alias("inner_fold"))


def split(df: DataFrame, row_id: str, y: str, task: str, group: str | None = None, k: int = 5) -> DataFrame:
    if group:
        return grouped(df, group, k)
    return plain(df, row_id, k) if task == "regression" else stratified(df, row_id, y, k)


#: Rows that seeded() takes at most: it permutes them on the driver.
SEEDED = 1_000_000


def seeded(df: DataFrame, row_id: str, y: str, k: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """df with folds as a seeded generator shuffles them, to repeat published figures of small tables.

    Each class gets as many rows of a fold as every k-th row of the sorted outcomes gives it; classes are shuffled in
    the order in which they first occur, rows taken by row id.
    """
    import numpy as np

    rows = df.select(row_id, y).orderBy(row_id).limit(SEEDED + 1).collect()
    if len(rows) > SEEDED:
        raise ValueError(f"seeded folds are for up to {SEEDED} rows; use stratified")
    places: dict = {}
    code = np.array([places.setdefault(r[1], len(places)) for r in rows])
    dealt, fold, rng = np.sort(code), np.empty(len(code), int), np.random.RandomState(seed)
    for c in range(len(places)):
        shares = np.repeat(np.arange(k), [int((dealt[i::k] == c).sum()) for i in range(k)])
        rng.shuffle(shares)
        fold[code == c] = shares
    given = df.sparkSession.createDataFrame([(r[0], int(f)) for r, f in zip(rows, fold, strict=True)], f"_id {df.schema[row_id].dataType.simpleString()}, {name} int")
    return df.join(given, df[row_id] == given["_id"]).drop("_id")
