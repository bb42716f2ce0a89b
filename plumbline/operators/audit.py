"""Audit of a dataset: distributed counts against a taxonomy of leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "seq int, check string, severity string, message string, detail map<string,string>"


def shape(df: DataFrame, p: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select("n", F.lit(p).cast("long").alias("p"), F.when(F.lit(p) >= F.col("n"), "warning").otherwise("info").alias("severity"))


def class_balance(df: DataFrame, y: str) -> DataFrame:
    """One row: smallest class's share of the rows with an outcome, and the classes' number."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("k"))
    share = F.min("k") / F.sum("k")
    return counts.agg(F.count("*").alias("classes"), F.sum("k").alias("n"), F.min("k").alias("smallest"), F.round(share, 6).alias("share"), F.when(share < 0.15, "warning").otherwise("ok").alias("severity"))


def duplicate_rows(df: DataFrame, columns: list[str], decimals: int = 6) -> DataFrame:
    """Rows beyond the first of each kind; numbers are rounded, half to even.

    Texts and arrays are grouped by a 256-bit hash of the row, so that no text is shuffled."""
    kinds = dict(df.dtypes)
    zero = F.lit(0.0)  # added, it turns -0.0 into 0.0
    rounded = lambda c: F.transform(F.col(c), lambda v: F.bround(v.cast("double"), decimals) + zero) if kinds[c].startswith("array") else F.bround(c, decimals) + zero if kinds[c] in ("double", "float") else F.col(c)
    keys = [rounded(c).alias(c) for c in columns]
    if any(kinds[c].startswith("array") or kinds[c] in ("string", "binary") for c in columns):
        keys = [F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256).alias("_row")]
    counts = df.groupBy(*keys).agg(F.count("*").alias("k"))
    return counts.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicates")).withColumn("severity", F.when(F.col("duplicates") > 0, "critical").otherwise("ok"))


def subject_repeats(df: DataFrame, group: str) -> DataFrame:
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("k"))
    return counts.agg(F.count("*").alias("n_groups"), F.max("k").alias("most")).withColumn("severity", F.when(F.col("most") > 1, "critical").otherwise("ok"))


def crosstab(df: DataFrame, batch: str, y: str) -> DataFrame:
    """batch, y, n for every two values, those that never meet too: both sides are distinct values of the table."""
    both = df.where(F.col(batch).isNotNull() & F.col(y).isNotNull())
    cells = both.groupBy(F.col(batch).cast("string").alias("batch"), F.col(y).cast("string").alias("y")).agg(F.count("*").alias("n"))
    every = cells.groupBy().agg(F.collect_set("y").alias("ys"), F.collect_set("batch").alias("bs")).select(F.explode("bs").alias("batch"), "ys").select("batch", F.explode("ys").alias("y"))
    return every.join(cells, ["batch", "y"], "left").select("batch", "y", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def association(df: DataFrame, batch: str, y: str) -> DataFrame:
    """One row: n, dof, chi2 with Yates's correction at one degree of freedom, Cramér's V (null for one level).

    Cells that never occur need no row: without the correction chi2 is n (sum of O^2 / (row * column) - 1), and in a
    2 x 2 table all four cells are equally far from what is expected, so it follows from one cell and the margins.
    """
    both = df.where(F.col(batch).isNotNull() & F.col(y).isNotNull())
    cells = both.groupBy(F.col(batch).cast("string").alias("batch"), F.col(y).cast("string").alias("y")).agg(F.count("*").cast("double").alias("o"))
    rows, cols = cells.groupBy("batch").agg(F.sum("o").alias("row")), cells.groupBy("y").agg(F.sum("o").alias("col"))
    whole = cells.agg(F.sum("o").alias("n")).join(rows.agg(F.count("*").alias("r"), F.sum(1 / F.col("row")).alias("rs")), F.lit(True)).join(cols.agg(F.count("*").alias("c"), F.sum(1 / F.col("col")).alias("cs")), F.lit(True))  # a row each
    met = cells.join(rows, "batch").join(cols, "y").join(F.broadcast(whole.select("n")), F.lit(True))
    sums = met.agg(F.sum(F.col("o") * F.col("o") / (F.col("row") * F.col("col"))).alias("s"), F.max(F.abs(F.col("o") - F.col("row") * F.col("col") / F.col("n"))).alias("far"))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    yates = F.pow(F.col("far") - F.least(F.col("far"), F.lit(0.5)), 2) * F.col("n") * F.col("rs") * F.col("cs")
    chi2 = F.when(dof == 1, yates).when(dof == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1)))
    out = whole.join(sums, F.lit(True)).select(F.col("n").cast("long").alias("n"), dof.alias("dof"), chi2.alias("chi2"), F.least("r", "c").alias("k"))
    return out.withColumn("v", F.when(F.col("k") > 1, F.sqrt(F.col("chi2") / (F.col("n") * (F.col("k") - 1))))).drop("k")


def p_value(spark: SparkSession, chi2: float, dof: int) -> float:
    """Upper tail of the chi-square distribution."""
    return float(spark.sparkContext._jvm.org.apache.commons.math3.special.Gamma.regularizedGammaQ(dof / 2.0, chi2 / 2.0)) if dof else 1.0


def audit(df: DataFrame, y: str, features: str = "features", group: str | None = None, batch: str | None = None, selection_global: bool | None = None, preprocessing_global: bool | None = None, task: str = "binary") -> DataFrame:
    """Findings in their fixed order; the checks' sums are one row each."""
    spark, out = df.sparkSession, []

    def add(check, severity, message, **detail):
        out.append((len(out) + 1, check, severity, message, {k: str(v) for k, v in detail.items()}))

    n, p = df.agg(F.count("*"), F.max(F.size(features))).first()
    p = p or 0
    add("dimensionality", "warning" if p >= n else "info", f"{p} features for {n} samples", n=n, p=p)
    if task != "regression":
        b = class_balance(df, y).first()
        add("class_balance", b.severity, f"the smallest of {b.classes} classes has {b.smallest} of {b.n} samples", share=b.share)
    d = duplicate_rows(df, [features]).first()
    add("duplicate_rows", d.severity, f"{d.duplicates} samples repeat others", duplicates=d.duplicates)
    if group is None:
        add("subject_leakage", "warning", "no subject column: repeated subjects can't be ruled out")
    else:
        s = subject_repeats(df, group).first()
        add("subject_leakage", s.severity, f"{s.n_groups} subjects, up to {s.most} samples each", n_groups=s.n_groups, most=s.most)
    if batch is None:
        add("batch_confound", "info", "no batch column")
    else:
        a = association(df, batch, y).first()
        if a.v is None:
            add("batch_confound", "info", "batch or outcome has a single level")
        else:
            tail = p_value(spark, a.chi2, a.dof)
            add("batch_confound", "critical" if tail < 0.05 and a.v > 0.3 else "ok", f"Cramér's V {a.v:.3f}, p {tail:.2g}", v=a.v, p=tail)
    for check, flag, what in (("leaky_feature_selection", selection_global, "feature selection"), ("leaky_preprocessing", preprocessing_global, "preprocessing")):
        if flag is not None:
            add(check, "critical" if flag else "ok", f"{what} was {'' if flag else 'not '}fitted on all samples")
    return spark.createDataFrame(out, FINDING)


def summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warning").alias("n_warning"))
