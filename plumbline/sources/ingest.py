"""Reading samples and preparing them: feature projection, column roles, outcome, task."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

# Column names that are identifiers, the roles' usual names, and outcomes that count as positive.
ID_COLUMNS = ("sample_id", "id", "index", "unnamed: 0")
LABEL_NAMES = ("diagnosis", "label", "outcome", "class", "target", "y")
GROUP_NAMES = ("patient_id", "subject", "subject_id", "donor", "patient", "pid")
BATCH_NAMES = ("plate", "batch", "site", "run", "lane")
POSITIVE = ("disease", "case", "positive", "pos", "1", "true", "yes", "tumor", "cancer", "abnormal")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, source) of every script or notebook under path."""
    return spark.read.format("binaryFile").load(path).selectExpr("path", "content").withColumn("source", F.udf(script_text, "string")("path", "content")).drop("content")


def script_text(path: str, content: bytes) -> str:
    """A script's text: UTF-8, else Latin-1; of a notebook its code cells, a blank line between them."""
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return notebook_code(text) if path.endswith(".ipynb") else text


def notebook_code(text: str) -> str:
    """Code cells of a notebook's JSON; text that is no JSON comes back as it is."""
    try:
        cells = json.loads(text).get("cells", [])
    except (ValueError, AttributeError):
        return text
    lines = [c.get("source", "") for c in cells if c.get("cell_type") == "code"]
    return "\n\n".join(x if isinstance(x, str) else "".join(x) for x in lines)


def feature_columns(df: DataFrame, mapped: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that are neither identifiers nor mapped to a role."""
    found = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in mapped and f.name.lower() not in ID_COLUMNS]
    if not found:
        raise ValueError("no numeric feature column is left")
    return found


def roles(columns: list[str]) -> dict[str, str | None]:
    def first(names):
        return next((c for c in columns if c.lower() in names), None)

    return {"label": first(LABEL_NAMES) or (columns[0] if columns else None), "group": first(GROUP_NAMES), "batch": first(BATCH_NAMES)}


def samples(df: DataFrame, row_id: str, y: str, features: list[str], group: str | None = None, batch: str | None = None) -> DataFrame:
    """row_id, y, group_id, batch_id, features; null or missing columns are refused."""
    for c in (row_id, y, *features, group, batch):
        if c is not None and c not in df.columns:
            raise ValueError(f"no column {c}; there are {df.columns}")
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    b = F.col(batch).cast("string") if batch else F.lit(None).cast("string")
    return df.select(F.col(row_id).alias("row_id"), F.col(y).alias("y"), g.alias("group_id"), b.alias("batch_id"), F.array(*[F.col(c).cast("double") for c in features]).alias("features"))


def aligned(x: DataFrame, meta: DataFrame, row_id: str = "row_id") -> DataFrame:
    """x with meta's columns; refuses rows that only one of them has."""
    odd = x.select(row_id).exceptAll(meta.select(row_id)).count() + meta.select(row_id).exceptAll(x.select(row_id)).count()
    if odd:
        raise ValueError(f"{odd} rows don't match")
    return x.join(meta, row_id)


def derive_label(df: DataFrame, column: str) -> tuple[DataFrame, str | None]:
    """df with y, and the value that became 1. Two numbers: the larger; two texts: the first known as positive, else
    the last; more texts: codes in order; more numbers: unchanged. Null outcomes stay null."""
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    values = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(3).collect()]
    if numeric and len(values) != 2:
        return df.withColumn("y", F.col(column)), None
    if len(values) == 2:
        named = [v for v in sorted(values, key=str) if str(v).lower() in POSITIVE]
        positive = max(values) if numeric else (named or sorted(values, key=str)[-1:])[0]
        return df.withColumn("y", F.when(F.col(column).isNotNull(), (F.col(column) == F.lit(positive)).cast("int"))), str(positive)
    codes = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("y", F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(codes, column, "left"), None


def detect_task(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """One row: distinct values (NaN left out) and the task they ask for."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    n = F.count_distinct(c)
    return df.agg(n.alias("n_distinct")).withColumn("task", F.when(F.col("n_distinct") == 2, "binary").when(F.col("n_distinct") <= most, "multiclass").otherwise("regression"))


def xor(spark: SparkSession) -> DataFrame:
    """400 samples whose outcome is whether two of 22 features differ in sign."""
    import numpy as np

    x = np.random.default_rng(0).normal(size=(400, 22))
    return spark.createDataFrame([(i, int((r[0] > 0) != (r[1] > 0)), r.tolist()) for i, r in enumerate(x)], "row_id long, y int, features array<double>")


def biology(spark: SparkSession, seed: int = 7) -> DataFrame:
    """160 samples of 800 features: 40 subjects, four replicates each, half an outcome's signal and a batch's that follows it.

    25 features differ by 1.3 between outcomes, 200 by 2.5 between batches; replicates share a subject's deviations.
    """
    import numpy as np

    rng = np.random.default_rng(seed)  # the order of draws is part of the dataset: outcomes, batches, noise, subjects
    outcome = rng.integers(0, 2, size=40)
    batch = rng.random(40) < np.where(outcome == 1, 0.62, 0.38)
    subject = np.arange(160) // 4
    x = rng.normal(size=(160, 800))
    x[:, :25] += 1.3 * outcome[subject, None]
    x += rng.normal(scale=0.5, size=(40, 800))[subject]
    x[:, 50:250] += 2.5 * batch[subject, None]
    rows = [(i, int(outcome[s]), str(s), str(int(batch[s])), x[i].tolist()) for i, s in enumerate(subject.tolist())]
    return spark.createDataFrame(rows, "row_id long, y int, group_id string, batch_id string, features array<double>")
