"""What the operators share: reading tables, working tables in the cluster's shared folder, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

WORD = r"[^\x20\x09-\x0D]+"
SPACE = "\t\n\x0b\f\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and Spark is local, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    jvm = spark.sparkContext._jvm  # a folder without a scheme is one of the default file system
    at = jvm.org.apache.hadoop.fs.Path(found)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder for a working table; it goes when the driver's Python ends, unless drop() took it before."""
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}-{name}"
    atexit.register(_drop_quietly, spark, path)
    return path


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def passing():
    """Working tables stored inside go at the end, but for those given to keep()."""
    _scopes.append([])
    try:
        yield
    finally:
        drop(*_scopes.pop())


def keep(df: DataFrame) -> DataFrame:
    """A stored table that outlives the innermost passing()."""
    _scopes[-1][:] = [x for x in _scopes[-1] if x is not df]
    if len(_scopes) > 1:
        _scopes[-2].append(df)
    return df


def store(df: DataFrame, name: str, codec: str = "snappy", *more: DataFrame) -> DataFrame:
    """Write a working table and read it again: later steps start from files that outlive any executor.

    more: parts of the same table with the same columns, each written when the one before it is done.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    for part in (df, *more):
        part.write.mode("append").option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete working tables that no later step reads."""
    for df in tables:
        delete(df.sparkSession, df._plumbline_path)


@contextlib.contextmanager
def spent(spark: SparkSession):
    """Shuffle files of a write inside go when the write ends, not when the driver's JVM happens to collect their handles."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def small_batches(spark: SparkSession, rows: int = 4000, size: str = "3m") -> None:
    """Bound what one Arrow batch of long texts takes in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _forest(batches):
    """Union-find over the edges of one partition: one row for each node that isn't its tree's smallest."""
    import pyarrow as pa

    up: dict = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(p, p)
        return x

    schema = None
    for batch in batches:
        schema = schema or batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if up[x] != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, schema.field(0).type), pa.array([root(x) for x in part], schema.field(1).type)], names=["v", "r"])


def components(edges: DataFrame) -> DataFrame:
    """(v, c): each node that has an edge, with the smallest node of its connected component.

    edges: two columns of one orderable type (long or binary). Each round joins what every partition can by
    itself, then goes on with the roots alone; the edges left shrink to those between partitions' trees. No
    component is gathered in a task: a partition holds the edges it was dealt, whatever they belong to.
    """
    u, v = edges.columns
    kind = edges.schema[u].dataType.simpleString()
    left = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    levels = []
    while True:
        trees = store(left.mapInArrow(_forest, f"v {kind}, r {kind}"), "trees")
        levels.append(store(trees.groupBy("v").agg(F.min("r").alias("p")), "parents"))
        roots = trees.select(F.col("r").alias("v")).distinct()
        again = store(
            trees.join(levels[-1], "v").where("r <> p").select(F.col("r").alias("u"), F.col("p").alias("v"))
            .union(levels[-1].join(roots, "v", "left_semi").select(F.col("v").alias("u"), F.col("p").alias("v")))
            .distinct(),
            "left",
        )
        drop(trees)
        if again.isEmpty():
            break
        left = again
    out = levels[-1].select("v", F.col("p").alias("c"))
    for below in reversed(levels[:-1]):
        above = out.select(F.col("v").alias("p"), "c")
        out = store(
            below.join(above, "p", "left").select("v", F.coalesce("c", "p").alias("c"))
            .union(out.join(below, "v", "left_anti").select("v", "c")),
            "labels",
        )
    everyone = out.select("v").union(out.select(F.col("c").alias("v"))).distinct()
    return everyone.join(out, "v", "left").select("v", F.coalesce("c", "v").alias("c"))
