"""Mixing sources to target weights: hash-random keys, a sort by key ranges in each source, prefix sums, an exact cut.

Sources get targets by weight, none above `most` times its own size; what a target loses to that limit is shared
again by weight. In each source documents stand in the order of a hash of their id. The key's range is cut into
so many equal parts that a hot source spreads over many tasks; sums of the parts give each part's offset, a
window in each part the prefix sum. The mix takes whole epochs of a source, then documents from the front until
the budget, floor(target), is met exactly: the document across the cut gives only the words still missing.

Defined results: null text has size 0; a null source is a source of its own, last in order; null ids and
repeated rows count as rows; rows equal in key and size are taken in either order, which gives equal results;
when all sizes are 0, targets and taken are 0; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, store, table

WEIGHTS = (1, 2, 3)
MOST = 3
#: Rows of one key range, at most about so many.
RANGE_ROWS = 200_000


def word_count(text: str) -> F.Column:
    return F.expr(f"CAST(coalesce(size(filter(split(`{text}`, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')), 0) AS BIGINT)")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with idx, the place of each in code-point order, null last; no task sees them all."""
    order = [F.col("source").isNull(), F.col("source")]
    parted = store(
        sources.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "sources",
    )
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("pid").agg(F.count("*").alias("n")).select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return parted.join(offsets, "pid").select("source", "source_size", "n_docs", (F.col("offset") + F.col("at")).alias("idx"))


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size, n_docs) with weight and target."""
    ranked = store(_ranked(sources).withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:  # the level rises until no further source reaches its limit
        over = F.col("source_size") * most < F.lit(level) * F.col("weight")
        capped, active = ranked.agg(F.sum(F.when(over, F.col("source_size") * most).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if not active or level == (total - capped) / active:
            break
        level = (total - capped) / active
    return ranked.withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, source, size), and its other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "source", "size")]
    spark = docs.sparkSession
    slim = store(docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), *others, F.expr("CAST(conv(substr(md5(coalesce(CAST(doc_id AS STRING), '')), 1, 15), 16, 10) AS BIGINT)").alias("key")), "keys")
    aims = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most)
    rows = slim.count()
    per_range = min(RANGE_ROWS, max(1, rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    aims = store(aims.select(F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("n_docs") / per_range).cast("long").alias("ranges")), "targets")
    dealt = slim.join(aims, F.col("source").eqNullSafe(F.col("of"))).withColumn("part", F.shiftright(F.shiftright("key", 30) * F.col("ranges"), 30))
    ahead = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("of", "part").agg(F.sum("size").alias("in_part")).select(F.col("of").alias("o_of"), F.col("part").alias("o_part"), F.coalesce(F.sum("in_part").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("of", "part").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumn("upto", F.sum("size").over(inside))
        .join(store(offsets, "offsets"), F.col("of").eqNullSafe(F.col("o_of")) & (F.col("part") == F.col("o_part")))
        .withColumn("before", F.col("offset") + F.col("upto") - F.col("size"))
    )
    budget = F.floor("target").cast("long")
    return placed.select(
        "doc_id", "size", "source_size", "target", *others,
        F.when(F.col("source_size") == 0, F.lit(0).cast("long"))
        .otherwise(F.expr("floor(target) DIV source_size") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.expr("floor(target) % source_size") - F.col("before"))))
        .cast("long").alias("taken"),
    )


def sample(docs: DataFrame, weights=WEIGHTS, most: int = MOST, text: str = "text") -> DataFrame:
    """docs mixed: each row as often as the mix has epochs that reach it, and never cut; rows without words as often
    as there are whole epochs. Repeated rows count together."""
    keyed = docs.withColumn("_row", F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256))
    mixed = mix(keyed.select("doc_id", "source", word_count(text).alias("size"), "_row"), weights, most)
    epochs = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).when(F.col("source_size") > 0, F.expr("floor(target) DIV source_size")).otherwise(1)
    times = store(mixed.groupBy("_row").agg(F.sum(epochs).cast("int").alias("_times")).where("_times > 0"), "epochs")
    return keyed.dropDuplicates(["_row"]).join(times, "_row").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mix(docs.select("doc_id", "source", word_count("text").alias("size")))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM d GROUP BY source),
c AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS i FROM s),
r AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS active, sum(source_size) OVER () AS total FROM c),
l AS (SELECT coalesce(min_by(CAST(total - capped AS DOUBLE) / CAST(active AS DOUBLE), i), 0) AS level FROM r
      WHERE CAST(total - capped AS DOUBLE) / CAST(active AS DOUBLE) * weight <= 3 * source_size),
t AS (SELECT s.*, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM s, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (CAST(floor(target) AS BIGINT) // source_size) * size
    + greatest(0, least(size, CAST(floor(target) AS BIGINT) % source_size - before)) END AS BIGINT) AS taken FROM p
"""
