"""The queries of the audit, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import audit, codeaudit, folds, prep, select
from ..sources import ingest
from ..sources.ingest import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums of doubles come in any order, so results are compared to six digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id")


def hash_mod(column: str, k: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({column} AS VARCHAR)), 1, 8) AS BIGINT) % {k}"


# Data audit ---------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, 64::BIGINT AS p, CASE WHEN 64 >= count(*) THEN 'warning' ELSE 'info' END AS severity FROM embeddings")
def shape_regime(spark, d):
    return audit.shape(table(spark, d, "embeddings"), 64)


BALANCE = "WITH c AS (SELECT {y} y, count(*) k FROM {t} WHERE {y} IS NOT NULL GROUP BY 1) SELECT count(*) AS classes, sum(k)::BIGINT AS n, min(k) AS smallest, round(min(k) / sum(k)::DOUBLE, 6) AS share, CASE WHEN min(k) / sum(k)::DOUBLE < 0.15 THEN 'warning' ELSE 'ok' END AS severity FROM c"


@query(BALANCE.format(y="quality", t="labels"))
def class_balance_quality(spark, d):
    return audit.class_balance(table(spark, d, "labels"), "quality")


@query(BALANCE.format(y="event_type", t="events"))
def class_balance_events(spark, d):
    return audit.class_balance(table(spark, d, "events"), "event_type")


REPEATED = "WITH c AS (SELECT count(*) k FROM {t} GROUP BY {c}) SELECT coalesce(sum(k - 1), 0)::BIGINT AS duplicates, CASE WHEN coalesce(sum(k - 1), 0) > 0 THEN 'critical' ELSE 'ok' END AS severity FROM c"


@query(REPEATED.format(t="documents", c="text"))
def duplicate_documents(spark, d):
    return audit.duplicate_rows(table(spark, d, "documents"), ["text"])


@query(REPEATED.format(t="lineitem", c="l_quantity, l_extendedprice, l_discount, l_tax"))
def duplicate_lineitem_features(spark, d):
    return audit.duplicate_rows(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(REPEATED.format(t="embeddings", c="list_transform(embedding, lambda x: round_even(x::DOUBLE, 6))"))
def duplicate_embeddings(spark, d):
    return audit.duplicate_rows(table(spark, d, "embeddings"), ["embedding"])


SUBJECTS = "WITH c AS (SELECT count(*) k FROM {t} WHERE {g} IS NOT NULL GROUP BY {g}) SELECT count(*) AS n_groups, max(k) AS most, CASE WHEN max(k) > 1 THEN 'critical' ELSE 'ok' END AS severity FROM c"


@query(SUBJECTS.format(t="events", g="user_id"))
def subject_repeats_events(spark, d):
    return audit.subject_repeats(table(spark, d, "events"), "user_id")


@query(SUBJECTS.format(t="orders", g="o_custkey"))
def subject_repeats_orders(spark, d):
    return audit.subject_repeats(table(spark, d, "orders"), "o_custkey")


@query("""WITH d AS (SELECT lang, quality FROM documents JOIN labels USING (doc_id)), e AS (SELECT * FROM (SELECT DISTINCT lang FROM d), (SELECT DISTINCT quality FROM d))
SELECT e.lang AS batch, e.quality::VARCHAR AS y, count(d.lang) AS n FROM e LEFT JOIN d ON d.lang = e.lang AND d.quality = e.quality GROUP BY ALL""")
def batch_crosstab(spark, d):
    return audit.crosstab(labelled(spark, d), "lang", "quality")


CHI = """WITH s AS ({src}), e AS (SELECT b, y FROM (SELECT DISTINCT b FROM s), (SELECT DISTINCT y FROM s)),
o AS (SELECT e.b, e.y, count(s.b)::DOUBLE n FROM e LEFT JOIN s ON s.b = e.b AND s.y = e.y GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY b) * sum(n) OVER (PARTITION BY y) / sum(n) OVER () x, sum(n) OVER () t FROM o),
k AS (SELECT count(DISTINCT b) r, count(DISTINCT y) c FROM o),
z AS (SELECT sum(power(abs(n - x) - CASE WHEN (r - 1) * (c - 1) = 1 THEN least(0.5, abs(n - x)) ELSE 0 END, 2) / x) chi2, any_value(t) t, any_value(r) r, any_value(c) c FROM m, k)
SELECT t::BIGINT AS n, ((r - 1) * (c - 1))::BIGINT AS dof, round(chi2, 6) AS chi2, round(sqrt(chi2 / (t * (least(r, c) - 1))), 6) AS v FROM z"""


@query(CHI.format(src="SELECT l_returnflag b, l_linestatus y FROM lineitem"))
def batch_cramers_v(spark, d):
    return rounded(audit.association(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query(CHI.format(src="SELECT toxic b, quality y FROM labels"))
def batch_chi2_yates(spark, d):
    return rounded(audit.association(table(spark, d, "labels"), "toxic", "quality"))


@query(CHI.format(src="SELECT source b, quality y FROM documents JOIN labels USING (doc_id)"))
def batch_source_quality(spark, d):
    return rounded(audit.association(labelled(spark, d), "source", "quality"))


@query()
def audit_findings(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), F.col("embedding").alias("features"))
    return audit.audit(rows, "y", selection_global=True, preprocessing_global=False).drop("detail")


@query("""WITH e AS (SELECT label, list_transform(embedding, lambda x: round_even(x::DOUBLE, 6)) AS v FROM embeddings),
d AS (SELECT count(*) - count(DISTINCT v) AS twice, count(*) AS n, max(len(v)) AS p FROM e),
c AS (SELECT label, count(*) AS k FROM e WHERE label IS NOT NULL GROUP BY label), b AS (SELECT min(k) / sum(k) AS share FROM c)
SELECT ((twice > 0)::INT + 1)::BIGINT AS n_critical, ((p >= n)::INT + (share < 0.15)::INT + 1)::BIGINT AS n_warning FROM d, b""")
def audit_summary(spark, d):
    """Findings of a whole table, counted: shape, balance, repeats, no subject column, selection on all samples."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), F.col("embedding").alias("features"))
    return audit.summary(audit.audit(rows, "y", selection_global=True, preprocessing_global=False))


# Outcome and features -----------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT event_type) AS n_distinct, CASE WHEN count(DISTINCT event_type) = 2 THEN 'binary' WHEN count(DISTINCT event_type) <= 20 THEN 'multiclass' ELSE 'regression' END AS task FROM events")
def detect_task_events(spark, d):
    return ingest.detect_task(table(spark, d, "events"), "event_type")


@query("SELECT count(DISTINCT p_retailprice) AS n_distinct, CASE WHEN count(DISTINCT p_retailprice) = 2 THEN 'binary' WHEN count(DISTINCT p_retailprice) <= 20 THEN 'multiclass' ELSE 'regression' END AS task FROM part")
def detect_task_price(spark, d):
    return ingest.detect_task(table(spark, d, "part"), "p_retailprice")


@query("SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS y FROM customer")
def derive_label(spark, d):
    return ingest.derive_label(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")[0]


@query("SELECT doc_id, toxic, toxic::INT AS y FROM labels")
def derive_label_binary(spark, d):
    return ingest.derive_label(table(spark, d, "labels").select("doc_id", "toxic"), "toxic")[0]


@query("SELECT l_orderkey AS row_id, l_extendedprice AS y, NULL::VARCHAR AS group_id, l_linestatus AS batch_id, l_quantity + l_discount + l_tax AS total FROM lineitem")
def feature_projection(spark, d):
    rows = ingest.samples(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], None, "l_linestatus")
    return rows.withColumn("total", F.expr("features[0] + features[1] + features[2]")).drop("features")


@query("SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL AND isfinite(c_acctbal)")
def complete_features(spark, d):
    rows = ingest.samples(table(spark, d, "customer"), "c_custkey", "c_mktsegment", ["c_acctbal", "c_nationkey"])
    return rows.where(F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v))).select(F.col("row_id").alias("c_custkey"))


# Folds --------------------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, ({hash_mod('o_orderkey', 5)})::INT AS fold FROM orders")
def fold_plain(spark, d):
    return folds.plain(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def fold_stratified(spark, d):
    return folds.stratified(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


GREEDY = """WITH RECURSIVE c AS (SELECT user_id g, count(*) n FROM events GROUP BY 1), o AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) i FROM c),
r AS (SELECT 0::BIGINT i, NULL::BIGINT g, NULL::BIGINT n, NULL::BIGINT f, [0, 0, 0, 0, 0]::BIGINT[] ld UNION ALL
 SELECT o.i, o.g, o.n, list_position(r.ld, list_min(r.ld)) - 1, list_transform(r.ld, lambda v, j: CASE WHEN j = list_position(r.ld, list_min(r.ld)) THEN v + o.n ELSE v END) FROM r JOIN o ON o.i = r.i + 1)
"""


@query(GREEDY + "SELECT g AS user_id, n, f::INT AS fold FROM r WHERE g IS NOT NULL")
def fold_group_greedy(spark, d):
    return folds.group_table(table(spark, d, "events"), "user_id")


@query("SELECT count(DISTINCT user_id) AS n_groups, 0::BIGINT AS straddling FROM events")
def fold_straddle_check(spark, d):
    return folds.straddling(folds.grouped(table(spark, d, "events").select("event_id", "user_id"), "user_id"), "user_id")


@query(f"""WITH f AS (SELECT c_custkey, ({hash_mod('c_custkey', 5)})::INT AS fold FROM customer), o AS (SELECT DISTINCT fold AS outer_fold FROM f)
SELECT outer_fold, c_custkey AS row_id, (CAST('0x' || substr(md5(c_custkey::VARCHAR || '|' || outer_fold::VARCHAR), 1, 8) AS BIGINT) % 3)::INT AS inner_fold FROM f JOIN o ON fold <> outer_fold""")
def fold_inner(spark, d):
    return folds.inner(folds.plain(table(spark, d, "customer"), "c_custkey"), "c_custkey")


# Preparation --------------------------------------------------------------------------------------------------------

CELLS = f"WITH x AS (SELECT vec_id AS row_id, label AS y, ({hash_mod('vec_id', 5)})::INT AS fold, unnest(range(len(embedding)))::INT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), o AS (SELECT DISTINCT fold AS outer_fold FROM x), tr AS (SELECT x.*, outer_fold FROM x JOIN o ON x.fold <> outer_fold)"


def embedding_cells(spark, d):
    return prep.cells(folds.plain(table(spark, d, "embeddings").withColumnRenamed("label", "y"), "vec_id"), "vec_id", "embedding", "y", "fold")


@query(CELLS + " SELECT j, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM x GROUP BY j")
def scale_global(spark, d):
    return rounded(prep.scaling(embedding_cells(spark, d)))


@query(CELLS + " SELECT outer_fold AS outer, j, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM tr GROUP BY ALL")
def scale_in_fold(spark, d):
    return rounded(prep.scaling(prep.training(embedding_cells(spark, d)), "outer"))


EVENTS = f"WITH e AS (SELECT event_id, event_type AS batch, value AS v, ({hash_mod('event_id', 5)})::INT AS fold FROM events WHERE value IS NOT NULL), o AS (SELECT DISTINCT fold AS outer_fold FROM e), tr AS (SELECT e.*, outer_fold FROM e JOIN o ON e.fold <> outer_fold)"


@query(EVENTS + ", b AS (SELECT outer_fold, batch, avg(v) m FROM tr GROUP BY ALL), g AS (SELECT outer_fold, avg(v) m FROM tr GROUP BY ALL) SELECT event_id AS row_id, e.fold, 0 AS j, round(v - coalesce(b.m, g.m), 6) AS centered FROM e LEFT JOIN b ON b.outer_fold = e.fold AND b.batch = e.batch JOIN g ON g.outer_fold = e.fold")
def batch_center_in_fold(spark, d):
    rows = folds.plain(table(spark, d, "events").where("value IS NOT NULL").withColumn("x", F.array("value")).withColumnRenamed("event_type", "batch"), "event_id")
    return rounded(prep.centered(prep.cells(rows, "event_id", "x", "fold", "batch")))


ANOVA = ", g AS (SELECT {by} j, y, count(*) n, avg(v) m, var_pop(v) * count(*) ss FROM {t} GROUP BY ALL), s AS (SELECT {by} j, sum(n * m) / sum(n) gm FROM g GROUP BY ALL), f AS (SELECT {by} j, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f FROM g JOIN s USING ({by} j) GROUP BY ALL)"


@query(CELLS + ANOVA.format(by="", t="x") + " SELECT j, round(f, 6) AS f FROM f")
def anova_f(spark, d):
    return rounded(prep.anova_f(embedding_cells(spark, d)))


@query(CELLS + ANOVA.format(by="outer_fold,", t="tr") + " SELECT outer_fold AS outer, j, round(f, 6) AS f FROM f")
def anova_f_in_fold(spark, d):
    return rounded(prep.anova_f(prep.training(embedding_cells(spark, d)), "outer"))


@query(CELLS + ANOVA.format(by="", t="x") + " SELECT j, round(f, 6) AS f FROM f QUALIFY row_number() OVER (ORDER BY f DESC NULLS LAST, j DESC) <= 20")
def topk_global(spark, d):
    return rounded(prep.top_k(prep.anova_f(embedding_cells(spark, d)), 20))


@query(CELLS + ANOVA.format(by="outer_fold,", t="tr") + " SELECT outer_fold AS outer, j, round(f, 6) AS f FROM f QUALIFY row_number() OVER (PARTITION BY outer_fold ORDER BY f DESC NULLS LAST, j DESC) <= 20")
def topk_in_fold(spark, d):
    return rounded(prep.top_k(prep.anova_f(prep.training(embedding_cells(spark, d)), "outer"), 20, "outer"))


LINES = "WITH x AS (SELECT l_orderkey, l_extendedprice y, unnest([0, 1, 2]) j, unnest([l_quantity, l_discount, l_tax]) v FROM lineitem), r AS (SELECT j, power(corr(v, y), 2) r2, count(*) n FROM x GROUP BY j)"


@query(LINES + " SELECT j, round(r2 / (1 - r2) * (n - 2), 4) AS f FROM r")
def regression_f(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("y"), F.array("l_quantity", "l_discount", "l_tax").alias("x"))
    return rounded(prep.regression_f(prep.cells(rows, "l_orderkey", "x", "y")), 4)


@query("WITH v AS (SELECT unnest(range(len(embedding)))::INT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT j, round(var_samp(v), 6) AS f FROM v GROUP BY j QUALIFY row_number() OVER (ORDER BY var_samp(v) DESC, j DESC) <= 16")
def variance_filter(spark, d):
    return rounded(prep.top_k(embedding_cells(spark, d).groupBy("j").agg(F.var_samp("v").alias("f")), 16))


# Metrics ------------------------------------------------------------------------------------------------------------

AUC = "WITH s AS ({src}), r AS (SELECT {by} y, rank() OVER ({p} ORDER BY s) + (count(*) OVER (PARTITION BY {by} s) - 1) / 2.0 rk FROM s) SELECT {by} round(((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))))::DOUBLE, 6) AS auc FROM r {g}"


@query(AUC.format(src="SELECT quality y, n_chars s FROM labels JOIN documents USING (doc_id)", by="", p="", g=""))
def auc_pooled(spark, d):
    return rounded(metrics.auc(labelled(spark, d), "quality", "n_chars"))


@query(AUC.format(src="SELECT (event_type = 'error')::INT y, value s, (" + hash_mod("event_id", 5) + ")::INT fold FROM events WHERE value IS NOT NULL", by="fold,", p="PARTITION BY fold", g="GROUP BY fold"))
def auc_per_fold(spark, d):
    rows = folds.plain(table(spark, d, "events").where("value IS NOT NULL"), "event_id").withColumn("y", (F.col("event_type") == "error").cast("int"))
    return rounded(metrics.auc(rows, "y", "value", "fold"))


SCORED = "WITH s AS (SELECT quality y, ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS p FROM labels)"


def scored(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") * 7919) % 1000 / F.lit(1000.0)).alias("p"))


@query(SCORED + ", q AS (SELECT *, least(greatest(p, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) c FROM s) SELECT round(avg(power(p - y, 2)), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END), 6) AS log_loss FROM q")
def brier_log_loss(spark, d):
    return rounded(metrics.binary(scored(spark, d)))


@query(SCORED + " SELECT list_sum(list_transform(range(1, 10), lambda i: (p >= i * 0.1::DOUBLE)::INT))::INT AS bin, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y, count(*) AS n FROM s GROUP BY 1")
def reliability_curve(spark, d):
    return rounded(metrics.reliability(scored(spark, d)))


@query("WITH s AS (SELECT l_extendedprice y, l_quantity * 1500.0::DOUBLE p FROM lineitem) SELECT round(1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg(power(y - p, 2))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae FROM s")
def regression_metrics(spark, d):
    return rounded(metrics.regression(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("pred"))))


PROBA = "WITH raw AS (SELECT o_orderkey, list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS y, [1 + o_orderkey % 7, 1 + o_orderkey % 5, 1 + o_orderkey % 3] AS w FROM orders), s AS (SELECT y, list_transform(w, lambda x: x / list_sum(w)::DOUBLE) q FROM raw)"


def proba(spark, d):
    rows = table(spark, d, "orders").select((F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")) - 1).alias("y"), F.expr("array(1 + o_orderkey % 7, 1 + o_orderkey % 5, 1 + o_orderkey % 3)").alias("w"))
    return rows.select("y", F.expr("transform(w, x -> x / CAST(w[0] + w[1] + w[2] AS DOUBLE))").alias("proba"))


@query(PROBA + ", e AS (SELECT y, q, (list_position(q, list_max(q)) - 1 = y)::INT h FROM s), g AS (SELECT y, avg(h) r FROM e GROUP BY y), b AS (SELECT avg(r) ba FROM g) SELECT round(avg(-ln(q[y + 1])), 6) AS log_loss, round(avg(list_sum(list_transform(q, lambda x, i: power(x - CASE WHEN i = y + 1 THEN 1 ELSE 0 END, 2)))), 6) AS brier, round(any_value(ba), 6) AS balanced_accuracy FROM e, b")
def multiclass_metrics(spark, d):
    return rounded(metrics.multiclass(proba(spark, d)))


@query(PROBA + ", x AS (SELECT y, unnest([0, 1, 2]) c, unnest(q) s FROM s), r AS (SELECT c, (y = c)::INT y, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0 rk FROM x), a AS (SELECT c, ((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))))::DOUBLE a FROM r GROUP BY c) SELECT round(avg(a), 6) AS auc_ovr FROM a")
def auc_ovr_macro(spark, d):
    return rounded(metrics.auc_ovr(proba(spark, d)))


FOLD_SCORES = "WITH s AS (SELECT o_orderpriority rung, (o_custkey % 5)::INT fold, avg(o_totalprice) / 1e6::DOUBLE score FROM orders GROUP BY ALL)"


def fold_scores(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("rung"), (F.col("o_custkey") % 5).cast("int").alias("fold")).agg((F.avg("o_totalprice") / 1e6).alias("score"))


@query(FOLD_SCORES + " SELECT rung, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM s GROUP BY rung")
def ladder_summary(spark, d):
    return rounded(metrics.ladder(fold_scores(spark, d), "rung"))


@query(FOLD_SCORES + ", m AS (SELECT rung, avg(score) m FROM s GROUP BY rung), g AS (SELECT avg(score) o FROM s) SELECT rung, round(m - o, 6) AS inflation, CASE WHEN m - o >= 0.05 THEN 'inflated' WHEN m - o <= -0.05 THEN 'deflated' ELSE 'consistent' END AS verdict FROM m, g")
def inflation_verdict(spark, d):
    scores = fold_scores(spark, d)
    overall = scores.agg(F.avg("score")).first()[0] or 0.0
    out = scores.groupBy("rung").agg((F.avg("score") - F.lit(overall)).alias("inflation"))
    return rounded(out.withColumn("verdict", select.verdict(F.col("inflation"))))


@query(FOLD_SCORES + " SELECT rung AS best, round(avg(score), 6) AS mean FROM s GROUP BY rung ORDER BY avg(score) DESC, rung LIMIT 1")
def best_candidate(spark, d):
    return rounded(metrics.ladder(fold_scores(spark, d), "rung").orderBy(F.desc("mean"), "rung").limit(1).select(F.col("rung").alias("best"), "mean"))


@query(FOLD_SCORES + " SELECT fold, rung AS best, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC, rung) = 1")
def nested_best_per_fold(spark, d):
    best = F.max(F.struct("score", "rung"))
    return rounded(fold_scores(spark, d).groupBy("fold").agg(best.alias("b")).select("fold", F.col("b.rung").alias("best"), F.col("b.score").alias("score")))


@query(FOLD_SCORES + ", f AS (SELECT max(m) flat FROM (SELECT avg(score) m FROM s GROUP BY rung)), n AS (SELECT avg(b) nested FROM (SELECT max(score) b FROM s GROUP BY fold)) SELECT round(flat, 6) AS flat, round(nested, 6) AS nested, round(flat - nested, 6) AS optimism FROM f, n")
def tuning_optimism(spark, d):
    scores = fold_scores(spark, d)
    flat = scores.groupBy("rung").agg(F.avg("score").alias("m")).agg(F.max("m")).first()[0]
    return rounded(scores.groupBy("fold").agg(F.max("score").alias("b")).agg(F.lit(flat).alias("flat"), F.avg("b").alias("nested")).withColumn("optimism", F.col("flat") - F.col("nested")))


# Models -------------------------------------------------------------------------------------------------------------


def vector_samples(spark, d, binary: bool = True) -> DataFrame:
    rows = table(spark, d, "embeddings").where("label IS NOT NULL")
    y = (F.col("label") % 2) if binary else F.col("label")
    return rows.select(F.col("vec_id").alias("row_id"), y.cast("int").alias("y"), (F.col("vec_id") % 50).cast("string").alias("group_id"), (F.col("vec_id") % 3).cast("string").alias("batch_id"), F.col("embedding").cast("array<double>").alias("features"))


@query()
def cv_logreg_ladder(spark, d):
    ready = select.with_folds(vector_samples(spark, d), "binary", True)
    return rounded(metrics.ladder(select.cross_validate(ready, ["naive", "groupkfold", "groupkfold_batchcorrected"]), "rung"), 4)


@query()
def oof_calibrated(spark, d):
    ready = select.with_folds(vector_samples(spark, d), "binary", True)
    return rounded(metrics.auc(select.out_of_fold(ready, "binary", ("logreg",)).withColumn("p", F.col("proba")[0]), "y", "p", "kind"), 4)


@query()
def multinomial_cv(spark, d):
    ready = select.with_folds(vector_samples(spark, d, False), "multiclass", True)
    return rounded(metrics.multiclass(select.out_of_fold(ready, "multiclass", k=20)), 4)


@query()
def ridge_cv(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("y"), F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("string").alias("batch_id"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 1000).cast("double")).alias("features"))
    return rounded(metrics.ladder(select.cross_validate(select.with_folds(rows, "regression", False), ["naive", "honest_randomsplit"], "regression"), "rung"), 4)


@query()
def nested_cv(spark, d):
    ready = select.with_folds(vector_samples(spark, d), "binary", True)
    return rounded(select.nested_grid(ready, "binary", [{"value": v, "k": k} for v in (0.1, 1.0) for k in (5, 20)]), 4)


@query()
def oof_calibrated_kinds(spark, d):
    ready = select.with_folds(vector_samples(spark, d), "binary", True)
    return rounded(metrics.auc(select.out_of_fold(ready, "binary").withColumn("p", F.col("proba")[0]), "y", "p", "kind"), 4)


@query()
def nested_kinds(spark, d):
    return rounded(select.nested_kinds(select.with_folds(vector_samples(spark, d), "binary", True)), 4)


@query()
def grid_best(spark, d):
    scores = select.grid_scores(select.with_folds(vector_samples(spark, d), "binary", True))
    means = scores.groupBy("place", "value", "k").agg(F.avg("score").alias("score"))
    return rounded(means.orderBy(F.desc("score"), "place").limit(1).select("value", "k", "score"), 4)


@query()
def nested_cv_full(spark, d):
    return rounded(select.nested_grid(select.with_folds(vector_samples(spark, d), "binary", True)), 4)


# Scripts ------------------------------------------------------------------------------------------------------------

SCRIPTS = {
    "leaky": "import pandas as pd\ndf = pd.read_csv('x.csv')\nsubject_id = df['subject_id']\nX, y = df.drop(columns='y'), df['y']\nX = StandardScaler().fit_transform(X)\nsel = SelectKBest(k=20)\nX = sel.fit_transform(X, y)\ncv = StratifiedKFold(5)\nfor tr, te in cv.split(X, y):\n    pass\n",
    "clean": "import pandas as pd\ndf = pd.read_csv('x.csv')\ngroups = df['patient_id']\npipe = Pipeline([('s', StandardScaler()), ('m', LogisticRegression())])\ncv = GroupKFold(5)\nprint(cross_val_score(pipe, df.drop(columns='y'), df['y'], groups=groups, cv=cv))\n",
    "unparsable": "%matplotlib inline\nprint(1)\n",
    "decomposed": "p = PCA(5)\nX = p.fit_transform(X)\na, b = train_test_split(X)\n",
    "search only": "best = GridSearchCV(model, grid).fit(X, y)\n",
    "group splitter only": "who = df['mouse']\ncv = GroupKFold(5)\nscore = cross_val_score(m, X, y, cv=cv)\n",
    "late": "a, b = train_test_split(X)\ns = RobustScaler()\ns.fit(a)\nsm = SMOTE()\na, c = sm.fit_resample(a, c)\n",
}


@query("""SELECT * FROM (VALUES ('clean', 'good_practice', 'info', NULL::INT), ('clean', 'subject_leakage', 'ok', NULL), ('leaky', 'leaky_feature_selection', 'critical', 7), ('leaky', 'leaky_preprocessing', 'critical', 5),
('leaky', 'subject_leakage', 'critical', 9), ('unparsable', 'parse_error', 'info', 1), ('decomposed', 'leaky_preprocessing', 'critical', 2), ('search only', 'no_split', 'critical', NULL),
('late', 'leaky_preprocessing', 'ok', 3), ('late', 'leaky_resampling', 'ok', 5)) t(path, "check", severity, line)""")
def code_audit(spark, d):
    ingest.ship(spark)
    return codeaudit.audit_scripts(spark.createDataFrame(list(SCRIPTS.items()), "path string, source string")).select("path", "check", "severity", "line")


@query("SELECT * FROM (VALUES ('leaky', true, true), ('clean', false, false), ('unparsable', NULL, NULL), ('decomposed', true, false), ('search only', false, false), ('late', false, false)) t(path, preprocessing_global, selection_global)")
def code_flags(spark, d):
    ingest.ship(spark)
    return codeaudit.flags(codeaudit.audit_scripts(spark.createDataFrame(list(SCRIPTS.items()), "path string, source string")))


def scripts_of_parts(spark, d) -> DataFrame:
    """A script for each part: what its lines do follows from remainders of its key."""
    k = "CAST(p_partkey AS BIGINT)"
    lines = [
        "'df = read(1)'", f"IF({k} % 2 = 0, \"subject = df['subject_id']\", \"other = df['plate']\")",
        f"CASE {k} % 3 WHEN 0 THEN 'X = StandardScaler().fit_transform(X)' WHEN 1 THEN 'X = PCA(5).fit_transform(X)' ELSE 'X = X + 1' END",
        f"CASE {k} % 5 WHEN 2 THEN 's = GroupKFold(5)' WHEN 3 THEN 's = KFold(5)' WHEN 4 THEN 'p = 1' ELSE 'a, b = train_test_split(X)' END",
        f"IF({k} % 7 < 3, 'Z = SelectKBest(k=3).fit_transform(X, y)', 'Z = X')",
    ]
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.expr(f"concat_ws('\\n', {', '.join(lines)})").alias("source"))


@query("""WITH k AS (SELECT p_partkey AS k, p_partkey % 5 < 2 AS split FROM part),
f AS (SELECT 'no_split' AS "check", 'critical' AS severity, NULL::INT AS line FROM k WHERE NOT split
UNION ALL SELECT 'leaky_preprocessing', 'critical', 3 FROM k WHERE k % 3 < 2
UNION ALL SELECT 'leaky_feature_selection', CASE WHEN split THEN 'ok' ELSE 'critical' END, 5 FROM k WHERE k % 7 < 3
UNION ALL SELECT 'subject_leakage', 'critical', CASE WHEN split THEN 4 END FROM k WHERE k % 2 = 0 AND (split OR k % 5 = 3)
UNION ALL SELECT 'subject_leakage', 'ok', NULL FROM k WHERE k % 2 = 1 AND k % 5 = 2)
SELECT "check", severity, line, count(*) AS n FROM f GROUP BY ALL""")
def code_audit_parts(spark, d):
    return codeaudit.audit_scripts(scripts_of_parts(spark, d)).groupBy("check", "severity", "line").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT p_partkey AS k, p_partkey % 5 < 2 AS split FROM part),
s AS (SELECT k, (NOT split)::INT + (k % 3 < 2)::INT + (k % 7 < 3 AND NOT split)::INT + (k % 2 = 0 AND (split OR k % 5 = 3))::INT AS n FROM k)
SELECT n::BIGINT AS n_critical, 0::BIGINT AS n_warning, count(*) AS scripts FROM s WHERE n > 0 GROUP BY n""")
def code_summary_parts(spark, d):
    return codeaudit.summarize(codeaudit.audit_scripts(scripts_of_parts(spark, d))).where("n_critical > 0").groupBy("n_critical", "n_warning").agg(F.count("*").alias("scripts"))
