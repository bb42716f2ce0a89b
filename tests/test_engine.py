import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import metrics, report
from plumbline.operators import audit, codeaudit, fit, folds, select
from plumbline.sources import ingest


def samples(spark, n=90, p=6, seed=3, signal=2.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = (x[:, 0] * signal + rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(i, int(y[i]), f"g{i // 3}", f"b{i % 2}", x[i].tolist()) for i in range(n)], "row_id long, y int, group_id string, batch_id string, features array<double>")


def test_labels(spark):
    def of(values, kind):
        df, positive = ingest.derive_label(spark.createDataFrame([(v,) for v in values], f"v {kind}"), "v")
        return [r.y for r in df.orderBy("v").collect()], positive

    assert of(["control", "disease"], "string") == ([0, 1], "disease")
    assert of(["a", "b"], "string") == ([0, 1], "b")
    assert of([1, 2], "int") == ([0, 1], "2")
    assert of(["x", "y", "z"], "string") == ([0, 1, 2], None)
    assert of([3, 4, 5], "int") == ([3, 4, 5], None)
    assert ingest.roles(["Diagnosis", "Plate", "pid"]) == {"label": "Diagnosis", "group": "pid", "batch": "Plate"}


def test_chi_square_with_yates(spark):
    rows = [(b, y) for b, y, n in ((0, 0, 52), (0, 1, 12), (1, 0, 12), (1, 1, 84)) for _ in range(n)]
    a = audit.association(spark.createDataFrame(rows, "b int, y int"), "b", "y").first()
    assert a.v == pytest.approx(0.6744791666666666, abs=1e-9)
    assert audit.p_value(spark, a.chi2, a.dof) == pytest.approx(1.444e-17, rel=1e-3)


def test_folds_keep_groups_and_cover_rows(spark):
    df = folds.grouped(samples(spark), "group_id")
    assert folds.straddling(df, "group_id").first().straddling == 0
    assert df.count() == 90
    sizes = [r["count"] for r in folds.stratified(samples(spark), "row_id", "y").groupBy("y", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 12


def test_empty_tables(spark):
    none = samples(spark).where("false")
    assert audit.duplicate_rows(none, ["features"]).first().duplicates == 0
    assert folds.stratified(none, "row_id", "y").count() == 0
    assert metrics.auc(none.withColumn("score", F.lit(1.0))).first().auc is None


def test_logistic_gradient_and_ridge():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 3)), rng.integers(0, 3, 80)
    m = fit.Logistic().fit(x, y)
    p = m.predict_proba(x)
    g = (p - (y[:, None] == m.classes_)).T @ x + m.w[:, :-1]
    assert np.abs(g).max() < 1e-6
    r = fit.Ridge(2.0).fit(x, x[:, 0])
    assert r.predict(x).shape == (80,)
    iso = fit.isotonic(np.array([1.0, 2, 3]), np.array([0, 1, 0]))
    assert iso(np.array([0.0, 2.5, 9])).tolist() == pytest.approx([0, 0.5, 0.5])


def test_permuted_labels_are_chance(spark):
    ready = select.with_folds(samples(spark, 120, 40, signal=0.0), "binary", True)
    got = {r.rung: r["mean"] for r in metrics.ladder(select.cross_validate(ready, ["naive", "groupkfold"], k=5), "rung").collect()}
    assert got["naive"] > got["groupkfold"] + 0.05


def test_boosted_trees_learn_xor():
    x = np.random.default_rng(0).normal(size=(400, 6))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(int)
    tr = np.arange(400) % 2 == 0
    p = lambda m: m.fit(x[tr], y[tr]).predict_proba(x[~tr])[:, 1]
    assert fit.auc(y[~tr], p(fit.Boosted())) > 0.85 > 0.65 > fit.auc(y[~tr], p(fit.Logistic()))


def test_code_audit():
    assert [f[0] for f in codeaudit.audit_script("x = 1")] == ["no_split"]
    late = "a, b = train_test_split(x)\ns = StandardScaler()\ns.fit(a)\n"
    assert [(f[0], f[1], f[2]) for f in codeaudit.audit_script(late)] == [("leaky_preprocessing", "ok", 3)]
    assert ingest.notebook_code('{"cells": [{"cell_type": "code", "source": ["a\\n", "b"]}, {"cell_type": "code", "source": "c"}, {"cell_type": "markdown", "source": "d"}]}') == "a\nb\n\nc"


def test_report_is_stable(spark, tmp_path):
    r = report.audit(samples(spark), group=True, batch=True, nested=False, model="logreg", outdir=str(tmp_path), date="2024-01-01")
    assert list(r["ladder"]) == ["naive", "groupkfold", "groupkfold_batchcorrected"]
    assert [f["check"] for f in r["findings"]][:5] == ["dimensionality", "class_balance", "duplicate_rows", "subject_leakage", "batch_confound"]
    assert (tmp_path / "report.md").read_text() == report.render(r, "2024-01-01")


def both_ways(monkeypatch, run, *keys):
    """Rows of run in the matrix form and in the long form."""
    out = []
    for most in (select.MOST_CELLS, 10):
        monkeypatch.setattr(select, "MOST_CELLS", most)
        out.append([tuple(r) for r in run().orderBy(*keys).collect()])
    return out


def test_large_samples_are_cross_validated(spark, monkeypatch):
    ready = select.with_folds(samples(spark, signal=0.7), "binary", True, 2).cache()
    small, large = both_ways(monkeypatch, lambda: select.cross_validate(ready, ["naive", "groupkfold_batchcorrected"], k=3), "rung", "fold")
    assert [r[:2] for r in large] == [r[:2] for r in small] and [r[2] for r in large] == pytest.approx([r[2] for r in small], abs=1e-4)
    price = ready.withColumn("y", F.col("features")[0] + F.col("features")[1] * F.col("features")[2])
    small, large = both_ways(monkeypatch, lambda: select.cross_validate(price, ["naive"], "regression", 3), "fold")
    assert [r[2] for r in large] == pytest.approx([r[2] for r in small], abs=1e-4)


@pytest.mark.parametrize("task, n", [("binary", 90), ("binary", 420), ("multiclass", 90)])
def test_large_samples_are_predicted(spark, monkeypatch, task, n):
    rows = samples(spark, n, signal=0.7)
    rows = rows.withColumn("y", (F.col("row_id") % 3).cast("int")) if task == "multiclass" else rows
    ready = select.with_folds(rows, task, True, 2).cache()
    small, large = both_ways(monkeypatch, lambda: select.out_of_fold(ready, task, ("logreg",), 3), "row_id")
    assert [r[:4] for r in large] == [r[:4] for r in small]
    assert np.array([r[4] for r in large]) == pytest.approx(np.array([r[4] for r in small]), abs=1e-3)


def test_large_samples_are_searched(spark, monkeypatch):
    ready = select.with_folds(samples(spark, signal=0.7), "binary", True, 2).cache()
    small, large = both_ways(monkeypatch, lambda: select.nested_grid(ready, "binary", [{"value": 0.1, "k": 2}, {"value": 1.0, "k": 4}]), "fold")
    assert [r[:3] for r in large] == [r[:3] for r in small] and [r[3] for r in large] == pytest.approx([r[3] for r in small], abs=1e-4)


def test_duplicate_rows_by_hash(spark):
    rows = [("a", [0.0, 1.0]), ("a", [-0.0, 1.0000000001]), ("a", [0.0, None]), ("a", [0.0, None]), (None, [0.0, 1.0]), (None, None), (None, None), ("", None), ("null", None), ("a", [float("nan")]), ("a", [float("nan")])]
    df = spark.createDataFrame(rows, "t string, v array<double>")
    assert audit.duplicate_rows(df, ["t", "v"]).first().duplicates == 4
    assert audit.duplicate_rows(df.where("false"), ["t", "v"]).first().duplicates == 0
