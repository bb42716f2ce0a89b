"""Published figures that can be reproduced: the synthetic dataset's ladder and findings, scripts read from files, closed forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import plumbline
from plumbline.functions import metrics
from plumbline.operators import audit, codeaudit, fit, folds, select
from plumbline.sources import ingest


@pytest.fixture(scope="module")
def biology(spark):
    return ingest.biology(spark).cache()


def means(scores):
    return {r.rung: (r["mean"], r["std"]) for r in metrics.ladder(scores, "rung").collect()}


def test_ladder_of_the_synthetic_dataset(biology):
    ready = folds.seeded(biology, "row_id", "y", name="naive")
    ready = ready.withColumn("fold", (F.col("group_id").cast("int") % 5))  # subjects are equally large: in turn, to the lightest fold
    got = means(select.cross_validate(ready, ["naive", "groupkfold", "groupkfold_batchcorrected"]))
    assert got["naive"] == pytest.approx((0.9796390, 0.0142585), abs=1e-6)
    assert got["groupkfold"] == pytest.approx((0.9195833, 0.1024831), abs=1e-6)
    assert got["groupkfold_batchcorrected"] == pytest.approx((0.9187500, 0.1015697), abs=1e-6)


def ties(n):
    """The order that an unstable quicksort (middle pivot, insertion below 17) leaves n equal keys in, reversed."""
    at, todo = list(range(n)), [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        while b - a > 16:
            mid, i, j = a + (b - a) // 2, a, b - 1
            at[mid], at[j] = at[j], at[mid]
            while True:
                i, j = i + 1, j - 1
                if i >= j:
                    break
                at[i], at[j] = at[j], at[i]
            at[i], at[b - 1] = at[b - 1], at[i]
            if i - a < b - i:
                todo.append((i + 1, b))
                b = i - 1
            else:
                todo.append((a, i - 1))
                a = i + 1
    return at[::-1]


def test_published_ladder_by_the_unstable_order_of_ties(biology):
    fold = {str(g): i % 5 for i, g in enumerate(ties(40))}
    ready = biology.withColumn("fold", F.create_map(*[F.lit(x) for kv in fold.items() for x in kv])[F.col("group_id")])
    got = means(select.cross_validate(ready, ["groupkfold", "groupkfold_batchcorrected"]))
    assert got["groupkfold"] == pytest.approx((0.9387500, 0.0608084), abs=1e-4)
    assert got["groupkfold_batchcorrected"] == pytest.approx((0.8885938, 0.0603741), abs=1e-4)


def test_findings_of_the_synthetic_dataset(spark, biology):
    a = audit.association(biology, "batch_id", "y").first()
    assert (a.n, a.dof, a.v) == (160, 1, pytest.approx(0.6744792, abs=1e-6))
    assert audit.p_value(spark, a.chi2, a.dof) == pytest.approx(1.4e-17, rel=0.05)
    found = audit.audit(biology, "y", group="group_id", batch="batch_id", selection_global=True, preprocessing_global=True)
    assert tuple(audit.summary(found).first()) == (4, 1)


def test_association_equals_the_long_sum(spark):
    r = np.random.default_rng(3)
    for rows, cols in ((2, 2), (3, 4), (2, 5)):
        b, y = r.integers(0, rows, 60), r.integers(0, cols, 60)
        y[b == 0] = 0  # leaves cells empty
        table = np.array([[((b == i) & (y == j)).sum() for j in range(cols)] for i in range(rows)], float)
        table = table[:, table.sum(axis=0) > 0]
        e = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / table.sum()
        off = np.abs(table - e)
        dof = (table.shape[0] - 1) * (table.shape[1] - 1)
        want = ((off - (np.minimum(0.5, off) if dof == 1 else 0)) ** 2 / e).sum()
        got = audit.association(spark.createDataFrame([(int(p), int(q)) for p, q in zip(b, y, strict=True)], "b int, y int"), "b", "y").first()
        assert (got.dof, got.chi2) == (dof, pytest.approx(want))


def test_scripts_are_read_from_files(spark, tmp_path):
    (tmp_path / "leaky.py").write_text("import numpy\nscaler = StandardScaler()\nsubject = df['subject_id'].values\nX = scaler.fit_transform(X)\nsel = SelectKBest(f, k=20)\nX = sel.fit_transform(X, y)\na, b = train_test_split(X)\ncv = StratifiedKFold(5)\n")
    cells = [{"cell_type": "code", "source": ["p = PCA(2)\n", "Z = p.fit_transform(X)"]}, {"cell_type": "markdown", "source": "text"}, {"cell_type": "code", "source": "a, b = train_test_split(Z)"}]
    (tmp_path / "book.ipynb").write_text(json.dumps({"cells": cells}))
    (tmp_path / "magic.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": "%matplotlib inline"}]}))
    got = {(r.path.rsplit("/", 1)[1], r.check, r.severity, r.line) for r in plumbline.audit_path(spark, str(tmp_path)).collect()}
    assert got == {("leaky.py", "leaky_preprocessing", "critical", 4), ("leaky.py", "leaky_feature_selection", "critical", 6), ("leaky.py", "subject_leakage", "critical", 7), ("book.ipynb", "leaky_preprocessing", "critical", 2), ("magic.ipynb", "parse_error", "info", 1)}
    sums = {r.path.rsplit("/", 1)[1]: (r.n_critical, r.n_warning, len(r.findings)) for r in codeaudit.summarize(codeaudit.audit_path(spark, str(tmp_path))).collect()}
    assert sums == {"leaky.py": (3, 0, 3), "book.ipynb": (1, 0, 1), "magic.ipynb": (0, 0, 1)}
    assert [r.check for r in plumbline.audit_code(spark, "x = 1").collect()] == ["no_split"]


def test_script_rules():
    found = lambda s: [(f[0], f[1], f[2]) for f in codeaudit.audit_script(s)]
    assert found("best = GridSearchCV(m, g).fit(X, y)") == [("no_split", "critical", None)]
    assert found("pid = d['pid']\ncv = GroupKFold(5)\ncross_val_score(m, X, y, cv=cv)") == []
    assert found("cv = GroupKFold(5)\ncross_val_score(m, X, y, cv=cv)") == [("subject_leakage", "ok", None)]
    assert found("mouse = d['mouse']\na = KFold(3)\nb = LeaveOneOut()\ncross_validate(m, X)") == [("subject_leakage", "critical", None)]
    assert found("cv = KFold(5)\nfor a, b in cv.split(X, y, who):\n    pass") == [("subject_leakage", "ok", 2)]
    assert found("a = StandardScaler().fit_transform(X); b = MinMaxScaler().fit_transform(X); train_test_split(a)\ntrain_test_split(b)") == [("leaky_preprocessing", "ok", 1)]
    assert found("n = NearMiss()\nX, y = n.fit_resample(X, y)\ntrain_test_split(X)") == [("leaky_resampling", "critical", 2)]


def test_ridge_equals_its_closed_form():
    r = np.random.default_rng(1)
    x, w = r.normal(size=(50, 4)), np.array([1.0, -2, 0.5, 0])
    y = x @ w + 3 + r.normal(size=50) * 0.1
    c = x - x.mean(axis=0)
    beta = np.linalg.solve(c.T @ c + np.eye(4), c.T @ (y - y.mean()))
    assert fit.Ridge(1.0).fit(x, y).predict(x) == pytest.approx(y.mean() + c @ beta)


def test_logistic_meets_its_conditions():
    r = np.random.default_rng(2)
    x = r.normal(size=(90, 3))
    for classes in (2, 4):
        y = r.integers(0, classes, 90)
        est = fit.Logistic(0.7).fit(x, y)
        p = est.predict_proba(x)
        off = p - (y[:, None] == est.classes_)
        assert off.sum(axis=0) == pytest.approx(np.zeros(classes), abs=1e-5)  # the intercepts are free
        assert p.sum(axis=1) == pytest.approx(np.ones(90))


def test_bundle_has_a_headline(spark):
    rows = spark.createDataFrame([(0, 0.1, [0.8, 0.1, 0.1]), (1, 0.7, [0.2, 0.5, 0.3]), (1, 0.4, [0.1, 0.2, 0.7]), (0, 0.5, [0.6, 0.3, 0.1])], "y int, p double, q array<double>")
    b = metrics.bundle(rows, "binary", "y", "p").first()
    assert (b.headline_name, b.headline) == ("AUC", 0.75)
    r = metrics.bundle(rows, "regression", "y", "p").first()
    assert r.headline == r.r2 and r.headline_name == "R2"
    m = metrics.bundle(rows.withColumn("y", F.when(F.col("p") == 0.4, 2).otherwise(F.col("y"))), "multiclass", "y", "q").first()
    assert (m.headline, m.headline_name) == (1.0, "AUC (macro-OVR)")


def test_reliability_bins_have_the_edges_of_equal_steps(spark):
    p = [0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.6, 0.7, 0.9, 1.0]
    got = {r.mean_p: r.bin for r in metrics.reliability(spark.createDataFrame([(1, x) for x in p], "y int, p double").withColumn("p", F.col("p")), bins=10).collect() if r.n == 1}
    want = np.clip(np.digitize(p, np.linspace(0, 1, 11)) - 1, 0, 9).tolist()
    assert all(got[x] == b for x, b in zip(p, want, strict=True) if want.count(b) == 1)


def test_xor_is_beyond_the_linear_model(spark):
    ready = folds.seeded(ingest.xor(spark).withColumn("batch_id", F.lit(None).cast("string")).withColumn("group_id", F.lit(None).cast("string")), "row_id", "y")
    got = metrics.auc(select.out_of_fold(ready, "binary").withColumn("p", F.col("proba")[0]), "y", "p", "kind")
    auc = {r.kind: r.auc for r in got.collect()}
    assert auc["hgb"] > 0.75 > 0.65 > auc["logreg"]
