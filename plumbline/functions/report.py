"""The whole audit, and its report in plain language and JSON."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as data_audit
from ..operators import codeaudit, select
from . import metrics

RUNGS = {"naive": "leaky: prepared on all rows, subjects ignored", "groupkfold": "honest: prepared in training folds, subjects kept together", "honest_randomsplit": "honest: prepared in training folds", "groupkfold_batchcorrected": "honest, batches centered in training folds"}


def audit(samples: DataFrame, task: str = "binary", group: bool = False, batch: bool = False, script: str | None = None, n_splits: int = 5, k_features: int = 20, nested: bool = True, model: str = "auto", outdir: str | None = None, date: str = "") -> dict:
    """Audit samples (row_id, y, group_id, batch_id, features): findings, the ladder, models, selection and tuning."""
    selection = preprocessing = None
    result: dict = {"task": task}
    if script is not None:
        found = codeaudit.audit_script(script)
        result["code"] = [dict(zip(("check", "severity", "line", "message", "code"), f, strict=True)) for f in found]
        if found[:1] and found[0][0] != "parse_error" or not found:
            worst = {f[0] for f in found if f[1] == "critical"}
            preprocessing, selection = "leaky_preprocessing" in worst, "leaky_feature_selection" in worst
    findings = data_audit.audit(samples, "y", "features", "group_id" if group else None, "batch_id" if batch else None, selection, preprocessing, task)
    result["findings"] = [r.asDict(recursive=True) for r in findings.orderBy("seq").collect()]
    ready = select.with_folds(samples, task, group, n_splits)
    honest = "groupkfold" if group else "honest_randomsplit"
    rungs = ["naive", honest] + (["groupkfold_batchcorrected"] if batch else [])
    scores = select.cross_validate(ready, rungs, task, k_features)
    steps = {r.rung: (r["mean"], r["std"]) for r in metrics.ladder(scores.where(~F.isnan("score")), "rung").collect()}
    result["ladder"] = {r: steps[r] for r in rungs if r in steps}
    kinds = ("logreg", "hgb") if model == "auto" else (model,)
    oof = select.out_of_fold(ready, task, kinds, min(50, k_features * 5)).persist()
    if task == "binary":
        flat = oof.withColumn("p", F.col("proba")[0])
        by_kind = {r.kind: r.auc for r in metrics.auc(flat, "y", "p", "kind").collect()}
        best = max(kinds, key=lambda c: by_kind.get(c) or 0)
        result["model"] = {"selected": best, "candidates": by_kind, "auc": by_kind[best], **metrics.binary(flat.where(F.col("kind") == best)).first().asDict()}
        result["reliability"] = [r.asDict() for r in metrics.reliability(flat.where(F.col("kind") == best)).orderBy("bin").collect()]
        score = by_kind[best]
    elif task == "multiclass":
        result["model"] = metrics.multiclass(oof).first().asDict() | metrics.auc_ovr(oof).first().asDict()
        score = result["model"]["auc_ovr"]
    else:
        result["model"] = metrics.regression(oof.withColumn("pred", F.col("proba")[0])).first().asDict()
        score = result["model"]["r2"]
    oof.unpersist()
    result["inflation"] = steps["naive"][0] - score
    result["inflation_like_for_like"] = steps["naive"][0] - steps[honest][0]
    if nested:
        if task == "binary" and model == "auto":
            rows = select.nested_kinds(ready, kinds).collect()
            mean = sum(r.score for r in rows) / len(rows)
            result["model_selection"] = {"nested_auc": mean, "chosen": [r.kind for r in rows], "optimism": max(result["model"]["candidates"].values()) - mean}
        flat = select.grid_scores(ready, task).groupBy("place", "value", "k").agg(F.avg("score").alias("s")).orderBy(F.desc("s"), "place").first()
        inner = select.nested_grid(ready, task).agg(F.avg("score")).first()[0]
        result["tuning"] = {"flat": flat.s, "best_params": {"value": flat.value, "k": flat.k}, "nested": inner, "optimism": flat.s - inner}
    if outdir:
        Path(outdir).mkdir(parents=True, exist_ok=True)
        Path(outdir, "report.md").write_text(render(result, date))
        Path(outdir, "results.json").write_text(json.dumps(result, indent=2, default=float))
    return result


def render(result: dict, date: str = "") -> str:
    """Markdown; the same result and date give the same bytes."""
    out = [f"# Can this result be believed?{f' ({date})' if date else ''}", "", f"Task: {result['task']}.", ""]
    if "code" in result:
        out += ["## The script", *(f"- {f['severity']}: {f['check']}{f' (line {f["line"]})' if f['line'] else ''}: {f['message']}" for f in result["code"]), ""]
    out += ["## The data", *(f"- {f['severity']}: {f['check']}: {f['message']}" for f in result["findings"]), "", "## From leaky to honest", "", "| cross-validation | mean | sd |", "|-|-|-|"]
    out += [f"| {RUNGS[k]} | {m:.3f} | {s:.3f} |" for k, (m, s) in result["ladder"].items()]
    out += ["", "## The model", *(f"- {k}: {v:.4f}" if isinstance(v, float) else f"- {k}: {v}" for k, v in result["model"].items()), "", f"The leaky score is {result['inflation']:+.3f} off the honest one."]
    for key, title in (("model_selection", "Choosing the model"), ("tuning", "Tuning")):
        if key in result:
            out += ["", f"## {title}", f"Optimism: {result[key]['optimism']:+.3f}."]
    critical = {f["check"] for f in result["findings"] if f["severity"] == "critical"}
    advice = [text for check, text in (("batch_confound", "Balance batches over outcomes, or center them inside training folds."), ("subject_leakage", "Keep each subject's samples in one fold."), ("duplicate_rows", "Remove repeated samples before splitting.")) if check in critical]
    if advice:
        out += ["", "## What to do", *(f"{i}. {a}" for i, a in enumerate(advice, 1))]
    return "\n".join(out) + "\n"
