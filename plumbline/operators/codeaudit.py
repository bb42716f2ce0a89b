"""Static audit of an analysis script: parsed, never run."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest

FINDING = "check string, severity string, line int, message string, code string"
# Names of the functions and classes that the audit knows, and words of a subject column.
SPLITS = {"train_test_split"}
SPLITTERS = {"KFold", "StratifiedKFold", "ShuffleSplit", "StratifiedShuffleSplit", "RepeatedKFold", "RepeatedStratifiedKFold", "LeaveOneOut"}
GROUP_SPLITTERS = {"GroupKFold", "StratifiedGroupKFold", "LeaveOneGroupOut", "GroupShuffleSplit"}
HELPERS = {"cross_val_score", "cross_validate", "cross_val_predict"}
SCALERS = {"StandardScaler", "MinMaxScaler", "RobustScaler", "MaxAbsScaler", "Normalizer", "PowerTransformer", "QuantileTransformer"}
IMPUTERS = {"SimpleImputer", "KNNImputer", "IterativeImputer"}
SELECTORS = {"SelectKBest", "SelectPercentile", "SelectFdr", "SelectFpr", "SelectFwe", "RFE", "RFECV", "SelectFromModel", "VarianceThreshold", "SequentialFeatureSelector", "GenericUnivariateSelect"}
DECOMPOSITIONS = {"PCA", "TruncatedSVD", "KernelPCA", "FastICA", "NMF"}
RESAMPLERS = {"SMOTE", "ADASYN", "RandomOverSampler", "RandomUnderSampler", "BorderlineSMOTE", "SMOTEENN", "SMOTETomek", "NearMiss"}
PIPELINES = {"Pipeline", "make_pipeline", "make_column_transformer", "ColumnTransformer"}
GROUP_COLUMN = re.compile(r"(subject|patient|donor|animal|mouse|participant|individual|sample_id|subj|pid|group)", re.IGNORECASE)

#: For each kind of fit: its class names, the finding's name, what it is, and what is wrong with it before a split.
KINDS = (
    (SCALERS, "leaky_preprocessing", "scaling", "test rows shaped the transformation"),
    (IMPUTERS, "leaky_preprocessing", "imputation", "test rows shaped the transformation"),
    (SELECTORS, "leaky_feature_selection", "feature selection", "features were chosen with the test rows in view"),
    (DECOMPOSITIONS, "leaky_preprocessing", "decomposition", "test rows shaped the components"),
    (RESAMPLERS, "leaky_resampling", "resampling", "copies of a row reach both sides"),
)
KIND = {name: kind for kind in KINDS for name in kind[0]}


def _name(node) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def audit_script(source: str) -> list[tuple]:
    """(check, severity, line, message, code) of each finding.

    The split's line is the first of train_test_split, or of a named splitter's split if none stands before; of
    several splitters the last one made counts. A call is classified by its own name and, for fits, by the class
    that its owner was made from.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [("parse_error", "info", getattr(e, "lineno", None), "the script can't be parsed, so it was not analysed", "")]
    lines = source.split("\n")
    code = lambda n: lines[n - 1].strip() if n and n <= len(lines) else ""
    made: dict[str, str] = {}
    split_line = splitter = None
    helper = pipeline = grouped = subjects = False
    fits: list[tuple[int, tuple]] = []
    nodes = sorted((n for n in ast.walk(tree) if isinstance(n, (ast.Assign, ast.Call))), key=lambda n: (n.lineno, isinstance(n, ast.Call), n.col_offset))
    for n in nodes:
        if isinstance(n, ast.Assign):
            text = ast.get_source_segment(source, n) or ""
            subjects |= bool(GROUP_COLUMN.search(text)) and ("[" in text or ".loc" in text or "groups" in text.lower())
            if isinstance(n.value, ast.Call) and (cls := _name(n.value.func)):
                made.update((t.id, cls) for t in n.targets if isinstance(t, ast.Name))
            continue
        f = _name(n.func)
        owner = n.func.value if isinstance(n.func, ast.Attribute) else None
        named = owner.id if isinstance(owner, ast.Name) else None
        grouped |= any(k.arg == "groups" for k in n.keywords)
        pipeline |= f in PIPELINES
        helper |= f in HELPERS
        if f in SPLITS:
            split_line = min(split_line or n.lineno, n.lineno)
        elif f in SPLITTERS or f in GROUP_SPLITTERS:
            splitter = f
        elif f == "split" and named:
            split_line = split_line or n.lineno
            grouped |= len(n.args) >= 3
        elif f in ("fit", "fit_transform"):
            cls = made.get(named) if named else _name(owner.func) if isinstance(owner, ast.Call) else None
            if cls in KIND:
                fits.append((n.lineno, KIND[cls]))
        elif f == "fit_resample" and named:
            fits.append((n.lineno, KIND["SMOTE"]))
    out: list[tuple] = []
    if split_line is None and not helper:
        out.append(("no_split", "critical", None, "no split into training and test rows was found", ""))
    for line, (_, check, what, why) in fits:
        if split_line is None or line < split_line:
            out.append((check, "critical", line, f"{what} sees all rows, {'before the split' if split_line else 'without a split'}: {why}", code(line)))
        else:
            out.append((check, "ok", line, f"{what} follows the split", code(line)))
    if subjects and not grouped:
        if splitter in SPLITTERS or (splitter is None and split_line is not None):
            out.append(("subject_leakage", "critical", split_line, "there is a subject column, but the split ignores it", code(split_line)))
    elif splitter in GROUP_SPLITTERS or grouped:
        out.append(("subject_leakage", "ok", split_line, "the split keeps subjects together", code(split_line)))
    if pipeline:
        out.append(("good_practice", "info", None, "a pipeline fits preparation inside training folds", ""))
    return list(dict.fromkeys(out))


class _Audit:
    def eval(self, source: str):
        yield from audit_script(source or "")


def audit_scripts(scripts: DataFrame) -> DataFrame:
    """path and findings of each script in scripts (path, source)."""
    spark = scripts.sparkSession
    spark.udtf.register("audit_script", F.udtf(_Audit, returnType=FINDING))
    scripts.createOrReplaceTempView("plumbline_scripts")
    return spark.sql("SELECT s.path, a.* FROM plumbline_scripts s, LATERAL audit_script(s.source) a")


def flags(findings: DataFrame) -> DataFrame:
    """path with the two declared flags; null where the script could not be analysed."""
    critical = lambda c: F.max((F.col("check") == c) & (F.col("severity") == "critical"))
    unread = F.max(F.col("check") == "parse_error")
    return findings.groupBy("path").agg(F.when(~unread, critical("leaky_preprocessing")).alias("preprocessing_global"), F.when(~unread, critical("leaky_feature_selection")).alias("selection_global"))


def summarize(findings: DataFrame) -> DataFrame:
    """path, n_critical, n_warning and the findings of each script."""
    return findings.groupBy("path").agg(
        F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warning").alias("n_warning"),
        F.array_sort(F.collect_list(F.struct("line", "check", "severity", "message", "code"))).alias("findings"),
    )


def audit_path(spark: SparkSession, path: str) -> DataFrame:
    """Findings of every script and notebook under path."""
    return audit_scripts(ingest.read_scripts(spark, path))


def audit_code(spark: SparkSession, code: str) -> DataFrame:
    """Findings of a script given as text."""
    return audit_scripts(spark.createDataFrame([("code", code)], "path string, source string")).drop("path")
