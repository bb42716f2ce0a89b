"""python -m plumbline MATRIX.csv [META.csv]: the whole audit of a table of samples, printed as a report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions import report
from .session import ship
from .sources import ingest


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description="Can a model's reported performance be believed?")
    p.add_argument("matrix", help="CSV with a row a sample: an id, numeric features, and the roles unless META has them")
    p.add_argument("meta", nargs="?", help="CSV with the same ids and the roles")
    p.add_argument("--id", help="id column; else the first that is named like one")
    p.add_argument("--label", help="outcome column; else guessed by name, as are the next two")
    p.add_argument("--group", help="subject column")
    p.add_argument("--batch", help="batch column")
    p.add_argument("--task", choices=("binary", "multiclass", "regression"), help="else told from the outcome")
    p.add_argument("--script", help="analysis script or notebook, audited too")
    p.add_argument("--fast", action="store_true", help="linear model alone")
    p.add_argument("--no-nested", action="store_true", help="without nested selection and tuning")
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--out", help="folder for report.md and results.json")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    ship(spark)
    x = ingest.read_csv(spark, args.matrix)
    row_id = args.id or next((c for c in x.columns if c.lower() in ingest.ID_COLUMNS), None)
    if row_id is None:
        raise SystemExit(f"name the id column by --id; there are {x.columns}")
    meta = ingest.read_csv(spark, args.meta) if args.meta else None
    found = ingest.roles([c for c in (meta or x).columns if c != row_id])
    label, group, batch = (given or found[role] for role, given in (("label", args.label), ("group", args.group), ("batch", args.batch)))
    features = ingest.feature_columns(x, tuple(c for c in (row_id, label, group, batch) if c))
    whole = ingest.aligned(x, meta, row_id) if meta is not None else x
    whole = whole.where(f"`{label}` IS NOT NULL")
    task = args.task or ingest.detect_task(whole, label).first().task
    y, _ = ingest.derive_label(whole, label) if task != "regression" else (whole.withColumn("y", whole[label]), None)
    source = None
    if args.script:
        with open(args.script, "rb") as f:
            source = ingest.script_text(args.script, f.read())
    result = report.audit(ingest.samples(y, row_id, "y", features, group, batch), task, bool(group), bool(batch), source, args.folds, nested=not args.no_nested, model="logreg" if args.fast else "auto", outdir=args.out)
    print(report.render(result))
    return result


if __name__ == "__main__":
    main()
