"""A Spark engine that audits whether a model's reported performance can be believed."""

from importlib import import_module

#: Names of the package and where they are; executors import the package, so nothing is loaded before it is used.
_WHERE = {
    "audit": "functions.report", "render": "functions.report", "summary": "operators.audit",
    "audit_code": "operators.codeaudit", "audit_path": "operators.codeaudit", "audit_scripts": "operators.codeaudit", "summarize": "operators.codeaudit",
    "cross_validate": "operators.select", "nested_grid": "operators.select", "nested_kinds": "operators.select", "out_of_fold": "operators.select", "with_folds": "operators.select",
    "read_csv": "sources.ingest", "read_scripts": "sources.ingest", "samples": "sources.ingest",
}
__all__ = list(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)
