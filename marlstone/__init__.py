"""A Spark-native research data engine: checked raw snapshots to audited, query-ready tables."""

_API = ("dataset_metadata", "list_datasets", "load_dataset", "named_query", "query", "validation_report")
__all__ = [*_API, "run_pipeline"]


def __getattr__(name: str):
    """Callables are imported when first asked for, so that importing the package starts nothing."""
    if name in _API:
        from . import api

        return getattr(api, name)
    if name == "run_pipeline":
        from .plans.ingest import run_pipeline

        return run_pipeline
    raise AttributeError(name)
