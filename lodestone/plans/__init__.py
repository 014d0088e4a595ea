"""Query modules; importing the package fills the catalog."""

from . import catalog, evaluation, ingest, retrieval, review, serving, suites, texts

__all__ = ["catalog", "evaluation", "ingest", "retrieval", "review", "serving", "suites", "texts"]
