"""Query bindings over the driver's tables (``queries()``) and SQL oracles."""

from parcelgrid.plans import queries_crawl, queries_files, queries_ledger, queries_model, queries_pages, queries_paging, queries_urls  # noqa: F401  (registers queries)
from parcelgrid.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
