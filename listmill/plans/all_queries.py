"""Imports every module that registers queries."""

import importlib

MODULES = [
    "search_queries", "report_queries", "quality_queries", "text_queries", "page_queries", "identity_queries",
    "rank_queries", "merge_queries", "publish_queries", "feed_queries",
]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"listmill.plans.{m}")
