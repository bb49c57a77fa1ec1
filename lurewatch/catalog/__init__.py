"""Registered queries, one module per family."""

from lurewatch.catalog import (  # noqa: F401
    history_queries, indicator_queries, mail_queries, model_queries, store_queries, stream_queries,
    verdict_queries)
