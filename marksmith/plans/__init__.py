"""Queries register themselves when their modules are imported."""

from . import file_queries, merge_queries, more_queries, queries, recovery_queries, repair_queries  # noqa: F401
