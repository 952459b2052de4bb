"""Queries over the test tables, each with its SQL twin where SQL can say it.

A check is ``(callable(spark, sf_dir) -> DataFrame, sql or None)``.
"""

from __future__ import annotations


def all_checks() -> dict:
    from . import chunks, deltas, enrichment, files, indexed, keyword, relational, streams, vectors, videos, writers

    found: dict = {}
    for module in (vectors, enrichment, chunks, deltas, relational, keyword, videos, indexed, files, streams, writers):
        found.update(module.CHECKS)
    return found
