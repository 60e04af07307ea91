"""All named queries of the library, gathered from the modules of this package."""

from __future__ import annotations

from millrace.plans import (
    aggregate_queries,
    corpus_queries,
    fidelity_queries,
    harness_queries,
    join_queries,
    metric_queries,
    provenance_queries,
    review_queries,
    rule_queries,
    scalar_queries,
    selection_queries,
    sequence_queries,
    source_queries,
    state_queries,
    stream_queries,
)
from millrace.plans.book import Query

BOOKS = tuple(
    module.book
    for module in (
        sequence_queries,
        join_queries,
        metric_queries,
        review_queries,
        rule_queries,
        aggregate_queries,
        scalar_queries,
        corpus_queries,
        state_queries,
        harness_queries,
        source_queries,
        stream_queries,
        fidelity_queries,
        selection_queries,
        provenance_queries,
    )
)


def queries() -> dict[str, Query]:
    return {name: query for book in BOOKS for name, query in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
