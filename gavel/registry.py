"""All queries of the reference's operators, and their DuckDB twins."""

from __future__ import annotations


def _modules() -> list:
    from gavel.operators import queries_agenda, queries_artifacts, queries_bluf, queries_changes, queries_documents, queries_index, queries_matching, queries_merging, queries_people, queries_quality, queries_records, queries_scores, queries_search, queries_segmentation, queries_streams, queries_summaries

    return [queries_search, queries_records, queries_people, queries_quality, queries_merging, queries_agenda, queries_documents, queries_index, queries_matching, queries_scores, queries_summaries, queries_bluf, queries_artifacts, queries_segmentation, queries_changes, queries_streams]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
