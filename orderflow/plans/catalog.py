"""All catalogue queries and their SQL equivalents."""

from __future__ import annotations

from orderflow.plans import document_queries, document_sql, order_queries, order_sql
from orderflow.plans import stream_queries

QUERIES = order_queries.QUERIES | document_queries.QUERIES | stream_queries.QUERIES
SQL = order_sql.SQL | document_sql.SQL
# A stream must end up where the batch fold of the same events does.
SQL |= {
    "stream_step_fold": order_sql.SQL["step_fold"],
    "stream_step_fold_stateful": order_sql.SQL["step_fold"],
    "stream_step_fold_ttl": order_sql.SQL["step_fold"],
    "stream_step_notes": order_sql.SQL["step_notes"],
    "stream_late_events": order_sql.SQL["step_fold"],
    "stream_pickup": "SELECT doc_id % 8 AS eighth, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
    "stream_notifications": order_sql.SQL["completion_notifications"],
}
