"""Problem 4 over the graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators.orphans import ForeignKey, orphan_cascade, orphan_report
from quillgraph.runtime import read

THREE = [
    ForeignKey("document_repository_link", "document_id", "scholarly_document"),
    ForeignKey("document_repository_link", "repository_id", "repository"),
    ForeignKey("repository_contributor", "developer_account_id", "developer_account"),
]
GRAPH = [
    *THREE,
    ForeignKey("repository_contributor", "repository_id", "repository"),
    ForeignKey("document_alternate_doi", "document_id", "scholarly_document"),
    ForeignKey("researcher_developer_account_link", "researcher_id", "researcher"),
    ForeignKey("researcher_developer_account_link", "developer_account_id", "developer_account"),
]


def _cascade(spark, d, keys):
    names = {n for fk in keys for n in (fk.table, fk.target)}
    return orphan_cascade({n: read(spark, d, n) for n in names}, keys)


def p4_found(spark, d):
    return _cascade(spark, d, THREE).where("kind = 'direct'").select("ref_table", "ref_column", "row_id")


def p4_report(spark, d):
    """Direct and inherited orphans per table, column and month; labelled units hang on documents, answers on units."""
    unit, answer = "cc_na_initial_unresolved_set", "cc_na_annotation"
    keys = [*GRAPH, ForeignKey(unit, "document_id", "scholarly_document"), ForeignKey(unit, "repository_id", "repository"), ForeignKey(unit, "developer_account_id", "developer_account"), ForeignKey(answer, "unit_id", unit, "unit_id")]
    names = {n for fk in keys for n in (fk.table, fk.target)}
    found = orphan_cascade({n: read(spark, d, n) for n in names}, keys, ids={unit: "unit_id", answer: "unit_id"}, times={unit: None, answer: "labelled_datetime"})
    return orphan_report(found)


QUERIES = {f.__name__: f for f in (p4_found, p4_report)}


def _direct(table, column, target, row="id", when="r.created_datetime"):
    late = f" OR t.created_datetime > {when}" if when else ""
    return (
        f"SELECT '{table}' AS ref_table, '{column}' AS ref_column, r.{row} AS row_id, {when or 'CAST(NULL AS TIMESTAMP)'} AS created, "
        f"CASE WHEN t.id IS NULL THEN 'missing' ELSE 'late' END AS reason FROM {table} r LEFT JOIN {target} t ON t.id = r.{column} "
        f"WHERE r.{column} IS NOT NULL AND (t.id IS NULL{late})"
    )


_ALL = " UNION ALL ".join([
    *(_direct(fk.table, fk.column, fk.target) for fk in GRAPH),
    *(_direct("cc_na_initial_unresolved_set", c, t, "unit_id", None) for c, t in (("document_id", "scholarly_document"), ("repository_id", "repository"), ("developer_account_id", "developer_account"))),
])

SQL = {
    "p4_found": "SELECT ref_table, ref_column, row_id FROM (" + " UNION ALL ".join(_direct(fk.table, fk.column, fk.target) for fk in THREE) + ")",
    "p4_report": f"""
        WITH direct AS ({_ALL}),
        inherited AS (
            SELECT 'cc_na_annotation' AS ref_table, 'unit_id' AS ref_column, a.unit_id AS row_id, a.labelled_datetime AS created, 'orphan parent' AS reason
            FROM cc_na_annotation a WHERE a.unit_id IN (SELECT row_id FROM direct WHERE ref_table = 'cc_na_initial_unresolved_set')),
        lost AS (
            SELECT 'cc_na_annotation' AS ref_table, 'unit_id' AS ref_column, a.unit_id AS row_id, a.labelled_datetime AS created, 'missing' AS reason
            FROM cc_na_annotation a WHERE a.unit_id IS NOT NULL AND a.unit_id NOT IN (SELECT unit_id FROM cc_na_initial_unresolved_set))
        SELECT ref_table, ref_column, strftime(created, '%Y-%m') AS month, kind, reason, CAST(count(*) AS BIGINT) AS n_rows
        FROM (SELECT *, 'direct' AS kind FROM direct UNION ALL SELECT *, 'direct' FROM lost UNION ALL SELECT *, 'inherited' FROM inherited)
        GROUP BY ALL""",
}
