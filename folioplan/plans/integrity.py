"""Queries and SQL of the referential-integrity operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioplan.compat import cut, table
from folioplan.operators import orphans


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, d, "papers")
    refs = orphans.references(table(spark, d, "edges"), papers)
    return refs, orphans.parents(papers, table(spark, d, "topics"), table(spark, d, "paper_tombstones"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    refs, held = _inputs(spark, d)
    return orphans.orphan_references(refs, held).select("ref_table", "ref_id", "ref_field", "ref_key")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    refs, held = _inputs(spark, d)
    return orphans.report(orphans.orphan_references(refs, held), refs)


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_NORMAL = r"nullif(lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"


def _n(c: str) -> str:
    return _NORMAL.format(c)


_FOUND_SQL = rf"""
WITH raw AS (
  SELECT 'edges' AS ref_table, id AS ref_id, 'source' AS ref_field, 'papers' AS ns, createdAt AS seen,
         CASE WHEN {_n('source')} IS NOT NULL THEN source
              WHEN contains(regexp_replace(id, '^relation:[^:]*:', ''), '->')
              THEN regexp_extract(regexp_replace(id, '^relation:[^:]*:', ''), '(?s)^(.*?)->', 1) END AS ref_key FROM edges
  UNION ALL
  SELECT 'edges', id, 'target', 'papers', createdAt,
         CASE WHEN {_n('target')} IS NOT NULL THEN target
              WHEN contains(regexp_replace(id, '^relation:[^:]*:', ''), '->')
              THEN regexp_extract(regexp_replace(id, '^relation:[^:]*:', ''), '(?s)^.*?->(.*)$', 1) END FROM edges
  UNION ALL
  SELECT 'papers', id, 'topics', 'topics', coalesce(importedAt, createdAt), unnest(topics) FROM papers
), once AS (
  SELECT ref_table, ref_id, ref_field, ref_key, ns, {_n('ref_key')} AS key, min(seen) AS seen0
  FROM raw WHERE {_n('ref_key')} IS NOT NULL GROUP BY ALL
), refs AS (
  SELECT *, min(seen0) OVER (PARTITION BY ref_table, ref_id) AS seen FROM once
), held AS (
  SELECT 'papers' AS ns, {_n('id')} AS key, min(coalesce(importedAt, createdAt)) AS first_at, max(coalesce(importedAt, createdAt)) AS last_at
  FROM papers WHERE {_n('id')} IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'topics', {_n('id')}, min(createdAt), max(createdAt) FROM topics WHERE {_n('id')} IS NOT NULL GROUP BY ALL
), gone AS (
  SELECT 'papers' AS ns, {_n('paper_id')} AS key, max(deleted_at) AS deleted_at FROM paper_tombstones GROUP BY ALL
), judged AS (
  SELECT r.*, CASE WHEN h.key IS NULL THEN 'missing' WHEN g.deleted_at > h.last_at THEN 'deleted' WHEN h.first_at > r.seen THEN 'early' END AS reason
  FROM refs r LEFT JOIN held h ON r.ns = h.ns AND r.key = h.key LEFT JOIN gone g ON r.ns = g.ns AND r.key = g.key
)
"""

ORACLE = {
    "p5_found": _FOUND_SQL + "SELECT ref_table, ref_id, ref_field, ref_key FROM judged WHERE reason IS NOT NULL",
    "p5_report": _FOUND_SQL
    + """SELECT ref_table, ref_field, coalesce(strftime(seen AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS month, count(*) AS n_references,
  count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'deleted') AS n_deleted,
  count(*) FILTER (reason = 'early') AS n_early, count(reason) AS n_orphans
FROM judged GROUP BY ALL""",
}
