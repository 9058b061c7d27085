"""What the queries of the library share: the deduplicated tables, and their SQL."""

from __future__ import annotations

import sys
import unicodedata as ud

from pyspark.sql import DataFrame, SparkSession

from folioplan.compat import table
from folioplan.operators import library


def papers(spark: SparkSession, d: str) -> DataFrame:
    return library.papers_once(table(spark, d, "papers"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return library.edges_once(table(spark, d, "edges"))


def topics(spark: SparkSession, d: str) -> DataFrame:
    return library.topics_once(table(spark, d, "topics"))


_CLEAN = r"regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g')"


def clean_sql(c: str) -> str:
    return _CLEAN.format(c)


def squeeze_sql(c: str) -> str:
    return clean_sql(rf"regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}\x{{FEFF}}]+', ' ', 'g')")


def _letters(lower: bool) -> tuple[str, str]:
    """Characters whose compatibility form is one ASCII letter or digit, besides accents: what strip_accents leaves."""
    a, b = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        r = "".join(x for x in ud.normalize("NFKD", c) if not "̀" <= x <= "ͯ")
        if len(r) == 1 and r.isascii() and r.isalnum() and "<" in ud.decomposition(c) and (c.lower() == c or not lower):
            a.append(c)
            b.append(r)
    return "".join(a), "".join(b)


def _ligatures(inner: str) -> str:
    for c in "ﬀﬁﬂﬃﬄﬅﬆ":
        inner = f"replace({inner}, '{c}', '{ud.normalize('NFKD', c)}')"
    return inner


def title_sql(c: str) -> str:
    """normalized_title: lower case first, so that capitals without a lower case (mathematical ones) fall out."""
    a, b = _letters(True)
    return f"trim(regexp_replace(translate({_ligatures(f'strip_accents(lower(coalesce({c}, {chr(39)}{chr(39)})))')}, '{a}', '{b}'), '[^a-z0-9]+', ' ', 'g'))"


def plain_sql(c: str) -> str:
    """Compatibility forms without accents; case stays."""
    a, b = _letters(False)
    return f"translate({_ligatures(f'strip_accents({c})')}, '{a}', '{b}')"


def slug_sql(c: str, size: int) -> str:
    a, b = _letters(True)
    dashed = f"regexp_replace(translate({_ligatures(f'strip_accents(lower(coalesce({c}, {chr(39)}{chr(39)})))')}, '{a}', '{b}'), '[^a-z0-9]+', '-', 'g')"
    return f"substr(regexp_replace({dashed}, '^-|-$', '', 'g'), 1, {size})"


def author_sql(c: str) -> str:
    a, b = _letters(False)
    return f"trim(regexp_replace(lower(translate({_ligatures(f'strip_accents(coalesce({c}, {chr(39)}{chr(39)}))')}, '{a}', '{b}')), '[^a-z0-9]+', ' ', 'g'))"


def doi_sql(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({clean_sql(c)}, '(?i)^https?://(dx\.)?doi\.org/', ''), '(?i)^doi:\s*', ''))"


def arxiv_sql(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_replace({clean_sql(c)}, '(?i)^(arxiv:\s*|https?://arxiv\.org/(abs|pdf)/)', ''), '(?i)\.pdf$', ''), '(?i)v\d+$', ''))"


#: CTEs p, e, t: one row per key of papers, edges and topics.
ONCE = rf"""
WITH p AS (
  SELECT * FROM papers WHERE coalesce(id, '') <> ''
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY importedAt DESC NULLS LAST, createdAt DESC NULLS LAST) = 1
), e AS (
  SELECT * FROM (
    SELECT * REPLACE (
      CASE WHEN {clean_sql('source')} <> '' THEN source WHEN contains(regexp_replace(id, '^relation:[^:]*:', ''), '->')
           THEN regexp_extract(regexp_replace(id, '^relation:[^:]*:', ''), '(?s)^(.*?)->', 1) END AS source,
      CASE WHEN {clean_sql('target')} <> '' THEN target WHEN contains(regexp_replace(id, '^relation:[^:]*:', ''), '->')
           THEN regexp_extract(regexp_replace(id, '^relation:[^:]*:', ''), '(?s)^.*?->(.*)$', 1) END AS target)
    FROM edges WHERE coalesce(id, '') <> '')
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY createdAt DESC NULLS LAST, kind DESC NULLS LAST, provenance DESC NULLS LAST) = 1
), t AS (
  SELECT * FROM topics WHERE coalesce(id, '') <> ''
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY createdAt DESC NULLS LAST, name DESC NULLS LAST) = 1
)"""

RELATIONS_SQL = "('builds_on', 'improves_on', 'extends', 'outperforms', 'invalidates', 'contradicts', 'supports', 'replicates')"
RESEARCH_SQL = f"coalesce(kind = 'research-relation' AND relation IN {RELATIONS_SQL}, false)"
