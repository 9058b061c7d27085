"""All core queries and their SQL."""

from __future__ import annotations

from folioplan.plans import documents, exchange, integrity, maps, references, reviews, themes

_MODULES = (integrity, maps, references, themes, documents, exchange, reviews)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}


def flagship(spark, sf_dir):
    return maps.coauthors_ranked(spark, sf_dir)
