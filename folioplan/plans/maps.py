"""Queries over library views and aggregate graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioplan.functions import normalize as N
from folioplan.operators import graph, layout, library
from folioplan.operators.library import Filters
from folioplan.plans.base import ONCE, RELATIONS_SQL, RESEARCH_SQL, author_sql, edges, papers, squeeze_sql, topics

VIEW = Filters(year_min=2000, year_max=2024, query="sensor")
FACETED = Filters(year_min=1995, type="article", venue="journal", author="an")


def library_stats(s: SparkSession, d: str) -> DataFrame:
    return library.stats(papers(s, d), edges(s, d), topics(s, d))


def filtered_papers(s: SparkSession, d: str) -> DataFrame:
    return library.view(papers(s, d), topics(s, d), VIEW).select("id", "year")


def faceted_papers(s: SparkSession, d: str) -> DataFrame:
    return library.view(papers(s, d), topics(s, d), FACETED).select("id", "year", "venue")


def filters_null_year(s: SparkSession, d: str) -> DataFrame:
    """The same upper bound with unknown years failing it, and passing as year 0."""
    p = papers(s, d)
    f = Filters(year_max=2010)
    strict = library.view(p, topics(s, d), f).select("id", F.lit("strict").alias("policy"))
    return strict.union(library.view(p, topics(s, d), f, legacy_null_year=True).select("id", F.lit("legacy")))


def focus_filters(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d)
    f = Filters(focus_authors=("Sakura Jonepe", "nikhil giheve "), starred=False)
    return library.view(p, topics(s, d), f).select("id")


def visible_subgraph(s: SparkSession, d: str) -> DataFrame:
    v = library.view(papers(s, d), topics(s, d), Filters(year_min=2000, year_max=2024))
    return library.induced_edges(edges(s, d), v).select("id", "source", "target")


def paper_neighbours(s: SparkSession, d: str) -> DataFrame:
    return library.neighbours(edges(s, d), "doi:10.99001/hbk.uhn6cgp")


def facets(s: SparkSession, d: str) -> DataFrame:
    return library.facets(papers(s, d), topics(s, d))


def paper_list_top(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d).withColumn("title", N.text(F.col("title")))
    # The list itself is sorted as people sort; this query's order is by code point so that SQL can repeat it.
    return p.orderBy(F.coalesce("year", F.lit(0)).desc(), "title", "id").limit(100).select("id", F.coalesce("year", F.lit(0)).alias("year"), "title")


def paper_list_collated(s: SparkSession, d: str) -> DataFrame:
    return library.paper_list(papers(s, d)).select("id", "year", "title")


def topic_blocks(s: SparkSession, d: str) -> DataFrame:
    return graph.topic_blocks(papers(s, d), topics(s, d))


def topic_links(s: SparkSession, d: str) -> DataFrame:
    return graph.topic_links(papers(s, d), edges(s, d))


def author_blocks(s: SparkSession, d: str) -> DataFrame:
    return graph.author_blocks(papers(s, d))


def coauthor_links(s: SparkSession, d: str) -> DataFrame:
    return graph.coauthor_links(papers(s, d))


def author_citation_links(s: SparkSession, d: str) -> DataFrame:
    return graph.author_citation_links(papers(s, d), edges(s, d))


def coauthors_ranked(s: SparkSession, d: str) -> DataFrame:
    return layout.ranked(graph.author_blocks(papers(s, d)), "coauthors")


def topics_ranked(s: SparkSession, d: str) -> DataFrame:
    return layout.ranked(graph.topic_blocks(papers(s, d), topics(s, d)), "n_papers")


def ranked_extent(s: SparkSession, d: str) -> DataFrame:
    return layout.extent(topics_ranked(s, d))


def citation_summary(s: SparkSession, d: str) -> DataFrame:
    return library.citation_summary(papers(s, d), edges(s, d))


def research_relations(s: SparkSession, d: str) -> DataFrame:
    return library.relations_of(papers(s, d), edges(s, d))


def edge_kinds(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d).select(F.when(N.is_research_relation(F.col("kind"), F.col("relation")), F.col("relation")).otherwise("citation").alias("edge_kind"))
    return e.groupBy("edge_kind").agg(F.count("*").alias("n"))


def citation_map_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.citation_map(papers(s, d)).withColumn("radius", F.round("radius", 6))


def expansions(s: SparkSession, d: str) -> DataFrame:
    return library.expansions(papers(s, d))


def paged_citations(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d).where(F.col("target") == "doi:10.99001/hbk.uhn6cgp")
    return library.page_of(e.select("id", "source"), [F.col("id")], 50, 50)


def topic_hierarchy(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d)
    return layout.hierarchy(graph.topic_blocks(p, topics(s, d)), graph.topic_links(p, edges(s, d)))


def citation_levels(s: SparkSession, d: str) -> DataFrame:
    """Longest citation path to each paper; unknown for papers on cycles of citations and behind them."""
    return layout.levels(papers(s, d).select("id"), edges(s, d).select("source", "target"))


def topic_gravity(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d)
    return layout.gravity(graph.topic_blocks(p, topics(s, d)), graph.topic_links(p, edges(s, d))).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


QUERIES = {
    f.__name__: f
    for f in (
        library_stats, filtered_papers, faceted_papers, filters_null_year, focus_filters, visible_subgraph, paper_neighbours, facets, paper_list_top, paper_list_collated, topic_blocks, topic_links, author_blocks,
        coauthor_links, author_citation_links, coauthors_ranked, topics_ranked, ranked_extent, citation_summary, research_relations, edge_kinds, citation_map_nodes, expansions, paged_citations, topic_hierarchy,
        citation_levels, topic_gravity,
    )
}

_NAMES = "list_transform(coalesce({0}, []), lambda x: coalesce(x, ''))"
_AUTHORS = f"""{ONCE}, raw AS (
  SELECT id AS paper_id, coalesce(starred, false) AS starred, unnest(authors) AS a, generate_subscripts(authors, 1) - 1 AS ordinal FROM p
), named AS (
  SELECT *, {squeeze_sql('a')} AS name FROM raw
), keyed AS (
  SELECT *, {author_sql('name')} AS key FROM named
), pa AS (
  SELECT paper_id, starred, 'author:' || key AS author, min(ordinal) AS ordinal, arg_min(name, ordinal) AS name FROM keyed WHERE name <> '' AND key <> '' GROUP BY ALL
), co AS (
  SELECT a.author AS source, b.author AS target, count(*) AS weight FROM pa a JOIN pa b ON a.paper_id = b.paper_id AND a.author < b.author GROUP BY ALL
), ab AS (
  SELECT author AS id, arg_min(name, (paper_id, ordinal)) AS name, count(*) AS n_papers, count(*) FILTER (starred) AS starred FROM pa GROUP BY author
), abc AS (
  SELECT ab.*, coalesce(n, 0) AS coauthors FROM ab LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source AS id FROM co UNION ALL SELECT target FROM co) GROUP BY id) USING (id)
)"""
_TOPICS = f"""{ONCE}, pt AS (SELECT id AS paper_id, unnest(topics) AS topic, coalesce(starred, false) AS starred FROM p), pt2 AS (SELECT * FROM pt WHERE coalesce(topic, '') <> '')
, tb AS (
  SELECT b.id, coalesce(nullif(t.name, ''), b.id) AS name, coalesce(nullif(t.source, ''), 'derived') AS source, n_papers, b.starred
  FROM (SELECT topic AS id, count(*) AS n_papers, count(*) FILTER (starred) AS starred FROM pt2 GROUP BY topic) b LEFT JOIN t ON b.id = t.id
)"""
_ENTRY = "coalesce(nullif(trim(coalesce(nullif(libraryEntry.method, ''), nullif(source, ''), 'unknown')), ''), 'unknown')"


def _ranked(blocks: str, metric: str) -> str:
    return f"""SELECT id, name, n_papers, {metric} AS rank_value, col AS "column", r AS "row", 34 + col * 245 AS x, 54 + r * 110 AS y, 210 AS width,
  greatest(68, least(96, 64 + n_papers * 5)) AS height FROM (
  SELECT *, row_number() OVER (PARTITION BY col ORDER BY n_papers DESC, name, id) - 1 AS r FROM (
    SELECT *, dense_rank() OVER (ORDER BY {metric} DESC) - 1 AS col FROM {blocks}))"""


_SOURCE_LABEL = "CASE value " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.SOURCE_LABELS.items()) + " ELSE array_to_string(list_transform(string_split(replace(value, '-', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') END"
_LABEL = lambda k: "CASE relation " + " ".join(f"WHEN '{r}' THEN '{v[k]}'" for r, v in N.RELATIONS.items()) + " END"

ORACLE = {
    "library_stats": f"{ONCE} SELECT 'papers' AS store, count(*) AS n FROM p UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'topics', count(*) FROM t",
    "filtered_papers": f"""{ONCE}, names AS (
  SELECT x.id, list(coalesce(nullif(t.name, ''), regexp_replace(x.topic, '^topic:[^:]+:', '')) ORDER BY x.k) AS n
  FROM (SELECT id, unnest(topics) AS topic, generate_subscripts(topics, 1) AS k FROM p) x LEFT JOIN t ON x.topic = t.id WHERE x.topic IS NOT NULL GROUP BY x.id)
SELECT p.id, p.year FROM p LEFT JOIN names ON p.id = names.id WHERE year >= 2000 AND year <= 2024 AND contains(lower(array_to_string(
  [coalesce(title, '')] || {_NAMES.format('authors')} || [coalesce(abstract, '')] || [coalesce(venue, '')] || [coalesce(type, '')] || {_NAMES.format('tags')} || {_NAMES.format('keywords')} || coalesce(names.n, []), ' ')), 'sensor')""",
    "faceted_papers": f"{ONCE} SELECT id, year, venue FROM p WHERE year >= 1995 AND type = 'article' AND contains(lower(coalesce(venue, '')), 'journal') AND len(list_filter(coalesce(authors, []), lambda a: contains(lower(coalesce(a, '')), 'an'))) > 0",
    "filters_null_year": f"{ONCE} SELECT id, 'strict' AS policy FROM p WHERE year <= 2010 UNION ALL SELECT id, 'legacy' FROM p WHERE coalesce(year, 0) <= 2010",
    "focus_filters": f"{ONCE} SELECT id FROM p WHERE len(list_filter(coalesce(authors, []), lambda a: lower(trim(coalesce(a, ''))) IN ('sakura jonepe', 'nikhil giheve'))) > 0",
    "visible_subgraph": f"{ONCE}, v AS (SELECT id FROM p WHERE year BETWEEN 2000 AND 2024) SELECT id, source, target FROM e WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)",
    "paper_neighbours": f"{ONCE}, n AS (SELECT target AS id FROM e WHERE source = 'doi:10.99001/hbk.uhn6cgp' UNION SELECT source FROM e WHERE target = 'doi:10.99001/hbk.uhn6cgp') SELECT id FROM n WHERE id <> 'doi:10.99001/hbk.uhn6cgp'",
    "facets": f"""{ONCE}, x AS (
  SELECT id, 'type' AS facet, type AS value FROM p UNION SELECT id, 'source', {_ENTRY} FROM p UNION SELECT id, 'tag', unnest(tags) FROM p UNION SELECT id, 'topic', unnest(topics) FROM p)
SELECT facet, value, CASE facet WHEN 'source' THEN {_SOURCE_LABEL} WHEN 'topic' THEN coalesce(t.name, regexp_replace(value, '^topic:[^:]+:', '')) ELSE value END AS label, count(*) AS n
FROM x LEFT JOIN t ON x.facet = 'topic' AND x.value = t.id WHERE coalesce(value, '') <> '' GROUP BY ALL""",
    "paper_list_top": f"{ONCE} SELECT id, coalesce(year, 0) AS year, coalesce(title, '') AS title FROM p ORDER BY 2 DESC, 3, 1 LIMIT 100",
    "paper_list_collated": f"{ONCE} SELECT id, year, title FROM p",
    "topic_blocks": f"{_TOPICS} SELECT * FROM tb",
    "topic_links": f"{_TOPICS} SELECT a.topic AS source, b.topic AS target, count(*) AS weight FROM e JOIN pt2 a ON e.source = a.paper_id JOIN pt2 b ON e.target = b.paper_id WHERE a.topic <> b.topic GROUP BY ALL",
    "author_blocks": f"{_AUTHORS} SELECT * FROM abc",
    "coauthor_links": f"{_AUTHORS} SELECT * FROM co",
    "author_citation_links": f"""{_AUTHORS} SELECT a.author AS source, b.author AS target, count(*) AS weight, count(DISTINCT e.source) AS citing_papers
FROM e JOIN pa a ON e.source = a.paper_id JOIN pa b ON e.target = b.paper_id WHERE NOT {RESEARCH_SQL} AND a.author <> b.author GROUP BY ALL""",
    "coauthors_ranked": f"{_AUTHORS} {_ranked('abc', 'coauthors')}",
    "topics_ranked": f"{_TOPICS} {_ranked('tb', 'n_papers')}",
    "ranked_extent": f'{_TOPICS}, r AS ({_ranked("tb", "n_papers")}) SELECT greatest(1200, 68 + (max("column") + 1) * 245) AS width, greatest(720, 94 + (max("row") + 1) * 110) AS height FROM r',
    "citation_summary": f"""{ONCE}, ends AS (SELECT source AS id, true AS o, {RESEARCH_SQL} AS r FROM e UNION ALL SELECT target, false, {RESEARCH_SQL} FROM e), g AS (
  SELECT id, count(*) FILTER (NOT r AND o) AS references_out, count(*) FILTER (NOT r AND NOT o) AS citations_in, count(*) FILTER (r) AS research_links FROM ends GROUP BY id)
SELECT p.id, coalesce(len(extractedReferences), 0) AS extracted_references, coalesce(references_out, 0) AS references_out, coalesce(citations_in, 0) AS citations_in, coalesce(research_links, 0) AS research_links,
  citationCount AS provider_citations FROM p LEFT JOIN g USING (id)""",
    "research_relations": f"""{ONCE}, r AS (SELECT e.source, e.target, e.relation, a.title AS st, b.title AS tt FROM e JOIN p a ON e.source = a.id JOIN p b ON e.target = b.id WHERE e.kind = 'research-relation' AND e.relation IN {RELATIONS_SQL})
SELECT source AS paper_id, 'out' AS direction, relation, {_LABEL(0)} AS label, target AS other_id, tt AS other_title FROM r UNION ALL SELECT target, 'in', relation, {_LABEL(1)}, source, st FROM r""",
    "edge_kinds": f"{ONCE} SELECT CASE WHEN {RESEARCH_SQL} THEN relation ELSE 'citation' END AS edge_kind, count(*) AS n FROM e GROUP BY ALL",
    "citation_map_nodes": f"""{ONCE}, l AS (SELECT *, {squeeze_sql("coalesce(nullif(title, ''), 'Untitled')")} AS s, {_ENTRY} AS src FROM p)
SELECT id, CASE WHEN length(s) <= 34 THEN s ELSE s[1:33] || '…' END AS label, round(CASE WHEN citationCount > 0 THEN greatest(8, least(15, 8 + log10(citationCount + 1) * 1.75)) ELSE 8 END, 6) AS radius,
  CASE WHEN starred THEN 'starred' WHEN src LIKE '%-expansion' THEN 'auto-added' WHEN src LIKE '%-resolve' THEN 'manual-added' ELSE 'other' END AS kind FROM l""",
    "expansions": f"""{ONCE} SELECT x.*, p.title AS parent_title FROM (SELECT libraryEntry.parentPaperId AS id, libraryEntry.detail AS direction, count(*) AS children FROM p
  WHERE libraryEntry.method LIKE '%-expansion' AND coalesce(libraryEntry.parentPaperId, '') <> '' GROUP BY ALL) x LEFT JOIN p USING (id)""",
    "paged_citations": f"""{ONCE}, k AS (SELECT id, source, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS total FROM e WHERE target = 'doi:10.99001/hbk.uhn6cgp')
SELECT id, source, CASE WHEN total > 100 THEN 100 END AS next FROM k WHERE n > 50 AND n <= 100""",
}
