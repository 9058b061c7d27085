"""Queries over merges, themes, timelines and resolution of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioplan.compat import table
from folioplan.functions import normalize as N
from folioplan.operators import cluster, layout, merge, reconcile, resolve
from folioplan.plans.base import ONCE, papers, title_sql


def _incoming(s: SparkSession, d: str) -> DataFrame:
    """Provider records in the form of papers, in order of record."""
    w = table(s, d, "provider_works").dropDuplicates(["record_id"])
    none = F.lit(None).cast("string")
    return w.select(
        F.col("record_id").alias("id"), "title", "authors", "year", "venue", none.alias("type"), N.normalize_doi(F.col("doi")).alias("doi"), none.alias("semanticScholarId"), none.alias("openAlexId"), none.alias("arxivId"),
        F.col("cited_by").alias("citationCount"), F.col("provider").alias("source"), F.regexp_extract("record_id", r"(\d+)$", 1).cast("bigint").alias("ordinal"), "provider",
    )


def merge_preview(s: SparkSession, d: str) -> DataFrame:
    return merge.preview(papers(s, d), _incoming(s, d))


def merged_library(s: SparkSession, d: str) -> DataFrame:
    """The library after the providers' records have been merged into it in order."""
    m = merge.merge_library(papers(s, d).drop("extractedReferences", "extra", "libraryEntry"), _incoming(s, d).drop("provider"))
    return m.select("id", "record.title", "record.year", "record.doi", "record.citationCount", "merged", F.size("incoming_ids").alias("n_incoming"))


def provider_merge(s: SparkSession, d: str) -> DataFrame:
    m = merge.merge_providers(_incoming(s, d).drop("id", "source"))
    return m.select("ordinal", "n_records", "title", "year", "doi", "citationCount", F.array_join("metadataSources", "|").alias("sources"))


def pair_merge(s: SparkSession, d: str) -> DataFrame:
    """Papers merged with each provider record of their DOI, field by field."""
    cols = [("id", "string"), ("title", "string"), ("authors", "array"), ("year", "int"), ("venue", "string"), ("doi", "string"), ("citationCount", "bigint"), ("source", "string")]
    w = _incoming(s, d).where("doi <> ''").select(F.col("doi").alias("k"), *[F.col(c).alias(f"n_{c}") for c, _ in cols])
    p = papers(s, d).select(N.normalize_doi(F.col("doi")).alias("k"), *[F.col(c).alias(f"o_{c}") for c, _ in cols])
    j = p.join(w, "k")
    return j.select(F.col("n_id").alias("record_id"), *merge.merge_pair(cols, "o_", "n_")).select("id", "record_id", "title", F.size("authors").alias("n_authors"), "year", "venue", "doi", "citationCount", "source")


def candidate_ranking(s: SparkSession, d: str) -> DataFrame:
    """Provider records of one title, as candidates for each paper of that title; a provider gives at most 20."""
    w = _incoming(s, d).withColumn("k", N.normalized_title(F.col("title")))
    p = papers(s, d).select(F.col("id").alias("query_id"), F.col("title").alias("query"), N.normalized_title(F.col("title")).alias("k"))
    c = merge.united_candidates(p, w, 20).select("query_id", "query", F.col("ordinal").alias("index"), "title", "year", "doi", "arxivId", "openAlexId")
    return merge.ranked_candidates(c, F.col("query")).select("query_id", "index", "exact", "rank")


def tfidf_weights(s: SparkSession, d: str) -> DataFrame:
    return cluster.vectors(papers(s, d)).select("id", "term", F.round("w", 9).alias("w"))


def theme_terms(s: SparkSession, d: str) -> DataFrame:
    """Weighted term counts over all five fields."""
    return cluster.term_counts(papers(s, d), ("title", "keywords", "abstract", "authors", "venue"))


def paper_themes(s: SparkSession, d: str) -> DataFrame:
    assigned, centroids = cluster.kmeans(papers(s, d))
    return assigned.join(F.broadcast(cluster.themes(assigned, centroids)), "band").select("id", "theme", "label")


def timeline(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d)
    assigned, centroids = cluster.kmeans(p)
    named = cluster.themes(assigned, centroids)
    return layout.timeline(p, assigned.join(F.broadcast(named), "band").select("id", (F.col("theme") - 1).alias("band")))


def year_buckets(s: SparkSession, d: str) -> DataFrame:
    return layout.year_buckets(papers(s, d))


def venue_timeline(s: SparkSession, d: str) -> DataFrame:
    """The same layout with bands by type of publication, which SQL can repeat."""
    p = papers(s, d)
    band = F.when(F.col("type") == "article", 0).when(F.col("type") == "inproceedings", 1).when(F.col("type") == "preprint", 2).otherwise(3)
    return layout.timeline(p.withColumn("title", N.text(F.col("title"))), p.select("id", band.alias("band")))


def _refs(s: SparkSession, d: str) -> DataFrame:
    return reconcile.references(papers(s, d)).select(F.concat_ws("#", "source_id", "ordinal").alias("rid"), "rawText", "year", "doi", "arxivId")


def candidate_scores(s: SparkSession, d: str) -> DataFrame:
    return resolve.scored(_refs(s, d), papers(s, d))


def resolver_decisions(s: SparkSession, d: str) -> DataFrame:
    r = _refs(s, d)
    return resolve.decisions(r, resolve.scored(r, papers(s, d)))


def resolved_by_identifier(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "provider_works")
    semantic = papers(s, d).where("source = 'semantic-scholar'").select("doi", "arxivId")
    r = papers(s, d).select(F.col("id").alias("rid"), "doi", "arxivId")
    return resolve.by_identifier(r, w.where("provider = 'crossref'"), semantic)


def nearest_embeddings(s: SparkSession, d: str) -> DataFrame:
    return cluster.nearest_embeddings(table(s, d, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        merge_preview, merged_library, provider_merge, pair_merge, candidate_ranking, tfidf_weights, theme_terms, paper_themes, timeline, year_buckets, venue_timeline, candidate_scores, resolver_decisions,
        resolved_by_identifier, nearest_embeddings,
    )
}

from folioplan.plans.references import _YT, _letters, _ligatures, clean_sql, doi_sql  # noqa: E402

_STOP = "[" + ", ".join(f"'{w}'" for w in N.THEME_STOP_WORDS) + "]"
_STOP2 = "[" + ", ".join(f"'{w}'" for w in N.REFERENCE_STOP_WORDS) + "]"
_A, _B = _letters(True)
_C, _D = _letters(False)


def _fold(c: str) -> str:
    return f"translate({_ligatures(f'strip_accents(lower(coalesce({c}, {chr(39)}{chr(39)})))')}, '{_A}', '{_B}')"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all({_fold(c)}, '[a-z0-9][a-z0-9-]{{1,}}'), lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t) AND NOT regexp_full_match(t, '[0-9]+'))"


def _plain(c: str) -> str:
    return f"regexp_extract_all(lower(translate({_ligatures(f'strip_accents({clean_sql(c)})')}, '{_C}', '{_D}')), '[a-z0-9]+')"


def _meaningful(c: str) -> str:
    return f"list_distinct(list_filter({_plain(c)}, lambda t: length(t) >= 2 AND NOT list_contains({_STOP2}, t)))"


_TF = f"""{ONCE}, cells AS (
  SELECT id, unnest({_tokens('title')}) AS term, 3 AS w, 'd' AS g FROM p UNION ALL SELECT id, unnest({_tokens('abstract')}), 1, 'd' FROM p
  UNION ALL SELECT id, unnest({_tokens('k')}), 5, 'd' FROM (SELECT id, unnest(keywords) AS k FROM p)
  UNION ALL SELECT id, unnest({_tokens('k')}), 2, 'x' FROM (SELECT id, unnest(authors) AS k FROM p) UNION ALL SELECT id, unnest({_tokens('venue')}), 2, 'x' FROM p)"""
_W = "w AS (SELECT DISTINCT ON (record_id) * FROM provider_works)"
_WI = f"{_W}, wi AS (SELECT record_id AS id, title, authors, year, venue, {doi_sql('doi')} AS doi, cited_by, provider, CAST(regexp_extract(record_id, '([0-9]+)$', 1) AS BIGINT) AS ordinal FROM w)"
_IDENT = lambda s2, ax: f"CASE WHEN {doi_sql('doi')} <> '' THEN 'doi:' || {doi_sql('doi')} {s2} {ax} ELSE 'title:' || {title_sql('title')} || ':' || {_YT('year')} END"
_SCORED = f"""{ONCE}, refs AS (SELECT id || '#' || CAST(generate_subscripts(extractedReferences, 1) - 1 AS VARCHAR) AS rid, unnest(extractedReferences) AS r FROM p
), rr AS (SELECT rid, {_meaningful('r.rawText')} AS raw, CASE WHEN r.year > 0 THEN r.year END AS ry FROM refs
), pp AS (SELECT id AS paper_id, {_meaningful('title')} AS title, list_filter(list_transform(coalesce(authors, []), lambda a: coalesce({_plain('a')}[-1], '')), lambda x: length(x) >= 3) AS names, CASE WHEN year > 0 THEN year END AS py FROM p
), s AS (SELECT rid, paper_id, len(list_intersect(title, raw)) / len(title) AS c, len(title) AS n, len(names) > 0 AS known, list_has_any(names, raw) AS author, ry, py FROM rr JOIN pp ON len(raw) > 0 AND len(title) > 0
), sc AS (SELECT rid, paper_id, round(c * 0.7 + CASE WHEN author AND known THEN 1.0 WHEN known THEN 0.0 ELSE 0.5 END * 0.2 + CASE WHEN ry IS NOT NULL THEN 1.0 ELSE 0.5 END * 0.1, 4) AS confidence FROM s
  WHERE NOT (ry IS NOT NULL AND coalesce(py <> ry, true)) AND c >= CASE WHEN n <= 2 THEN 1.0 ELSE 0.7 END AND NOT (known AND NOT author AND c < 0.92))"""

ORACLE = {
    "merge_preview": f"""{ONCE}, {_WI}, bi AS (SELECT {_IDENT("WHEN coalesce(semanticScholarId, '') <> '' THEN 's2:' || semanticScholarId", "WHEN coalesce(arxivId, '') <> '' THEN 'arxiv:' || lower(arxivId)")} AS k, max(id) AS x FROM p GROUP BY 1),
bt AS (SELECT {title_sql('title')} || ':' || {_YT('year')} AS k, max(id) AS y FROM p GROUP BY 1)
SELECT wi.id AS incoming_id, coalesce(x, y) AS existing_id, CASE WHEN x IS NOT NULL THEN 'identity' WHEN y IS NOT NULL THEN 'title-year' ELSE 'new' END AS matched_by
FROM wi LEFT JOIN bi ON bi.k = CASE WHEN wi.doi <> '' THEN 'doi:' || wi.doi ELSE 'title:' || {title_sql('wi.title')} || ':' || {_YT('wi.year')} END
LEFT JOIN bt ON bt.k = {title_sql('wi.title')} || ':' || {_YT('wi.year')}""",
    "pair_merge": f"""{ONCE}, {_WI}, j AS (SELECT p.*, wi.id AS record_id, wi.title AS nt, wi.authors AS na, wi.year AS ny, wi.venue AS nv, wi.doi AS nd, wi.cited_by AS nc FROM p JOIN wi ON wi.doi <> '' AND wi.doi = {doi_sql('p.doi')})
SELECT id, record_id, CASE WHEN coalesce(nt, '') <> '' THEN nt ELSE title END AS title, CASE WHEN len(na) > 0 THEN len(na) ELSE coalesce(len(authors), 0) END AS n_authors, coalesce(ny, year) AS year, CASE WHEN coalesce(nv, '') <> '' THEN nv ELSE venue END AS venue, nd AS doi, coalesce(nc, citationCount) AS citationCount, coalesce(source, (SELECT provider FROM wi x WHERE x.id = record_id)) AS source FROM j""",
    "candidate_ranking": f"""{ONCE}, {_WI}, pk AS (SELECT id, {title_sql('title')} AS k FROM p), wk AS (SELECT ordinal, doi, {title_sql('title')} AS k FROM wi QUALIFY row_number() OVER (PARTITION BY provider, {title_sql('title')} ORDER BY ordinal) <= 20),
c AS (SELECT pk.id AS query_id, min(ordinal) AS index FROM pk JOIN wk ON pk.k = wk.k AND pk.k <> '' GROUP BY pk.id, CASE WHEN doi <> '' THEN 'doi:' || doi ELSE 'title:' || ordinal END)
SELECT query_id, index, true AS exact, row_number() OVER (PARTITION BY query_id ORDER BY index) AS rank FROM c""",
    "resolved_by_identifier": rf"""{ONCE}, r AS (SELECT id AS rid, {doi_sql('doi')} AS doi, regexp_replace({clean_sql('arxivId')}, '(?i)^arxiv:\s*', '') AS ax, source, arxivId FROM p), k AS (SELECT *, lower(ax) AS arxiv, lower(regexp_replace(ax, '(?i)v\d+$', '')) AS base FROM r),
c AS (SELECT DISTINCT {doi_sql('doi')} AS doi FROM provider_works WHERE provider = 'crossref' AND {doi_sql('doi')} <> ''), s AS (SELECT DISTINCT doi FROM k WHERE source = 'semantic-scholar' AND doi <> ''),
a AS (SELECT base, list(DISTINCT arxiv) AS have FROM k WHERE source = 'semantic-scholar' AND base <> '' GROUP BY base)
SELECT rid, CASE WHEN k.doi <> '' AND c.doi IS NOT NULL THEN 'crossref' WHEN (k.doi <> '' AND s.doi IS NOT NULL) OR (k.doi = '' AND arxiv <> '' AND have IS NOT NULL) THEN 'semantic-scholar' END AS provider,
  CASE WHEN k.doi <> '' THEN 'doi' WHEN arxiv <> '' THEN 'arxiv' END AS matched_by,
  CASE WHEN k.doi <> '' AND c.doi IS NOT NULL THEN 0.99 WHEN k.doi <> '' AND s.doi IS NOT NULL THEN 0.97 WHEN k.doi = '' AND arxiv <> '' AND list_contains(have, arxiv) THEN 0.99 WHEN k.doi = '' AND arxiv <> '' AND have IS NOT NULL THEN 0.98 ELSE 0.0 END AS confidence,
  CASE WHEN k.doi <> '' THEN k.doi ELSE arxiv END AS queried FROM k LEFT JOIN c ON k.doi = c.doi LEFT JOIN s ON k.doi = s.doi LEFT JOIN a ON k.base = a.base""",
    "tfidf_weights": f"""{_TF}, tf AS (SELECT id, term, sum(w) AS tf FROM cells WHERE g = 'd' GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT id, term, tf * (ln(((SELECT count(*) FROM p) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM raw GROUP BY id)
SELECT id, term, round(w / n, 9) AS w FROM raw JOIN n USING (id) UNION ALL SELECT id, '__paper_' || id, 1.0 FROM p WHERE id NOT IN (SELECT id FROM n)""",
    "theme_terms": f"{_TF} SELECT id, term, sum(w) AS tf FROM cells GROUP BY ALL",
    "year_buckets": f"{ONCE} SELECT year, row_number() OVER (ORDER BY year) - 1 AS bucket FROM (SELECT DISTINCT year FROM p WHERE year IS NOT NULL)",
    "venue_timeline": f"""{ONCE}, b AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS bucket FROM (SELECT DISTINCT year FROM p WHERE year IS NOT NULL)), c AS (
  SELECT p.id, coalesce(title, '') AS title, coalesce(p.year, 0) AS y, CASE type WHEN 'article' THEN 0 WHEN 'inproceedings' THEN 1 WHEN 'preprint' THEN 2 ELSE 3 END AS band, coalesce(bucket, (SELECT max(bucket) // 2 FROM b)) AS bucket FROM p LEFT JOIN b ON p.year = b.year
), k AS (SELECT *, row_number() OVER (PARTITION BY band, bucket ORDER BY y, title, id) - 1 AS slot FROM c), h AS (SELECT band, greatest(142, 64 + (max(slot) + 1) * 62) AS h FROM k GROUP BY band),
o AS (SELECT band, 28 + coalesce(sum(h + 12) OVER (ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM h)
SELECT id, band, bucket, slot, 166 + bucket * 205 AS x, CAST(top + 64 + slot * 62 AS BIGINT) AS y FROM k JOIN o USING (band)""",
    "candidate_scores": f"{_SCORED} SELECT * FROM sc WHERE confidence > 0",
    "resolver_decisions": f"""{_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY confidence DESC, paper_id) AS k FROM sc), f AS (SELECT *, lead(confidence) OVER (PARTITION BY rid ORDER BY k) AS nxt, count(*) OVER (PARTITION BY rid) AS n FROM k WHERE k <= 5 AND confidence >= 0.72)
SELECT refs.rid, CASE WHEN f.rid IS NULL THEN 'unresolved' WHEN confidence >= 0.9 AND (nxt IS NULL OR round(confidence - nxt, 6) >= 0.1) THEN 'matched' ELSE 'candidates' END AS status,
  CASE WHEN confidence >= 0.9 AND (nxt IS NULL OR round(confidence - nxt, 6) >= 0.1) THEN paper_id END AS paper_id, coalesce(confidence, 0.0) AS confidence, coalesce(n, 0) AS n_candidates FROM refs LEFT JOIN f ON refs.rid = f.rid AND f.k = 1""",
    "nearest_embeddings": """WITH q AS (SELECT vec_id, CAST(embedding AS FLOAT[64]) AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id, b.vec_id AS other, CAST(array_cosine_similarity(q.e, CAST(b.embedding AS FLOAT[64])) AS DOUBLE) AS sim FROM q JOIN embeddings b ON q.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 5) DESC, other) AS rank FROM s) SELECT vec_id, rank, other, round(sim, 4) AS sim FROM k WHERE rank <= 5""",
}
