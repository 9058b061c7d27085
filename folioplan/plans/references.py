"""Queries over identities, references and the citation edges they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioplan.compat import table
from folioplan.functions import normalize as N
from folioplan.operators import reconcile as R
from folioplan.plans.base import ONCE, _letters, _ligatures, arxiv_sql, author_sql, clean_sql, doi_sql, edges, papers, squeeze_sql, title_sql


def identity_keys(s: SparkSession, d: str) -> DataFrame:
    p = {k: F.col(k) for k in ("title", "year", "doi", "semanticScholarId", "arxivId", "openAlexId")}
    return papers(s, d).select("id", N.paper_identity_key(p).alias("identity"), N.title_year_key(F.col("title"), F.col("year")).alias("title_year"), N.title_year_key(F.col("title"), F.col("year"), strict=True).alias("strict_title_year"), N.stable_id(p, ("doi", "arxiv", "openalex"), F.lit("none")).alias("provider_id"))


def arxiv_forms(s: SparkSession, d: str) -> DataFrame:
    a = F.col("arxivId")
    return papers(s, d).where(N.clean(a) != "").select("id", N.arxiv_identity(a).alias("identity"), N.arxiv_reference(a).alias("reference"), N.arxiv_versioned(a).alias("versioned"), N.arxiv_bare(a).alias("bare"), N.arxiv_base(a).alias("base"))


def slugs(s: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return papers(s, d).select("id", N.normalized_title(t).alias("title"), N.slug(t).alias("slug80"), N.slug(t, 70).alias("slug70"))


def author_keys(s: SparkSession, d: str) -> DataFrame:
    names = papers(s, d).select(F.explode("authors").alias("name")).where("name IS NOT NULL").distinct()
    return names.select("name", N.author_key(F.col("name")).alias("key"))


def _works(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "provider_works").dropDuplicates(["record_id"])


def same_work_pairs(s: SparkSession, d: str) -> DataFrame:
    """Provider records and library papers that identity alone says are one work."""
    none = F.lit(None).cast("string")
    w = _works(s, d).select(F.col("record_id").alias("lid"), *R.keys_of(F.col("doi"), none, none, F.col("title"), F.col("year")))
    p = papers(s, d).select(F.col("id").alias("rid"), *R.keys_of(F.col("doi"), F.col("semanticScholarId"), F.col("arxivId"), F.col("title"), F.col("year")))
    return R.precedence_join(w, p).select(F.col("lid").alias("record_id"), F.col("rid").alias("paper_id"))


def canonical_targets(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d)
    return R.canonical_targets(R.references(p), p)


def local_targets(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d)
    return R.local_targets(R.references(p), p)


def inferred_edges(s: SparkSession, d: str) -> DataFrame:
    return R.inferred_edges(papers(s, d), edges(s, d)).select("id", "source", "target", "kind", "provenance", F.col("referenceResolution.provider").alias("provider"), F.col("referenceResolution.matchedBy").alias("matched_by"))


def stored_reference_papers(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d)
    return R.stored_reference_paper(R.references(p), p)


def merged_references(s: SparkSession, d: str) -> DataFrame:
    """References over all deliveries of a paper, merged by identity."""
    rows = table(s, d, "papers").where("id <> ''").select("id", "extractedReferences", F.coalesce(F.unix_micros("importedAt"), F.lit(0)).alias("at")).distinct()
    cells = rows.select(F.col("id").alias("source_id"), "at", F.posexplode("extractedReferences").alias("k", "r")).select("source_id", (F.col("at") * 1000 + F.col("k")).alias("ordinal"), "r.*")
    m = R.merged_references(cells)
    return m.select("source_id", "key", "reviewed", "title", "year", F.col("resolution").isNotNull().alias("resolved"))


def resolution_counts(s: SparkSession, d: str) -> DataFrame:
    return R.resolution_counts(R.references(papers(s, d)))


def reference_fields(s: SparkSession, d: str) -> DataFrame:
    """What the patterns read from every printed reference."""
    raw = F.col("rawText")
    return R.references(papers(s, d)).select("source_id", "ordinal", N.extract_doi(raw).alias("doi"), N.extract_year(raw).alias("year"), N.reference_search_query(raw).alias("query"), N.review_reference_key({k: F.col(k) for k in ("doi", "arxivId", "rawText")}).alias("key"))


def reference_texts(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", N.reference_text(F.col("authors"), F.col("year"), F.col("title"), F.col("venue"), F.col("doi")).alias("text"), N.citation_string(F.col("authors"), F.col("year"), F.col("title"), F.col("venue"), F.col("doi")).alias("citation"))


def edge_ids(s: SparkSession, d: str) -> DataFrame:
    """Ids that edges should have, next to those they have."""
    e = edges(s, d)
    research = N.is_research_relation(F.col("kind"), F.col("relation"))
    made = F.when(research, N.relation_edge_id(F.col("source"), F.col("target"), F.col("relation"))).otherwise(N.edge_id(F.col("source"), F.col("target")))
    return e.select("id", made.alias("expected"), (F.col("id") == made).alias("as_expected"))


def document_identifiers(s: SparkSession, d: str) -> DataFrame:
    """First DOI, arXiv id (of either style) and year in each document of the corpus."""
    t = F.col("text")
    return table(s, d, "documents").where(t.isNotNull()).select("doc_id", N.extract_doi(t).alias("doi"), N.extract_arxiv(t).alias("arxiv"), N.extract_year(t).alias("year"))


QUERIES = {
    f.__name__: f
    for f in (identity_keys, arxiv_forms, slugs, author_keys, same_work_pairs, canonical_targets, local_targets, inferred_edges, stored_reference_papers, merged_references, resolution_counts, reference_fields, reference_texts, edge_ids, document_identifiers)
}

_YEAR = lambda c: f"CASE WHEN {c} > 0 THEN {c} END"
_TY = lambda t, y: f"CASE WHEN {title_sql(t)} <> '' AND {y} > 0 THEN {title_sql(t)} || ':' || {y} ELSE '' END"
_YT = lambda y: f"coalesce(CASE WHEN {y} <> 0 THEN CAST({y} AS VARCHAR) END, '')"
_KEYS = lambda doi, s2, ax, t, y: f"{doi_sql(doi)} AS doi, lower({clean_sql(s2)}) AS s2, {arxiv_sql(ax)} AS arxiv, {_TY(t, y)} AS ty"
_SAME = """CASE WHEN l.doi <> '' AND r.doi <> '' THEN l.doi = r.doi WHEN l.s2 <> '' AND r.s2 <> '' THEN l.s2 = r.s2
  WHEN l.arxiv <> '' AND r.arxiv <> '' THEN l.arxiv = r.arxiv ELSE l.ty <> '' AND l.ty = r.ty END"""
_REFS = f"""{ONCE}, refs AS (
  SELECT id AS source_id, CAST(generate_subscripts(extractedReferences, 1) - 1 AS INTEGER) AS ordinal, unnest(extractedReferences) AS r FROM p
), pk AS (SELECT id, authors, title, year, {_KEYS('doi', 'semanticScholarId', 'arxivId', 'title', 'year')} FROM p)"""
_USABLE = lambda c: f"({c} IS NOT NULL AND ({clean_sql(c + '.doi')} <> '' OR {clean_sql(c + '.semanticScholarId')} <> '' OR {clean_sql(c + '.arxivId')} <> '' OR ({title_sql(c + '.title')} <> '' AND {c}.year > 0)))"
_CANON = f"""{_REFS}, rc AS (
  SELECT *, CASE WHEN {_USABLE('r.canonicalReference')} THEN r.canonicalReference WHEN r.resolution.status = 'matched' AND {_USABLE('r.resolution.canonical')} THEN r.resolution.canonical END AS c FROM refs
)"""

def _compact(c: str) -> str:
    a, b = _letters(False)
    return rf"regexp_replace(lower(translate({_ligatures(f'strip_accents({clean_sql(c)})')}, '{a}', '{b}')), '[^\p{{L}}\p{{N}}]', '', 'g')"


_LOCAL = f"""{_CANON}, l AS (
  SELECT source_id, ordinal, {doi_sql('r.doi')} AS doi, lower({clean_sql('r.semanticScholarId')}) AS s2, {arxiv_sql('r.arxivId')} AS arxiv, {clean_sql('r.rawText')} AS raw,
    lower(regexp_replace({clean_sql('r.rawText')}, '[\\s\\p{{Z}}]+', '', 'g')) AS flat, {_compact('r.rawText')} AS compact, {_YEAR('r.year')} AS ref_year,
    list_distinct(regexp_extract_all({clean_sql('r.rawText')}, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:$|[^0-9])', 1) || CASE WHEN r.year > 0 THEN [CAST(r.year AS VARCHAR)] ELSE [] END) AS years
  FROM rc WHERE c IS NULL AND r.reviewed
), pe AS (
  SELECT *, {_compact('title')} AS ctitle, len(string_split_regex({clean_sql('title')}, '[\\s\\p{{Z}}]+')) AS wc, {_compact("string_split_regex(" + clean_sql('authors[1]') + ", '[\\s\\p{Z}]+')[-1]")} AS surname, {_YEAR('year')} AS y FROM pk
), cand AS (
  SELECT l.source_id, l.ordinal, r.id AS target, r.y, l.doi AS ld, r.doi AS rd, l.s2 AS ls, r.s2 AS rs, l.arxiv AS la, r.arxiv AS ra,
    (l.doi <> '' AND r.doi <> '' AND l.doi <> r.doi) AS cd, (l.s2 <> '' AND r.s2 <> '' AND l.s2 <> r.s2) OR (l.arxiv <> '' AND r.arxiv <> '' AND l.arxiv <> r.arxiv) AS co,
    r.doi <> '' AND starts_with(r.doi, l.doi) AND strpos(l.flat, r.doi) > 0
      AND NOT regexp_matches(substr(l.flat, strpos(l.flat, r.doi) - 1, CASE WHEN strpos(l.flat, r.doi) > 1 THEN 1 ELSE 0 END), '[a-z0-9]')
      AND NOT regexp_matches(substr(l.flat, strpos(l.flat, r.doi) + length(r.doi), 1), '[a-z0-9/_-]') AS printed,
    length(ctitle) >= 40 AND wc >= 5 AND length(surname) >= 3 AND len(years) > 0 AND (r.y IS NULL OR (list_contains(years, CAST(r.y AS VARCHAR)) AND (ref_year IS NULL OR ref_year = r.y)))
      AND strpos(compact, ctitle) > 0 AND contains(substr(compact, greatest(1, strpos(compact, ctitle) - 350), least(350, strpos(compact, ctitle) - 1)), surname) AS titled
  FROM l JOIN pe r ON r.id <> l.source_id AND ((l.doi <> '' AND l.doi = r.doi) OR (l.s2 <> '' AND l.s2 = r.s2) OR (l.arxiv <> '' AND l.arxiv = r.arxiv) OR (r.doi <> '' AND contains(l.flat, r.doi)) OR (length(ctitle) >= 40 AND contains(compact, ctitle)))
), rungs AS (
  SELECT source_id, ordinal, target, y, unnest([CASE WHEN ld <> '' AND ld = rd AND NOT cd AND NOT co THEN 0 END, CASE WHEN ls <> '' AND ls = rs AND NOT cd AND NOT co THEN 1 END,
    CASE WHEN la <> '' AND la = ra AND NOT cd AND NOT co THEN 2 END, CASE WHEN printed AND NOT co THEN 3 END, CASE WHEN titled AND NOT cd AND NOT co THEN 4 END]) AS rung FROM cand
), first AS (SELECT source_id, ordinal, min(rung) AS rung FROM rungs WHERE rung IS NOT NULL GROUP BY ALL)
, lt AS (SELECT r.source_id, r.ordinal, min(target) AS target, CASE r.rung WHEN 0 THEN 'local-doi' WHEN 1 THEN 'local-semanticScholarId' WHEN 2 THEN 'local-arxivId' WHEN 3 THEN 'local-doi-text' ELSE CASE WHEN min(y) IS NULL THEN 'local-title-author' ELSE 'local-title-author-year' END END AS matched_by
FROM rungs r JOIN first USING (source_id, ordinal, rung) GROUP BY r.source_id, r.ordinal, r.rung HAVING count(DISTINCT target) = 1)"""
_CT = f"""ct AS (SELECT source_id, ordinal, min(r.id) AS target FROM (SELECT source_id, ordinal, {_KEYS('c.doi', 'c.semanticScholarId', 'c.arxivId', 'c.title', 'c.year')} FROM rc WHERE c IS NOT NULL) l
  JOIN pk r ON r.id <> l.source_id AND {_SAME} GROUP BY ALL HAVING count(DISTINCT r.id) = 1)"""

ORACLE = {
    "identity_keys": f"""{ONCE} SELECT id, CASE WHEN {doi_sql('doi')} <> '' THEN 'doi:' || {doi_sql('doi')} WHEN coalesce(semanticScholarId, '') <> '' THEN 's2:' || semanticScholarId
  WHEN coalesce(arxivId, '') <> '' THEN 'arxiv:' || lower(arxivId) ELSE 'title:' || {title_sql('title')} || ':' || {_YT('year')} END AS identity,
  {title_sql('title')} || ':' || {_YT('year')} AS title_year, {_TY('title', 'year')} AS strict_title_year,
  CASE WHEN {doi_sql('doi')} <> '' THEN 'doi:' || {doi_sql('doi')} WHEN coalesce(arxivId, '') <> '' THEN 'arxiv:' || arxivId WHEN coalesce(openAlexId, '') <> '' THEN 'openalex:' || openAlexId ELSE 'none' END AS provider_id FROM p""",
    "arxiv_forms": rf"""{ONCE}, a AS (SELECT id, arxivId, regexp_replace({clean_sql('arxivId')}, '(?i)^arxiv:\s*', '') AS bare FROM p WHERE {clean_sql('arxivId')} <> '')
SELECT id, {arxiv_sql('arxivId')} AS identity, lower(regexp_replace(bare, '(?i)v\d+$', '')) AS reference, lower(bare) AS versioned, bare, regexp_replace(bare, '(?i)v\d+$', '') AS base FROM a""",
    "slugs": f"{ONCE}, n AS (SELECT id, {title_sql('title')} AS title FROM p) SELECT id, title, substr(replace(title, ' ', '-'), 1, 80) AS slug80, substr(replace(title, ' ', '-'), 1, 70) AS slug70 FROM n",
    "author_keys": f"{ONCE}, n AS (SELECT DISTINCT unnest(authors) AS name FROM p) SELECT name, {author_sql('name')} AS key FROM n WHERE name IS NOT NULL",
    "same_work_pairs": f"""{_REFS}, w AS (SELECT DISTINCT ON (record_id) * FROM provider_works), l AS (SELECT record_id, {_KEYS('doi', 'NULL', 'NULL', 'title', 'year')} FROM w)
SELECT l.record_id, r.id AS paper_id FROM l JOIN pk r ON {_SAME}""",
    "canonical_targets": f"{_CANON}, {_CT} SELECT * FROM ct",
    "local_targets": f"{_LOCAL} SELECT * FROM lt",
    "inferred_edges": f"""{_LOCAL}, {_CT}, x AS (
  SELECT ct.source_id, ct.ordinal, target, {clean_sql('r.resolution.provider')} AS provider, {clean_sql('r.resolution.matchedBy')} AS matched_by FROM ct JOIN rc USING (source_id, ordinal) WHERE coalesce(r.reviewed, true)
  UNION ALL SELECT source_id, ordinal, target, 'local-library', matched_by FROM lt
), f AS (SELECT source_id, target, arg_min(provider, ordinal) AS provider, arg_min(matched_by, ordinal) AS matched_by FROM x GROUP BY ALL)
SELECT source_id || '->' || target AS id, source_id AS source, target, 'citation' AS kind, 'reviewed-reference' AS provenance, provider, matched_by FROM f WHERE source_id || '->' || target NOT IN (SELECT id FROM e)""",
    "stored_reference_papers": f"""{_REFS}, l AS (SELECT source_id, ordinal, {_KEYS('r.doi', 'r.semanticScholarId', 'r.arxivId', 'r.title', 'r.year')} FROM refs)
SELECT source_id, ordinal, min(r.id) AS target FROM l JOIN pk r ON (l.doi <> '' AND l.doi = r.doi) OR (l.s2 <> '' AND l.s2 = r.s2) OR (l.arxiv <> '' AND l.arxiv = r.arxiv) OR (l.ty <> '' AND l.ty = r.ty) GROUP BY ALL HAVING count(DISTINCT r.id) = 1""",
    "reference_texts": rf"""{ONCE}, k AS (SELECT *, array_to_string(list_filter(list_transform(coalesce(authors, []), lambda x: {clean_sql('x')}), lambda x: x <> ''), ', ') AS names, {doi_sql('doi')} AS d FROM p)
SELECT id, regexp_replace(array_to_string(list_filter([names, CASE WHEN year > 0 THEN '(' || year || ')' ELSE '' END, {clean_sql('title')}, {clean_sql('venue')}, CASE WHEN d <> '' THEN 'https://doi.org/' || d ELSE '' END], lambda x: x <> ''), '. '), '\.{{2,}}', '.', 'g') AS text,
  array_to_string(list_transform(coalesce(authors, []), lambda x: coalesce(x, '')), ', ') || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '). ' || coalesce(title, '') || '.' || CASE WHEN {clean_sql('venue')} <> '' THEN ' ' || {clean_sql('venue')} || '.' ELSE '' END || CASE WHEN d <> '' THEN ' https://doi.org/' || d ELSE '' END AS citation FROM k""",
    "resolution_counts": f"""{_REFS}, k AS (SELECT source_id, r, {doi_sql('r.doi')} AS d, {arxiv_sql('r.arxivId')} AS a FROM refs)
SELECT source_id, count(*) AS n_references, count(*) FILTER (r.resolution.status IN ('matched', 'resolved')) AS matched, count(*) FILTER (r.resolution.status = 'candidates') AS candidates, count(*) FILTER (r.resolution.status = 'unresolved') AS unresolved,
  count(*) FILTER (d <> '' OR a <> '') AS identifiable, count(*) FILTER (d = '' AND a = '') AS text_only, count(*) FILTER (d <> '') AS with_doi, count(*) FILTER (a <> '') AS with_arxiv FROM k GROUP BY source_id""",
    "reference_fields": rf"""{_REFS} SELECT source_id, ordinal, nullif(lower(regexp_replace(regexp_extract(r.rawText, '(?i)\b10\.\d{{4,9}}/[-._;()/:A-Z0-9]+\b'), '[.,;:]+$', '')), '') AS doi,
  TRY_CAST(regexp_extract(r.rawText, '\b((?:19|20)\d{{2}})[a-z]?\b', 1) AS INTEGER) AS year,
  substr({squeeze_sql(r"regexp_replace(regexp_replace(r.rawText, '^\s*(?:\[[^\]]+\]|\d+[.)])\s*', ''), '\b(?:18|19|20)\d{2}\b', ' ', 'g')")}, 1, 300) AS query,
  CASE WHEN {doi_sql('r.doi')} <> '' THEN 'doi:' || {doi_sql('r.doi')} WHEN {clean_sql('r.arxivId')} <> '' THEN 'arxiv:' || lower({clean_sql('r.arxivId')}) ELSE 'raw:' || lower({squeeze_sql('r.rawText')}) END AS key FROM refs""",
    "edge_ids": f"""{ONCE}, x AS (SELECT id, CASE WHEN coalesce(kind = 'research-relation' AND relation IN ('builds_on', 'improves_on', 'extends', 'outperforms', 'invalidates', 'contradicts', 'supports', 'replicates'), false)
  THEN 'relation:' || relation || ':' || source || '->' || target ELSE source || '->' || target END AS expected FROM e) SELECT id, expected, id = expected AS as_expected FROM x""",
    "document_identifiers": r"""SELECT doc_id, nullif(lower(regexp_replace(regexp_extract(text, '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b'), '[.,;:]+$', '')), '') AS doi,
  coalesce(nullif(regexp_extract(text, '(?i)(?:arxiv\s*:\s*)?(\d{4}\.\d{4,5}(?:v\d+)?)', 1), ''), nullif(lower(regexp_extract(text, '(?i)(?:arxiv\s*:\s*)?([a-z][a-z0-9.\-]+/\d{7}(?:v\d+)?)', 1)), '')) AS arxiv,
  TRY_CAST(regexp_extract(text, '\b((?:19|20)\d{2})[a-z]?\b', 1) AS INTEGER) AS year FROM documents WHERE text IS NOT NULL""",
}
