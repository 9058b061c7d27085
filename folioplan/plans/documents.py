"""Queries over page texts, extracted entries, and the quality of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioplan.compat import cut, table
from folioplan.functions import normalize as N
from folioplan.operators import extract, front_matter, quality
from folioplan.plans.base import _letters, _ligatures, arxiv_sql, clean_sql, doi_sql, papers, title_sql


def _pages(s: SparkSession, d: str) -> DataFrame:
    return extract.pages_once(table(s, d, "pdf_pages"))


def bibliography_start(s: SparkSession, d: str) -> DataFrame:
    return extract.bibliography_start(_pages(s, d))


def signal_lines(s: SparkSession, d: str) -> DataFrame:
    lines = extract.page_lines(_pages(s, d))
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.count_if(extract.is_signal(F.col("text"))).alias("n_signals"))


def bibliography_references(s: SparkSession, d: str) -> DataFrame:
    return extract.references(table(s, d, "pdf_pages"))


def extraction_warnings(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    w = extract.warnings(p, extract.references(p), extract.bibliography_start(p))
    return w.select("doc_id", "n_references", F.array_join("warnings", "|").alias("warnings"))


def assembled_documents(s: SparkSession, d: str) -> DataFrame:
    return extract.document_text(_pages(s, d))


def reassembled_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages read back out of assembled documents."""
    return extract.pages_from_text(extract.document_text(_pages(s, d)))


def page_summaries(s: SparkSession, d: str) -> DataFrame:
    return extract.page_summaries(_pages(s, d))


def front_matters(s: SparkSession, d: str) -> DataFrame:
    m = front_matter.metadata(table(s, d, "pdf_pages"))
    return m.select("doc_id", "title", F.array_join("authors", "|").alias("authors"), "year", "doi", F.array_join("warnings", "|").alias("warnings"))


def paper_proposals(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pdf_pages")
    return front_matter.proposals(front_matter.metadata(p), extract.references(p)).select("id", "doc_id", "title", "year", "n_references")


def _drafts(s: SparkSession, d: str) -> DataFrame:
    """The entries that reference_drafts expects, as text."""
    x = table(s, d, "reference_drafts").dropDuplicates(["doc_id", "draft_no"])
    return x.select("doc_id", F.concat_ws("#", "doc_id", "draft_no").alias("eid"), F.array_join(F.transform("lines", lambda y: N.text(y["text"])), " ").alias("text"), F.element_at("lines", 1)["page"].alias("first"), F.element_at("lines", -1)["page"].alias("last"))


def _found(s: SparkSession, d: str) -> DataFrame:
    r = extract.references(table(s, d, "pdf_pages"))
    return r.select("doc_id", F.concat_ws("#", "doc_id", "index").alias("aid"), F.col("rawText").alias("text"), "pageStart", "pageEnd")


def draft_grams(s: SparkSession, d: str) -> DataFrame:
    """Shingle counts of every expected entry."""
    return quality.grams(_drafts(s, d), "eid", "text").groupBy("eid").agg(F.count("*").alias("distinct_grams"), F.sum("n").alias("grams"))


def _matches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, a = cut(_drafts(s, d)), cut(_found(s, d))  # each is used four times
    pairs = quality.gram_similarity(e, a).join(e.select("eid", "first", "last"), "eid").join(a.select("aid", "pageStart", "pageEnd"), "aid")
    pairs = pairs.withColumn("page_match", (F.col("pageStart") <= F.col("last")) & (F.col("pageEnd") >= F.col("first"))).select("doc_id", "eid", "aid", "precision", "recall", "similarity", "page_match")
    return e, a, quality.greedy(pairs)


def entry_matches(s: SparkSession, d: str) -> DataFrame:
    m = _matches(s, d)[2]
    return m.select("eid", "aid", F.round("similarity", 6).alias("similarity"), "page_match")


def reference_scores(s: SparkSession, d: str) -> DataFrame:
    r = quality.reference_scores(*_matches(s, d))
    return r.select("doc_id", "expected_count", "actual_count", "matched", *[F.round(c, 6).alias(c) for c in ("f1", "page_coverage", "score")], "complete")


def import_scores(s: SparkSession, d: str) -> DataFrame:
    """The rubric over every document whose paper the library knows: front matter against the record, entries against drafts."""
    m = front_matter.metadata(table(s, d, "pdf_pages"))
    p = papers(s, d).where("sourceFileName IS NOT NULL").withColumn("doc_id", F.concat(F.lit("pdf:"), F.regexp_replace("sourceFileName", r"\.pdf$", ""))).groupBy("doc_id").agg(F.min_by(F.struct("title", "authors", "year", "doi"), "id").alias("p"))
    j = m.join(p, "doc_id")
    people = quality.author_scores(j.select(F.col("doc_id").alias("id"), F.transform("authors", quality.normalized).alias("actual"), F.transform("p.authors", quality.normalized).alias("expected")))
    refs = quality.reference_scores(*_matches(s, d)).select("doc_id", F.col("score").alias("references"))
    same = lambda a, b: F.coalesce((a == b).cast("double"), F.lit(0.0))
    parts = j.join(people.select(F.col("id").alias("doc_id"), F.col("score").alias("people")), "doc_id").join(refs, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.lit(True).alias("ok"), same(quality.normalized(F.col("title")), quality.normalized(F.col("p.title"))).alias("title"), F.col("people").alias("authors"), same(F.col("year"), F.col("p.year")).alias("year"),
        F.when(N.normalize_doi(F.col("p.doi")) != "", same(N.text(F.col("doi")), N.normalize_doi(F.col("p.doi")))).alias("doi"), F.coalesce("references", F.lit(0.0)).alias("references"),
    )
    return quality.rubric(parts)


def import_score(s: SparkSession, d: str) -> DataFrame:
    return quality.corpus_score(import_scores(s, d))


def stripped_abstracts(s: SparkSession, d: str) -> DataFrame:
    """Documents without markup and entities."""
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", N.plain_abstract(F.col("text")).alias("text"))


def highlights(s: SparkSession, d: str) -> DataFrame:
    """Spans of the titles that a search for two words marks."""
    parts = N.highlight_parts(F.col("title"), "sensor fusion")
    return papers(s, d).select("id", F.size(F.filter(parts, lambda x: x["match"])).alias("n_marked"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("title")).where("n_marked > 0")


def attachment_keys(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d).where("sourceFileName IS NOT NULL")
    key = N.attachment_key({k: F.col(k) for k in ("doi", "arxivId", "title", "year")}, F.col("sourceFileName"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))
    return p.select("id", key.alias("key"), N.file_stem(F.col("sourceFileName")).alias("stem"), N.file_kind(F.col("sourceFileName")).alias("kind"))


def id_hashes(s: SparkSession, d: str) -> DataFrame:
    """FNV-1a of every id, the seed of its place in a force layout."""
    return papers(s, d).select("id", N.fnv1a(F.col("id")).alias("hash"))


def identifier_kinds(s: SparkSession, d: str) -> DataFrame:
    ids = papers(s, d).select("id", F.explode(F.array("doi", "semanticScholarId", "openAlexId", "arxivId")).alias("value")).where("value IS NOT NULL")
    return ids.select("id", "value", N.identifier_kind(F.col("value")).alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        bibliography_start, signal_lines, bibliography_references, extraction_warnings, assembled_documents, reassembled_pages, page_summaries, front_matters, paper_proposals, draft_grams, entry_matches, reference_scores,
        import_scores, import_score, stripped_abstracts, highlights, attachment_keys, id_hashes, identifier_kinds,
    )
}

_ONCE = "p AS (SELECT DISTINCT ON (doc_id, page) * FROM (SELECT * FROM pdf_pages ORDER BY doc_id, page, text DESC, citation_text DESC))"
_LINES = r"l AS (SELECT doc_id, page, unnest(string_split_regex(regexp_replace(citation_text, '\r?\n$', ''), '\r?\n')) AS text, generate_subscripts(string_split_regex(regexp_replace(citation_text, '\r?\n$', ''), '\r?\n'), 1) - 1 AS line FROM p WHERE coalesce(citation_text, '') <> '')"
_SIGNAL = rf"""({clean_sql('text')} <> '' AND (regexp_matches(text, '^\s*(?:\[(\d{{1,4}})\]|(\d{{1,3}})[.)])\s*(.*)$') OR regexp_matches(text, '^\s*\p{{Lu}}[\p{{L}}''’\-]+(?:,|\s).{{0,150}}\b(?:19|20)\d{{2}}[a-z]?\b')
  OR regexp_matches(text, '(?i)\b10\.\d{{4,9}}/[-._;()/:A-Z0-9]+\b') OR regexp_matches(text, '\d{{4}}\.\d{{4,5}}') OR regexp_matches(text, '(?i)[a-z][a-z0-9.\-]+/\d{{7}}')))"""
_BARE = rf"lower({clean_sql('regexp_replace(' + clean_sql('text') + chr(44) + chr(39) + '^[:.—-]+|[:.—-]+$' + chr(39) + chr(44) + chr(39) + chr(39) + chr(44) + chr(39) + 'g' + chr(39) + ')')})"
def _normalized_sql(c: str) -> str:
    a, b = _letters(False)
    return rf"trim(regexp_replace(lower(translate({_ligatures(f'strip_accents(coalesce({c}, {chr(39)}{chr(39)}))')}, '{a}', '{b}')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_ONCE_PAPERS = "lib AS (SELECT * FROM papers WHERE coalesce(id, '') <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY importedAt DESC NULLS LAST, createdAt DESC NULLS LAST) = 1)"

ORACLE = {
    "bibliography_start": f"""WITH {_ONCE}, {_LINES}, h AS (SELECT doc_id, max((page, line)) AS k FROM l WHERE {_BARE} IN ('references', 'bibliography', 'works cited', 'literature cited', 'references and notes') GROUP BY doc_id
), o AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, page FROM p)
), s AS (SELECT l.doc_id, min(l.page) AS page FROM (SELECT doc_id, page FROM l WHERE {_SIGNAL} GROUP BY ALL HAVING count(*) >= 3) l JOIN o USING (doc_id, page) WHERE i >= floor(n * 3 / 5) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(h.k[1], s.page) AS page, coalesce(h.k[2] + 1, 0) AS line, CASE x.b WHEN 'references' THEN 'References' WHEN 'bibliography' THEN 'Bibliography' WHEN 'works cited' THEN 'Works Cited' WHEN 'literature cited' THEN 'Literature Cited' WHEN 'references and notes' THEN 'References and Notes' END AS heading, h.k IS NULL AS inferred
FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN (SELECT doc_id, page, line, {_BARE} AS b FROM l) x ON x.doc_id = d.doc_id AND x.page = h.k[1] AND x.line = h.k[2] WHERE h.k IS NOT NULL OR s.page IS NOT NULL""",
    "signal_lines": f"WITH {_ONCE}, {_LINES} SELECT doc_id, page, count(*) AS n_lines, count(*) FILTER ({_SIGNAL}) AS n_signals FROM l GROUP BY ALL",
    "assembled_documents": f"WITH {_ONCE} SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || {clean_sql('text')}, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY doc_id",
    "page_summaries": rf"WITH {_ONCE} SELECT doc_id, page, width, height, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n')) END AS line_count, length(coalesce(text, '')) AS text_length FROM p",
    "reassembled_pages": f"WITH {_ONCE} SELECT doc_id, page, {clean_sql('text')} AS text FROM p",
    "id_hashes": f"WITH {_ONCE_PAPERS} SELECT id, CAST(list_reduce(list_transform(string_split(id, ''), lambda x: CAST(unicode(x) AS UBIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296, CAST(2166136261 AS UBIGINT)) AS BIGINT) AS hash FROM lib",
    "highlights": f"""WITH {_ONCE_PAPERS}, k AS (SELECT id, coalesce(title, '') AS title, regexp_matches(title, '(?i)sensor\\s+fusion') AS whole FROM lib), n AS (SELECT id, title, CASE WHEN whole THEN len(regexp_extract_all(title, '(?i)sensor\\s+fusion')) ELSE len(regexp_extract_all(title, '(?i)sensor|fusion')) END AS n_marked FROM k)
SELECT id, n_marked, title FROM n WHERE n_marked > 0""",
    "draft_grams": rf"""WITH x AS (SELECT DISTINCT ON (doc_id, draft_no) * FROM reference_drafts), t AS (SELECT doc_id || '#' || draft_no AS eid, array_to_string(list_transform(lines, lambda y: coalesce(y.text, '')), ' ') AS text FROM x),
c AS (SELECT eid, replace({_normalized_sql(r"regexp_replace(text, '^\s*(?:\[\d+\]|\d+\.)\s*', '')")}, ' ', '') AS t FROM t), g AS (SELECT eid, unnest(list_transform(range(1, length(t) - 3), lambda k: substr(t, k, 5))) AS gram FROM c WHERE length(t) >= 5)
SELECT eid, count(DISTINCT gram) AS distinct_grams, count(*) AS grams FROM g GROUP BY eid""",
    "stripped_abstracts": rf"""SELECT doc_id, {clean_sql(r"regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + chr(34) + r"'), '&#39;', ''''), '&amp;', '&'), '[\s\p{Z}\x{FEFF}]+', ' ', 'g')")} AS text FROM documents WHERE text IS NOT NULL""",
    "attachment_keys": rf"""WITH {_ONCE_PAPERS} SELECT id, CASE WHEN {doi_sql('doi')} <> '' THEN 'doi:' || {doi_sql('doi')} WHEN {arxiv_sql('arxivId')} <> '' THEN 'arxiv:' || {arxiv_sql('arxivId')}
  WHEN {title_sql('title')} <> '' AND year > 0 THEN 'title:' || {title_sql('title')} || ':' || year ELSE 'file:' || lower({clean_sql('sourceFileName')}) END AS key,
  regexp_replace(regexp_replace(sourceFileName, '^.*[/\\]', ''), '\.[^.]+$', '') AS stem, 'pdf' AS kind FROM lib WHERE sourceFileName IS NOT NULL""",
    "identifier_kinds": rf"""WITH {_ONCE_PAPERS}, x AS (SELECT id, unnest([doi, semanticScholarId, openAlexId, arxivId]) AS value FROM lib)
SELECT id, value, CASE WHEN regexp_matches({doi_sql('value')}, '(?i)^10\.\d{{4,9}}/') THEN 'doi' WHEN regexp_matches({clean_sql('value')}, '(?i)^[0-9a-f]{{40}}$') THEN 'semantic-scholar' WHEN regexp_matches({clean_sql('value')}, '(?i)^(https?://openalex\.org/)?W\d+$') THEN 'openalex'
  WHEN regexp_matches({clean_sql('value')}, '(?i)^(arxiv:)?(\d{{4}}\.\d{{4,5}}|[a-z][a-z0-9.\-]+/\d{{7}})(v\d+)?$') THEN 'arxiv' WHEN {clean_sql('value')} <> '' THEN 'title' ELSE '' END AS kind FROM x WHERE value IS NOT NULL""",
}

