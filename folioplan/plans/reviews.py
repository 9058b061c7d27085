"""Queries over writes, reviews of metadata and references, provider payloads, and the filters by selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioplan.compat import table
from folioplan.functions import normalize as N
from folioplan.operators import geometry, graph, layout, library, merge, reconcile, resolve
from folioplan.operators.library import Filters
from folioplan.plans.base import ONCE, arxiv_sql, clean_sql, doi_sql, edges, papers, slug_sql, squeeze_sql, title_sql, topics
from folioplan.plans.maps import _AUTHORS, _ENTRY, _TOPICS, _ranked
from folioplan.plans.references import _REFS, _TY, _USABLE, _YT
from folioplan.plans.themes import _WI, _incoming
from folioplan.sources import demo, sinks

_IDS = ("title", "year", "doi", "semanticScholarId", "arxivId")


# ---- writes (K2, K6, J5) ------------------------------------------------------------------------------------------


def _deliveries(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first and the latest delivery of every paper."""
    raw = table(s, d, "papers").where("id <> ''")
    first = library.latest(raw.withColumn("_at", -F.coalesce(F.unix_micros("importedAt"), F.lit(2**62))), "id", F.col("_at"), F.unix_micros("createdAt")).drop("_at")
    return first, papers(s, d)


def put_papers(s: SparkSession, d: str) -> DataFrame:
    """The library after the latest delivery of every paper was put over the first, with their merged references."""
    first, latest = _deliveries(s, d)
    after = sinks.put_papers(first, edges(s, d), latest)[0]
    return after.select("id", "title", F.greatest(F.coalesce(F.size("extractedReferences"), F.lit(0)), F.lit(0)).alias("n_references"))


def remapped_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges that arise when all papers of one identity become the first of them."""
    p = papers(s, d).select("id", N.paper_identity_key({k: F.col(k) for k in _IDS}).alias("k"))
    firsts = p.groupBy("k").agg(F.min("id").alias("new"))
    e = edges(s, d)
    return merge.remapped_edges(e, p.join(firsts, "k").select(F.col("id").alias("old"), "new"), e).select("id", "source", "target")


def deleted_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges after all research relations were deleted by their ids."""
    e = edges(s, d)
    return sinks.delete_edges(e, e.where(N.is_research_relation(F.col("kind"), F.col("relation")))).select("id")


# ---- reviews of metadata (A11, A12, N19, N28, N29, N37, N45 to N47) -----------------------------------------------


def _reviewed(s: SparkSession, d: str) -> tuple[DataFrame, dict, dict]:
    fields = ("title", "authors", "year", "venue", "type", "doi", "semanticScholarId", "openAlexId", "arxivId", "citationCount")
    w = _incoming(s, d).withColumn("ty", N.title_year_key(F.col("title"), F.col("year"), strict=True))
    online = w.where("doi <> ''").groupBy(F.col("doi").alias("_d")).agg(F.min_by(F.struct(*fields), "id").alias("online"))
    ai = w.where("ty <> ''").groupBy(F.col("ty").alias("_t")).agg(F.max_by(F.struct(*fields), "id").alias("ai"))
    local = papers(s, d).withColumn("_d", N.normalize_doi(F.col("doi"))).withColumn("_t", N.title_year_key(F.col("title"), F.col("year"), strict=True))
    j = local.join(online, "_d", "left").join(ai, "_t", "left")
    none = {"url": F.lit(""), "abstract": F.lit(""), "keywords": F.array().cast("array<string>")}
    sides = [{f: F.col(f"{x}.{f}") for f in fields} | none for x in ("ai", "online")]
    mine = {f: F.col(f) for f in (*fields, "url", "abstract", "keywords")}
    return j, mine, merge.merge_review(mine, *sides)


def reviewed_metadata(s: SparkSession, d: str) -> DataFrame:
    """Metadata of every paper merged from itself, the provider's record of its title and the one of its DOI."""
    j, _, m = _reviewed(s, d)
    return j.select("id", *[m[k].alias(k) for k in ("title", "venue", "type", "doi", "year", "citationCount")], F.size(m["authors"]).alias("n_authors"), F.size(m["keywords"]).alias("n_keywords"))


def applied_drafts(s: SparkSession, d: str) -> DataFrame:
    """The same, applied to drafts whose title and venue the reviewer has touched where the paper is starred."""
    j, mine, m = _reviewed(s, d)
    dirty = F.when(F.col("starred"), F.array(F.lit("title"), F.lit("venue"))).otherwise(F.array().cast("array<string>"))
    done = merge.apply_to_draft(mine, m, dirty)
    return j.select("id", *[done[k].alias(k) for k in ("title", "venue", "doi")])


def review_checks(s: SparkSession, d: str) -> DataFrame:
    """Whether year, DOI and arXiv id of every paper would pass a review, and what would be searched for."""
    year, doi, arxiv = F.col("year").cast("string"), F.col("doi"), F.col("arxivId")
    q = resolve.online_query(F.col("title"), doi, arxiv, F.when(N.clean(doi) != "", "doi").when(N.clean(arxiv) != "", "arxiv").otherwise("title"))
    return papers(s, d).select("id", N.valid_year(year).alias("year_ok"), N.valid_doi(doi).alias("doi_ok"), N.valid_arxiv(arxiv).alias("arxiv_ok"), q["query"].alias("query"), q["error"].alias("error"))


def model_answers(s: SparkSession, d: str) -> DataFrame:
    """Papers in the form of a model's answer, within the bounds put on one."""
    found = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.struct(k.alias("name"), (F.col("relevance") / 4).alias("confidence")))
    m = N.ai_metadata({"title": F.col("title"), "authors": F.col("authors"), "year": F.col("year"), "keywords": F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>"))), "topics": found, "confidence": F.col("relevance") / 4 - 0.5, "warnings": F.col("tags")})
    return papers(s, d).select("id", m["title"].alias("title"), F.size(m["authors"]).alias("n_authors"), m["year"].alias("year"), F.array_join(m["keywords"], "|").alias("keywords"), F.array_join(F.transform(m["topics"], lambda t: t["name"]), "|").alias("topics"), F.aggregate(m["topics"], F.lit(0.0), lambda a, t: a + t["confidence"]).alias("sum_confidence"), m["confidence"].alias("confidence"))


def model_inputs(s: SparkSession, d: str) -> DataFrame:
    """Texts as a model gets them, whole up to a limit, else head and tail."""
    t = table(s, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.md5(N.ai_text(F.col("text"))).alias("whole"), N.ai_text(F.col("text"), 400).alias("short"))


def reviewed_identities(s: SparkSession, d: str) -> DataFrame:
    """Identity of a reviewed paper, its status today, and its words without repetitions."""
    words = N.unique_strings(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>"))))
    return papers(s, d).select("id", N.reviewed_paper_identity({k: F.col(k) for k in _IDS}, F.col("id")).alias("identity"), N.reading_status(F.col("status")).alias("status"), F.array_join(words, "|").alias("words"))


def library_entries(s: SparkSession, d: str) -> DataFrame:
    """How every paper came in, with the default where it does not say so."""
    e = merge.library_entry()
    return papers(s, d).select("id", e["method"].alias("method"), e["fileName"].alias("file"), e["parentPaperId"].alias("parent"))


def provider_topics(s: SparkSession, d: str) -> DataFrame:
    """Topics that papers' keywords would make as a provider's topic names."""
    named = papers(s, d).select("id", "topics", "providerPrimary", "source", F.col("keywords").alias("topicNames"))
    return merge.with_provider_topics(named)[1].select("id", "name", "source")


def request_log(s: SparkSession, d: str) -> DataFrame:
    """Addresses that papers give for themselves, as a log may show them."""
    urls = papers(s, d).select(F.explode(F.array("doi", "openAlexId", "arxivId", "url", "pdfUrl", "semanticScholarId")).alias("url")).where(F.col("url").rlike("^https?://")).distinct()
    return urls.select("url", N.request_source(F.col("url")).alias("service"), N.request_target(F.col("url")).alias("target"))


# ---- references (A8, J21, V11, N20, N43) --------------------------------------------------------------------------


def reference_keys(s: SparkSession, d: str) -> DataFrame:
    """Provider key and display line of every reference."""
    r = reconcile.references(papers(s, d))
    fields = {k: F.col(k) for k in ("doi", "arxivId", "semanticScholarId", "openAlexId", "title", "year", "rawText")}
    shown = {k: F.col(k) for k in ("label", "pageStart", "pageEnd", "year", "doi", "confidence")}
    return r.select("source_id", "ordinal", N.provider_reference_key(fields).alias("key"), N.reference_meta(shown).alias("meta"))


def merged_reference_records(s: SparkSession, d: str) -> DataFrame:
    """References over all deliveries of a paper, merged by the key that providers use."""
    m = reconcile.merged_reference_records(_cells(s, d))
    return m.select("source_id", "key", "ordinal", "title", "year", "reviewed", F.col("resolution").isNotNull().alias("resolved"))


def _cells(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "papers").where("id <> ''").select("id", "extractedReferences", F.coalesce(F.unix_micros("importedAt"), F.lit(0)).alias("at")).distinct()
    return rows.select(F.col("id").alias("source_id"), "at", F.posexplode("extractedReferences").alias("k", "r")).select("source_id", (F.col("at") * 1000 + F.col("k")).alias("ordinal"), "r.*")


def kept_selections(s: SparkSession, d: str) -> DataFrame:
    """References of today with the choice made for the same text before."""
    key = F.concat_ws("\x00", "source_id", N.review_reference_key({k: F.col(k) for k in ("doi", "arxivId", "rawText")}))
    old = _cells(s, d).withColumn("key", key).select("key", "ordinal", F.col("reviewed").alias("use"))
    new = reconcile.references(papers(s, d)).withColumn("key", key).select("source_id", "ordinal", "key")
    return reconcile.kept_selections(old, new).select("source_id", "ordinal", "use")


def selected_candidates(s: SparkSession, d: str) -> DataFrame:
    """Open references whose first candidate the user chose."""
    open_ = F.col("resolution").withField("status", F.lit("candidates"))
    r = reconcile.references(papers(s, d)).where("resolution IS NOT NULL").withColumn("c", resolve.selected(open_, 0)).where("c IS NOT NULL")
    return r.select("source_id", "ordinal", *[F.col(f"c.{k}").alias(k) for k in ("status", "provider", "matchedBy", "confidence", "selectedBy")], F.col("c.canonical.doi").alias("doi"))


# ---- providers (N12, N14 to N16, N26, U7, O4) ---------------------------------------------------------------------


def provider_fields(s: SparkSession, d: str) -> DataFrame:
    """What is read from dates, inverted abstracts, work ids and concepts of providers."""
    words = F.split(N.squeeze(F.col("title")), " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
    dates = N.first_date_year(F.array(F.array(F.lit(0))), F.lit(None).cast("array<array<int>>"), F.array(F.array("year", F.lit(5))))
    concepts = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.struct(a.alias("display_name"), (F.length(a) / 30).alias("score")))
    w = table(s, d, "provider_works").dropDuplicates(["record_id"])
    return w.select(
        "record_id", dates.alias("year"), N.abstract_from_inverted_index(index).alias("abstract"), N.open_alex_id(F.concat(F.lit("https://openalex.org/w"), F.regexp_extract("record_id", r"(\d+)$", 1))).alias("work"),
        N.arxiv_from_locations(F.array(F.col("doi"), F.concat(F.lit("http://arxiv.org/pdf/"), "record_id", F.lit(".pdf")))).alias("arxiv"),
        F.array_join(N.open_alex_topics(F.array("provider"), concepts), "|").alias("topics"), N.crossref_confidence(F.col("doi"), F.col("title"), F.col("venue")).alias("confidence"),
    )


def united_candidates(s: SparkSession, d: str) -> DataFrame:
    """Candidates that each provider gives for the title of a paper, united without looking across providers."""
    w = _incoming(s, d).withColumn("k", N.normalized_title(F.col("title")))
    p = papers(s, d).select(F.col("id").alias("query_id"), N.normalized_title(F.col("title")).alias("k"))
    return merge.united_candidates(p, w).select("query_id", "provider", F.col("ordinal").alias("index"), "place")


# ---- filters and layouts (F7 to F10, W2), demo (S21) --------------------------------------------------------------

SELECTORS = {
    "source": Filters(source="openalex-expansion"), "starred": Filters(starred=True), "topic": Filters(topic="topic|topic:demo:transformers"), "tag": Filters(topic="tag|to-read"), "unknown": Filters(topic="other|x"),
    "focus": Filters(focus_topics=("topic:demo:transformers", "topic:provider:machine-learning")), "ignored": Filters(focus_topics=("topic:none",), focus_authors=("nobody",), year_min=2015),
}


def _selectors(s: SparkSession, d: str) -> dict[str, Filters]:
    """The selectors, on the topics and the tag that come first in these tables."""
    p = papers(s, d)
    t = [r.x for r in p.select(F.explode("topics").alias("x")).where("x <> ''").groupBy("x").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x").limit(2).collect()]
    g = [r.x for r in p.select(F.explode("tags").alias("x")).where("x <> ''").groupBy("x").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x").limit(1).collect()]
    return SELECTORS | {"topic": Filters(topic=f"topic|{t[0] if t else ''}"), "tag": Filters(topic=f"tag|{g[0] if g else ''}"), "focus": Filters(focus_topics=tuple(t))}


def selector_filters(s: SparkSession, d: str) -> DataFrame:
    """Papers by way of entry, by star, by topic or tag, by topics in focus, and with the focus ignored."""
    p, t = papers(s, d), topics(s, d)
    parts = [library.view(p, t, f, ignore_focus=k == "ignored").select(F.lit(k).alias("selector"), "id", F.lit(f.active()).alias("n_filters")) for k, f in _selectors(s, d).items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def aggregate_layouts(s: SparkSession, d: str) -> DataFrame:
    """Both aggregate graphs by the layout that their kind asks for."""
    p, e = papers(s, d), edges(s, d)
    a = layout.aggregate_layout("author", "ranked", graph.author_blocks(p), graph.coauthor_links(p))
    t = layout.aggregate_layout("topic", "ranked", graph.topic_blocks(p, topics(s, d)), graph.topic_links(p, e))
    return a.select(F.lit("author").alias("kind"), "id", "column", "row").union(t.select(F.lit("topic"), "id", "column", "row"))


def topic_segments(s: SparkSession, d: str) -> DataFrame:
    """Links between ranked topics, from border to border."""
    p = papers(s, d)
    placed = layout.ranked(graph.topic_blocks(p, topics(s, d)), "n_papers")
    seg = geometry.block_segments(placed, graph.topic_links(p, edges(s, d)))
    return seg.select("source", "target", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def marked_links(s: SparkSession, d: str) -> DataFrame:
    """Topic links that go out from the topic first by name, and co-author links at either end of the author first by id."""
    p = papers(s, d)
    t, a = graph.topic_links(p, edges(s, d)), graph.coauthor_links(p)
    one = lambda df: [r.x for r in df.agg(F.min("source").alias("x")).collect()]
    rows = [t.where(geometry.focused("topic", one(t))).select(F.lit("topic").alias("kind"), "source", "target"), a.where(geometry.focused("author", one(a))).select(F.lit("author"), "source", "target")]
    return rows[0].union(rows[1])


def band_colours(s: SparkSession, d: str) -> DataFrame:
    """The colour of each year of the timeline."""
    return layout.year_buckets(papers(s, d)).select("year", geometry.palette_index(F.col("bucket")).alias("colour"))


def map_segments(s: SparkSession, d: str) -> DataFrame:
    """Citations between papers placed by year and number of citations, from circle to circle."""
    p = graph.citation_map(papers(s, d)).select("id", "radius").join(papers(s, d).select("id", "year", "citationCount"), "id")
    at = p.select("id", F.struct((F.coalesce("year", F.lit(0)) * 10.0).alias("x"), (F.coalesce("citationCount", F.lit(0)) * 1.0).alias("y"), "radius").alias("c"))
    j = edges(s, d).select("id", "source", "target").join(at.select(F.col("id").alias("source"), F.col("c").alias("a")), "source").join(at.select(F.col("id").alias("target"), F.col("c").alias("b")), "target")
    seg = geometry.circle_segment({k: F.col(f"a.{k}") for k in ("x", "y", "radius")}, {k: F.col(f"b.{k}") for k in ("x", "y", "radius")})
    return j.select("id", *[F.round(v, 5).alias(k) for k, v in seg.items()])


def demo_topic_links(s: SparkSession, d: str) -> DataFrame:
    """Links between the topics of the bundled library."""
    p, e, _ = demo.library(s)
    return graph.topic_links(p, e)


def demo_authors(s: SparkSession, d: str) -> DataFrame:
    """Authors of the bundled library with their papers and co-authors."""
    return graph.author_blocks(demo.library(s)[0]).select("id", "n_papers", "coauthors")


QUERIES = {
    f.__name__: f
    for f in (
        put_papers, remapped_edges, deleted_edges, reviewed_metadata, applied_drafts, review_checks, model_answers, model_inputs, reviewed_identities, library_entries, provider_topics, request_log, reference_keys,
        merged_reference_records, kept_selections, selected_candidates, provider_fields, united_candidates, selector_filters, aggregate_layouts, demo_topic_links, demo_authors, topic_segments, marked_links, band_colours, map_segments,
    )
}

_FIRST = "fp AS (SELECT * FROM papers WHERE coalesce(id, '') <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY importedAt ASC NULLS LAST, createdAt DESC NULLS LAST) = 1)"
_CELLS = """rows_ AS (SELECT DISTINCT id, extractedReferences, coalesce(epoch_us(importedAt), 0) AS came FROM papers WHERE id <> ''), cells AS (
  SELECT id AS source_id, came * 1000 + generate_subscripts(extractedReferences, 1) - 1 AS ordinal, unnest(extractedReferences) AS r FROM rows_)"""
_CANONICAL = f"CASE WHEN {_USABLE('r.canonicalReference')} THEN r.canonicalReference WHEN r.resolution.status = 'matched' AND {_USABLE('r.resolution.canonical')} THEN r.resolution.canonical END"
_PROVENANCE = f"""CASE WHEN {doi_sql('r.doi')} <> '' THEN 'doi:' || {doi_sql('r.doi')} WHEN {doi_sql('c.doi')} <> '' THEN 'doi:' || {doi_sql('c.doi')} WHEN {arxiv_sql('r.arxivId')} <> '' THEN 'arxiv:' || {arxiv_sql('r.arxivId')}
  WHEN {arxiv_sql('c.arxivId')} <> '' THEN 'arxiv:' || {arxiv_sql('c.arxivId')} WHEN {squeeze_sql('r.rawText')} <> '' THEN 'raw:' || lower({squeeze_sql('r.rawText')}) WHEN {clean_sql('c.semanticScholarId')} <> '' THEN 's2:' || lower({clean_sql('c.semanticScholarId')})
  WHEN {_TY('c.title', 'c.year')} <> '' THEN 'title:' || {_TY('c.title', 'c.year')} ELSE 'anonymous:' || ordinal END"""
_LAST = lambda f: f"arg_max(r.{f}, ordinal) FILTER (r.{f} IS NOT NULL) AS {f}"
_ARX_REF = r"lower(regexp_replace(regexp_replace({0}, '(?i)^arxiv:\s*', ''), '(?i)v\d+$', ''))"
_PROVIDER_KEY = f"""CASE WHEN {doi_sql('r.doi')} <> '' THEN 'doi:' || {doi_sql('r.doi')} WHEN {_ARX_REF.format(clean_sql('r.arxivId'))} <> '' THEN 'arxiv:' || {_ARX_REF.format(clean_sql('r.arxivId'))} WHEN {clean_sql('r.semanticScholarId')} <> '' THEN 's2:' || lower({clean_sql('r.semanticScholarId')})
  WHEN {clean_sql('r.openAlexId')} <> '' THEN 'openalex:' || lower({clean_sql('r.openAlexId')}) WHEN {title_sql('r.title')} <> '' THEN 'title:' || {title_sql('r.title')} || ':' || {_YT('r.year')} WHEN {squeeze_sql('r.rawText')} <> '' THEN 'raw:' || lower({squeeze_sql('r.rawText')}) ELSE '' END"""
_REVIEW_KEY = rf"CASE WHEN {doi_sql('r.doi')} <> '' THEN 'doi:' || {doi_sql('r.doi')} WHEN {clean_sql('r.arxivId')} <> '' THEN 'arxiv:' || lower(regexp_replace({clean_sql('r.arxivId')}, '(?i)^arxiv:\s*', '')) WHEN {squeeze_sql('r.rawText')} <> '' THEN 'raw:' || lower({squeeze_sql('r.rawText')}) ELSE '' END"
_MERGED = f"mk AS (SELECT *, {_PROVENANCE} AS key FROM (SELECT *, {_CANONICAL} AS c FROM cells))"
_UNIQUE = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: {squeeze_sql('x')}), lambda x: x <> '')"
_N_UNIQUE = lambda c: f"len(list_distinct(list_transform({_UNIQUE(c)}, lambda x: lower(x))))"
_FIRSTS = lambda c: f"(SELECT list(w ORDER BY k) FROM (SELECT arg_min(x, k) AS w, min(k) AS k FROM (SELECT unnest({_UNIQUE(c)}) AS x, generate_subscripts({_UNIQUE(c)}, 1) AS k) GROUP BY lower(x)))"
_WORDS = "coalesce(keywords, []) || coalesce(tags, [])"
_JOINED = f"""{ONCE}, {_WI}, o AS (SELECT doi AS d, arg_min((title, authors, year, venue, doi, cited_by), id) AS o FROM wi WHERE doi <> '' GROUP BY doi), wt AS (SELECT *, {_TY('title', 'year')} AS ty FROM wi), a AS (SELECT ty, arg_max((title, authors, year, venue, doi, cited_by), id) AS a FROM wt WHERE ty <> '' GROUP BY ty),
j AS (SELECT p.*, o.o, a.a FROM p LEFT JOIN o ON o.d = {doi_sql('p.doi')} LEFT JOIN a ON a.ty = {_TY('p.title', 'p.year')} AND a.ty <> ''),
m AS (SELECT id, starred, title AS own_title, venue AS own_venue, coalesce(nullif({clean_sql('o[1]')}, ''), nullif({clean_sql('a[1]')}, ''), nullif({clean_sql('title')}, ''), '') AS title, coalesce(nullif({clean_sql('o[4]')}, ''), nullif({clean_sql('a[4]')}, ''), nullif({clean_sql('venue')}, ''), '') AS venue,
  coalesce(nullif({clean_sql('type')}, ''), 'article') AS type, coalesce(nullif({doi_sql('o[5]')}, ''), nullif({doi_sql('a[5]')}, ''), {doi_sql('doi')}) AS doi, coalesce(CASE WHEN o[3] > 0 THEN o[3] END, CASE WHEN a[3] > 0 THEN a[3] END, CASE WHEN year > 0 THEN year END) AS year,
  coalesce(CASE WHEN o[6] >= 0 THEN o[6] END, CASE WHEN a[6] >= 0 THEN a[6] END, CASE WHEN citationCount >= 0 THEN citationCount END) AS citationCount,
  coalesce(nullif({_N_UNIQUE('o[2]')}, 0), nullif({_N_UNIQUE('a[2]')}, 0), {_N_UNIQUE('authors')}) AS n_authors, {_N_UNIQUE('keywords')} AS n_keywords FROM j)"""
_ARXIV_OK = r"regexp_matches(regexp_replace({0}, '(?i)^arxiv:\s*', ''), '(?i)^(\d{{4}}\.\d{{4,5}}|[a-z-]+(\.[a-z]{{2}})?/\d{{7}})(v\d+)?$')"
_TOP = lambda c, n: f"(SELECT list(x ORDER BY n DESC, x) FROM (SELECT x, count(*) AS n FROM (SELECT unnest({c}) AS x FROM p) WHERE coalesce(x, '') <> '' GROUP BY x ORDER BY n DESC, x LIMIT {n}))"

ORACLE = {
    "put_papers": f"""{ONCE}, {_FIRST}, cells AS (
  SELECT id AS source_id, generate_subscripts(extractedReferences, 1) - 1 AS ordinal, unnest(extractedReferences) AS r FROM fp UNION ALL SELECT id, 1000000 + generate_subscripts(extractedReferences, 1) - 1, unnest(extractedReferences) FROM p), {_MERGED},
n AS (SELECT source_id AS id, count(DISTINCT key) AS n FROM mk GROUP BY 1) SELECT p.id, p.title, coalesce(n, 0) AS n_references FROM p LEFT JOIN n USING (id)""",
    "remapped_edges": f"""{ONCE}, k AS (SELECT id, CASE WHEN {doi_sql('doi')} <> '' THEN 'doi:' || {doi_sql('doi')} WHEN coalesce(semanticScholarId, '') <> '' THEN 's2:' || semanticScholarId WHEN coalesce(arxivId, '') <> '' THEN 'arxiv:' || lower(arxivId) ELSE 'title:' || {title_sql('title')} || ':' || {_YT('year')} END AS k FROM p),
m AS (SELECT id AS old, min(id) OVER (PARTITION BY k) AS new FROM k), j AS (SELECT kind, relation, coalesce(a.new, source) AS source, coalesce(b.new, target) AS target FROM e LEFT JOIN m a ON a.old = source LEFT JOIN m b ON b.old = target),
x AS (SELECT DISTINCT CASE WHEN kind = 'research-relation' AND relation IN ('builds_on', 'improves_on', 'extends', 'outperforms', 'invalidates', 'contradicts', 'supports', 'replicates') THEN 'relation:' || relation || ':' || source || '->' || target ELSE source || '->' || target END AS id, source, target FROM j WHERE source <> '' AND target <> '' AND source <> target)
SELECT * FROM x WHERE id NOT IN (SELECT id FROM e)""",
    "deleted_edges": f"{ONCE} SELECT id FROM e WHERE NOT coalesce(kind = 'research-relation' AND relation IN ('builds_on', 'improves_on', 'extends', 'outperforms', 'invalidates', 'contradicts', 'supports', 'replicates'), false)",
    "reviewed_metadata": f"{_JOINED} SELECT id, title, venue, type, doi, year, citationCount, n_authors, n_keywords FROM m",
    "applied_drafts": f"{_JOINED} SELECT id, CASE WHEN starred THEN own_title ELSE title END AS title, CASE WHEN starred THEN own_venue ELSE venue END AS venue, doi FROM m",
    "review_checks": rf"""{ONCE}, k AS (SELECT id, coalesce(year > 0, false) AS year_ok, regexp_matches({doi_sql('doi')}, '(?i)^10\.\d{{4,9}}/\S+$') AS doi_ok, {_ARXIV_OK.format(clean_sql('arxivId'))} AS arxiv_ok, {doi_sql('doi')} AS d, regexp_replace({clean_sql('arxivId')}, '(?i)^arxiv:\s*', '') AS a,
  {squeeze_sql('title')} AS t, CASE WHEN {clean_sql('doi')} <> '' THEN 'doi' WHEN {clean_sql('arxivId')} <> '' THEN 'arxiv' ELSE 'title' END AS kind FROM p)
SELECT id, year_ok, doi_ok, arxiv_ok, CASE WHEN kind = 'doi' AND doi_ok THEN d WHEN kind = 'arxiv' AND arxiv_ok THEN a WHEN kind = 'title' AND t <> '' THEN t END AS query,
  CASE WHEN kind = 'doi' AND NOT doi_ok THEN 'doi' WHEN kind = 'arxiv' AND NOT arxiv_ok THEN 'arxiv' WHEN kind = 'title' AND t = '' THEN 'title' END AS error FROM k""",
    "model_answers": f"""{ONCE}, k AS (SELECT id, {squeeze_sql('title')} AS title, least(50, {_N_UNIQUE('authors')}) AS n_authors, CASE WHEN year > 0 THEN year END AS year, array_to_string({_FIRSTS(_WORDS)}[1:20], '|') AS keywords, {_UNIQUE('keywords')}[1:12] AS t, relevance / 4 AS c FROM p)
SELECT id, title, n_authors, year, coalesce(keywords, '') AS keywords, array_to_string(t, '|') AS topics, CAST(len(t) * greatest(0.0, least(1.0, coalesce(c, 0))) AS DOUBLE) AS sum_confidence, CAST(greatest(0.0, least(1.0, coalesce(c - 0.5, 0))) AS DOUBLE) AS confidence FROM k""",
    "model_inputs": r"""SELECT doc_id, md5(CASE WHEN length(text) <= 120000 THEN text ELSE text[1:100000] || chr(10) || chr(10) || '[... document truncated ...]' || chr(10) || chr(10) || right(text, 20000) END) AS whole,
  CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 300) || chr(10) || chr(10) || '[... document truncated ...]' || chr(10) || chr(10) || right(text, 100) END AS short FROM documents WHERE text IS NOT NULL""",
    "reviewed_identities": rf"""{ONCE} SELECT id, CASE WHEN {doi_sql('doi')} <> '' THEN 'doi:' || {doi_sql('doi')} WHEN {clean_sql('semanticScholarId')} <> '' THEN 's2:' || {clean_sql('semanticScholarId')} WHEN regexp_replace({clean_sql('arxivId')}, '(?i)^arxiv:\s*', '') <> '' THEN 'arxiv:' || regexp_replace({clean_sql('arxivId')}, '(?i)^arxiv:\s*', '') ELSE id END AS identity,
  CASE WHEN status = 'key' THEN 'read' ELSE status END AS status, coalesce(array_to_string({_FIRSTS(_WORDS)}, '|'), '') AS words FROM p""",
    "library_entries": f"""{ONCE} SELECT id, CASE WHEN libraryEntry IS NOT NULL THEN libraryEntry.method ELSE coalesce(nullif(source, ''), 'unknown') END AS method, CASE WHEN libraryEntry IS NOT NULL THEN libraryEntry.fileName ELSE coalesce(sourceFileName, '') END AS file, CASE WHEN libraryEntry IS NOT NULL THEN libraryEntry.parentPaperId ELSE '' END AS parent FROM p""",
    "provider_topics": f"""{ONCE}, k AS (SELECT unnest(keywords) AS name, coalesce(nullif(providerPrimary, ''), nullif(source, ''), 'provider') AS source FROM p), x AS (SELECT 'topic:provider:' || {slug_sql('name', 70)} AS id, name, source FROM k)
SELECT id, max(name) AS name, max(source) AS source FROM x WHERE NOT ends_with(id, ':') GROUP BY id""",
    "request_log": ONCE + r""", x AS (SELECT unnest([doi, openAlexId, arxivId, url, pdfUrl, semanticScholarId]) AS url FROM p), u AS (SELECT DISTINCT url FROM x WHERE regexp_matches(url, '^https?://')), h AS (SELECT url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT url, CASE WHEN ends_with(lower(host), 'semanticscholar.org') THEN 'Semantic Scholar' WHEN ends_with(lower(host), 'openalex.org') THEN 'OpenAlex' WHEN ends_with(lower(host), 'crossref.org') THEN 'Crossref' WHEN ends_with(lower(host), 'arxiv.org') THEN 'arXiv' WHEN host <> '' THEN lower(host) ELSE 'Local' END AS service, host || path AS target FROM h""",
    "reference_keys": f"""{_REFS} SELECT source_id, ordinal, {_PROVIDER_KEY} AS key, concat_ws(' · ', CASE WHEN {clean_sql('r.label')} <> '' THEN '[' || {clean_sql('r.label')} || ']' END,
  CASE WHEN r.pageStart IS NULL THEN NULL WHEN r.pageEnd IS NULL OR r.pageEnd = r.pageStart THEN 'p. ' || r.pageStart ELSE 'pp. ' || r.pageStart || '–' || r.pageEnd END, CASE WHEN r.year > 0 THEN CAST(r.year AS VARCHAR) END,
  CASE WHEN {doi_sql('r.doi')} <> '' THEN 'DOI ' || {doi_sql('r.doi')} END, CASE WHEN r.confidence IS NOT NULL THEN CAST(CAST(floor(r.confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END) AS meta FROM refs""",
    "merged_reference_records": f"""WITH {_CELLS}, k AS (SELECT *, CASE WHEN {_PROVIDER_KEY} <> '' THEN {_PROVIDER_KEY} ELSE 'anonymous:' || ordinal END AS key FROM cells)
SELECT source_id, key, min(ordinal) AS ordinal, {_LAST('title')}, {_LAST('year')}, {_LAST('reviewed')}, bool_or(r.resolution IS NOT NULL) AS resolved FROM k GROUP BY source_id, key""",
    "merged_references": f"""WITH {_CELLS}, {_MERGED}
SELECT source_id, key, CASE WHEN bool_or(r.reviewed) THEN true WHEN count(r.reviewed) = count(*) THEN false ELSE arg_max(r.reviewed, ordinal) FILTER (r.reviewed IS NOT NULL) END AS reviewed, {_LAST('title')}, {_LAST('year')}, bool_or(r.resolution IS NOT NULL) AS resolved FROM mk GROUP BY source_id, key""",
    "kept_selections": f"""{_REFS}, {_CELLS}, o AS (SELECT source_id, {_REVIEW_KEY} AS key, arg_max(r.reviewed, ordinal) FILTER (r.reviewed IS NOT NULL) AS use FROM cells GROUP BY ALL), n AS (SELECT source_id, ordinal, {_REVIEW_KEY} AS key FROM refs)
SELECT source_id, ordinal, use FROM n LEFT JOIN o USING (source_id, key)""",
    "selected_candidates": f"""{_REFS}, c AS (SELECT source_id, ordinal, r.resolution.candidates[1] AS c FROM refs WHERE r.resolution IS NOT NULL)
SELECT source_id, ordinal, 'matched' AS status, c.provider, c.matchedBy, c.confidence, 'user' AS selectedBy, c.canonical.doi AS doi FROM c WHERE c.canonical IS NOT NULL""",
    "provider_fields": rf"""WITH w AS (SELECT DISTINCT ON (record_id) * FROM provider_works) SELECT record_id, CASE WHEN year > 0 THEN year END AS year, {squeeze_sql('title')} AS abstract, 'W' || regexp_extract(record_id, '(\d+)$', 1) AS work,
  CASE WHEN regexp_matches(coalesce(doi, ''), '(?i)arxiv\.org/(abs|pdf)/[^\s?#]+$') THEN regexp_extract(doi, '(?i)arxiv\.org/(?:abs|pdf)/([^\s?#]+?)(?:\.pdf)?$', 1) ELSE record_id END AS arxiv,
  array_to_string([provider] || list_filter(list_filter(coalesce(authors, []), lambda a: length(a) / 30 >= 0.45)[1:6], lambda a: a <> provider), '|') AS topics,
  CASE WHEN {doi_sql('doi')} <> '' THEN CAST(0.98 AS DOUBLE) WHEN {clean_sql('title')} <> '' THEN 0.86 WHEN {clean_sql('venue')} <> '' THEN 0.65 END AS confidence FROM w""",
    "united_candidates": f"""{ONCE}, {_WI}, w2 AS (SELECT provider, ordinal, {title_sql('title')} AS k FROM wi), w3 AS (SELECT *, row_number() OVER (PARTITION BY provider, k ORDER BY ordinal) AS place FROM w2 WHERE k <> '')
SELECT p.id AS query_id, provider, ordinal AS index, place FROM p JOIN w3 ON w3.k = {title_sql('p.title')} WHERE place <= 8""",
    "selector_filters": f"""{ONCE}, t2 AS (SELECT {_TOP('topics', 2)} AS t, {_TOP('tags', 1)} AS g)
SELECT 'source' AS selector, id, 1 AS n_filters FROM p WHERE {_ENTRY} = 'openalex-expansion' UNION ALL SELECT 'starred', id, 1 FROM p WHERE starred UNION ALL SELECT 'topic', id, 1 FROM p, t2 WHERE list_contains(coalesce(topics, []), t[1])
UNION ALL SELECT 'tag', id, 1 FROM p, t2 WHERE list_contains(coalesce(tags, []), g[1]) UNION ALL SELECT 'unknown', id, 1 FROM p UNION ALL SELECT 'focus', id, 1 FROM p, t2 WHERE list_has_any(coalesce(topics, []), t) UNION ALL SELECT 'ignored', id, 3 FROM p WHERE year >= 2015""",
    "aggregate_layouts": f"""{_AUTHORS}, pt AS (SELECT id AS paper_id, unnest(topics) AS topic, coalesce(starred, false) AS starred FROM p), tb AS (SELECT b.id, coalesce(nullif(t.name, ''), b.id) AS name, n_papers FROM (SELECT topic AS id, count(*) AS n_papers FROM pt WHERE coalesce(topic, '') <> '' GROUP BY topic) b LEFT JOIN t ON b.id = t.id)
SELECT 'author' AS kind, id, "column", "row" FROM ({_ranked('abc', 'coauthors')}) UNION ALL SELECT 'topic', id, "column", "row" FROM ({_ranked('tb', 'n_papers')})""",
    "topic_segments": f"""{_TOPICS}, r AS ({_ranked('tb', 'n_papers')}), l AS (SELECT DISTINCT a.topic AS source, b.topic AS target FROM e JOIN pt2 a ON e.source = a.paper_id JOIN pt2 b ON e.target = b.paper_id WHERE a.topic <> b.topic),
m AS (SELECT id, x + width / 2.0 AS cx, y + height / 2.0 AS cy, width, height FROM r), j AS (SELECT source, target, s.cx AS sx, s.cy AS sy, t.cx AS tx, t.cy AS ty, s.width AS sw, s.height AS sh, t.width AS tw, t.height AS th FROM l JOIN m s ON s.id = source JOIN m t ON t.id = target),
k AS (SELECT *, 1 / greatest(abs(tx - sx) / greatest(1.0, sw / 2.0), abs(ty - sy) / greatest(1.0, sh / 2.0), 0.001) AS ks, 1 / greatest(abs(tx - sx) / greatest(1.0, tw / 2.0 + 5), abs(ty - sy) / greatest(1.0, th / 2.0 + 5), 0.001) AS kt FROM j)
SELECT source, target, CAST(round(sx + (tx - sx) * ks, 6) AS DOUBLE) AS x1, CAST(round(sy + (ty - sy) * ks, 6) AS DOUBLE) AS y1, CAST(round(tx + (sx - tx) * kt, 6) AS DOUBLE) AS x2, CAST(round(ty + (sy - ty) * kt, 6) AS DOUBLE) AS y2 FROM k""",
    "marked_links": f"""{_AUTHORS}, pt AS (SELECT id AS paper_id, unnest(topics) AS topic FROM p), l AS (SELECT DISTINCT a.topic AS source, b.topic AS target FROM e JOIN pt a ON e.source = a.paper_id JOIN pt b ON e.target = b.paper_id WHERE a.topic <> b.topic AND a.topic <> '' AND b.topic <> '')
SELECT 'topic' AS kind, source, target FROM l WHERE source = (SELECT min(source) FROM l) UNION ALL SELECT 'author', source, target FROM co WHERE source = (SELECT min(source) FROM co) OR target = (SELECT min(source) FROM co)""",
    "band_colours": f"{ONCE} SELECT year, CAST((row_number() OVER (ORDER BY year) - 1) % 12 AS INTEGER) AS colour FROM (SELECT DISTINCT year FROM p WHERE year IS NOT NULL)",
    "map_segments": f"""{ONCE}, c AS (SELECT id, coalesce(year, 0) * 10.0::DOUBLE AS x, coalesce(citationCount, 0)::DOUBLE AS y, CASE WHEN citationCount > 0 THEN greatest(8, least(15, 8 + log10(citationCount + 1) * 1.75)) ELSE 8 END AS r FROM p),
j AS (SELECT e.id, a.x AS ax, a.y AS ay, a.r AS ar, b.x AS bx, b.y AS by_, b.r AS br, greatest(0.001, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) AS d FROM e JOIN c a ON a.id = source JOIN c b ON b.id = target)
SELECT id, round(ax + (bx - ax) / d * ar, 5) AS x1, round(ay + (by_ - ay) / d * ar, 5) AS y1, round(bx - (bx - ax) / d * (br + 6), 5) AS x2, round(by_ - (by_ - ay) / d * (br + 6), 5) AS y2 FROM j""",
    "demo_topic_links": f"""WITH pt AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{t}')" for i, *_, ts in demo.PAPERS for t in ts)}) v(p, t)), e AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in demo.EDGES)}) v(a, b))
SELECT x.t AS source, y.t AS target, count(*) AS weight FROM e JOIN pt x ON x.p = a JOIN pt y ON y.p = b WHERE x.t <> y.t GROUP BY ALL""",
    "demo_authors": f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{a}')" for i, _, _, _, names, _ in demo.PAPERS for a in names)}) v(p, a)), k AS (SELECT p, 'author:' || trim(regexp_replace(lower(strip_accents(replace(replace(a, 'Ł', 'Ł'), 'ł', 'ł'))), '[^a-z0-9]+', ' ', 'g')) AS id FROM r),
c AS (SELECT x.id, count(DISTINCT y.id) AS n FROM k x JOIN k y ON x.p = y.p AND x.id <> y.id GROUP BY x.id) SELECT id, count(DISTINCT p) AS n_papers, coalesce(any_value(n), 0) AS coauthors FROM k LEFT JOIN c USING (id) GROUP BY id""",
}
