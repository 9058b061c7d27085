"""The library: one row per key, conjunctive filters, facets, the induced subgraph, and summaries over it."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioplan.functions import normalize as N


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the last by ``order`` (nulls first); rows without a key are dropped.

    ``max_by`` aggregates partially, so a key with any number of copies costs no sort and no large task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def papers_once(papers: DataFrame) -> DataFrame:
    return latest(papers, "id", F.col("importedAt"), F.col("createdAt"))


def edges_once(edges: DataFrame) -> DataFrame:
    """One row per edge id; a blank end is read from the id."""
    bare = F.regexp_replace("id", r"^relation:[^:]*:", "")
    ends = {
        f: F.when(N.clean(F.col(f)) != "", F.col(f)).otherwise(F.when(bare.contains("->"), F.regexp_extract(bare, p, 1)))
        for f, p in (("source", r"(?s)^(.*?)->"), ("target", r"(?s)^.*?->(.*)$"))
    }
    return latest(edges.withColumns(ends), "id", F.col("createdAt"), F.col("kind"), F.col("provenance"))


def topics_once(topics: DataFrame) -> DataFrame:
    return latest(topics, "id", F.col("createdAt"), F.col("name"))


# ---- filters (F1-F13) ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Filters:
    """Conjunctive filters of a library view; blank and empty ones do not apply."""

    query: str = ""
    year_min: int | None = None
    year_max: int | None = None
    author: str = ""
    focus_authors: tuple[str, ...] = ()
    venue: str = ""
    type: str = ""
    source: str = ""
    starred: bool = False
    topic: str = ""  # "topic|<id>" or "tag|<tag>"
    focus_topics: tuple[str, ...] = field(default=())

    def active(self) -> int:
        """How many filters are set besides the query; a list counts once."""
        return sum(bool(getattr(self, f.name)) for f in fields(self) if f.name != "query")


def _words(c: str) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), N.text)


def plain(value: str) -> str:
    return value.strip().lower()


def haystack(topic_names: Column) -> Column:
    """Everything the free-text filter looks at, lower case; nulls leave their separator."""
    parts = F.concat(
        F.array(N.text(F.col("title"))), _words("authors"), F.array(N.text(F.col("abstract"))), F.array(N.text(F.col("venue"))), F.array(N.text(F.col("type"))), _words("tags"), _words("keywords"), topic_names
    )
    return F.lower(F.array_join(parts, " "))


def named_topics(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """Adds ``topicNames``: the topics' names in order, or their ids without namespace where the topic is missing."""
    dim = topics_once(topics).select(F.col("id").alias("_topic"), "name")
    cells = papers.select("id", F.posexplode_outer("topics").alias("_k", "_topic"))
    bare = F.regexp_replace("_topic", "^topic:[^:]+:", "")
    names = cells.join(dim, "_topic", "left").groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_topic").isNotNull(), F.struct("_k", F.coalesce(F.when(F.col("name") != "", F.col("name")), bare).alias("n"))))).alias("_n")
    )
    return papers.join(names, "id").withColumn("topicNames", F.transform("_n", lambda x: x["n"])).drop("_n")


def matches(f: Filters, ignore_focus: bool = False, legacy_null_year: bool = False) -> Column:
    """The filters as one predicate over papers with ``topicNames``.

    An unknown year fails either bound; ``legacy_null_year`` reads it as 0, which passes an upper bound.
    """
    year = F.coalesce("year", F.lit(0)) if legacy_null_year else F.col("year")
    test = F.lit(True)
    if plain(f.query):
        test &= haystack(F.col("topicNames")).contains(plain(f.query))
    if f.year_min:
        test &= year >= f.year_min
    if f.year_max:
        test &= year <= f.year_max
    if f.author:
        test &= F.exists(_words("authors"), lambda a: F.lower(N.clean(a)).contains(plain(f.author)))
    if f.focus_authors and not ignore_focus:
        test &= F.arrays_overlap(F.transform(_words("authors"), lambda a: F.lower(N.clean(a))), F.array(*[F.lit(plain(a)) for a in f.focus_authors]))
    if f.venue:
        test &= F.lower(N.clean(F.col("venue"))).contains(plain(f.venue))
    if f.type:
        test &= F.col("type") == f.type
    if f.source:
        test &= N.entry_source(F.col("libraryEntry.method"), F.col("source")) == f.source
    if f.starred:
        test &= F.col("starred")
    if f.topic:
        kind, _, value = f.topic.partition("|")
        value = value.split("|")[0]
        if kind in ("topic", "tag"):
            test &= F.array_contains(F.coalesce({"topic": "topics", "tag": "tags"}[kind], F.array().cast("array<string>")), value)
    if f.focus_topics and not ignore_focus:
        test &= F.arrays_overlap(F.coalesce("topics", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in f.focus_topics]))
    return F.coalesce(test, F.lit(False))


def view(papers: DataFrame, topics: DataFrame, f: Filters, ignore_focus: bool = False, legacy_null_year: bool = False) -> DataFrame:
    """Visible papers.  Topic names are joined only if the free-text filter needs them."""
    rows = named_topics(papers, topics) if plain(f.query) else papers.withColumn("topicNames", F.array().cast("array<string>"))
    return rows.where(matches(f, ignore_focus, legacy_null_year)).drop("topicNames")


def induced_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges whose both ends are visible."""
    ids = visible.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def neighbours(edges: DataFrame, paper_id: str) -> DataFrame:
    """Papers one edge away, in either direction."""
    out = edges.where(F.col("source") == paper_id).select(F.col("target").alias("id"))
    return out.union(edges.where(F.col("target") == paper_id).select("source")).where(F.col("id") != paper_id).distinct()


# ---- facets, lists, statistics (F12, O1, O2, K7, A6) --------------------------------------------------------------


def facets(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """facet, value, label, n: types, sources, tags and topics with their numbers of papers."""
    present = papers.select("id", "type", "tags", "topics", N.entry_source(F.col("libraryEntry.method"), F.col("source")).alias("s"))
    pairs = F.array_distinct(
        F.filter(
            F.concat(
                F.array(F.struct(F.lit("type").alias("facet"), F.col("type").alias("value")), F.struct(F.lit("source").alias("facet"), F.col("s").alias("value"))),
                F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))),
                F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.struct(F.lit("topic").alias("facet"), t.alias("value"))),
            ),
            lambda x: N.text(x["value"]) != "",
        )
    )
    counted = present.select("id", F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
    dim = topics_once(topics).select(F.lit("topic").alias("facet"), F.col("id").alias("value"), "name")
    label = F.when(F.col("facet") == "source", N.source_label(F.col("value"))).when(F.col("facet") == "topic", F.coalesce("name", F.regexp_replace("value", "^topic:[^:]+:", ""))).otherwise(F.col("value"))
    return counted.join(dim, ["facet", "value"], "left").select("facet", "value", label.alias("label"), "n")


def paper_list(papers: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest year first, then title as people sort it (O1); with a limit, the top of that list."""
    order = [F.coalesce("year", F.lit(0)).desc(), F.collate(N.text(F.col("title")), "UNICODE"), F.col("id")]
    ordered = papers.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def stats(papers: DataFrame, edges: DataFrame, topics: DataFrame) -> DataFrame:
    """store, n: rows of each store (K7)."""
    one = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("store"), "n")
    return one(papers, "papers").union(one(edges, "edges")).union(one(topics, "topics"))


def citation_summary(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """Per paper: extracted references, citations out and in, research relations, and the provider's count."""
    research = N.is_research_relation(F.col("kind"), F.col("relation"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o")))).alias("e"), research.alias("r"))
    degree = ends.groupBy("e.id").agg(
        F.count_if(~F.col("r") & (F.col("e.o") == 1)).alias("references_out"), F.count_if(~F.col("r") & (F.col("e.o") == 0)).alias("citations_in"), F.count_if("r").alias("research_links")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("references_out", "citations_in", "research_links")]
    size = F.coalesce(F.size("extractedReferences"), F.lit(0)).cast("bigint")
    return papers.select("id", F.when(size > 0, size).otherwise(0).alias("extracted_references"), F.col("citationCount").alias("provider_citations")).join(degree, "id", "left").select("id", "extracted_references", *zero, "provider_citations")


def relations_of(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """paper_id, direction, relation, label, other_id, other_title: research relations, both ways; dangling ends skipped."""
    r = edges.where(N.is_research_relation(F.col("kind"), F.col("relation"))).select("source", "target", "relation")
    title = papers.select("id", "title")
    both = r.join(title.select(F.col("id").alias("source"), F.col("title").alias("source_title")), "source").join(title.select(F.col("id").alias("target"), F.col("title").alias("target_title")), "target")
    ways = F.array(
        F.struct(F.col("source").alias("paper_id"), F.lit("out").alias("direction"), N.relation_label(F.col("relation")).alias("label"), F.col("target").alias("other_id"), F.col("target_title").alias("other_title")),
        F.struct(F.col("target").alias("paper_id"), F.lit("in").alias("direction"), N.relation_label(F.col("relation"), True).alias("label"), F.col("source").alias("other_id"), F.col("source_title").alias("other_title")),
    )
    return both.select("relation", F.explode(ways).alias("w")).select("w.paper_id", "w.direction", "relation", "w.label", "w.other_id", "w.other_title")


def expansions(papers: DataFrame) -> DataFrame:
    """id, direction, children: papers that an expansion of another one brought."""
    entry = papers.where(F.col("libraryEntry.method").endswith("-expansion") & (N.text(F.col("libraryEntry.parentPaperId")) != ""))
    children = entry.groupBy(F.col("libraryEntry.parentPaperId").alias("id"), F.col("libraryEntry.detail").alias("direction")).agg(F.count("*").alias("children"))
    return children.join(papers.select("id", F.col("title").alias("parent_title")), "id", "left")


def page_of(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Offset paging: rows and the cursor of the next page, NULL on the last.

    Only the rows up to the page and one beyond are kept by each task and ordered in one place.
    """
    ranked = df.orderBy(*order).limit(offset + size + 1).withColumn("_k", F.row_number().over(Window.orderBy(*order)))
    nxt = F.when(F.max("_k").over(Window.partitionBy()) > offset + size, F.lit(offset + size))
    return ranked.withColumn("next", nxt).where((F.col("_k") > offset) & (F.col("_k") <= offset + size)).drop("_k")
