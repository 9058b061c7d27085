"""Aggregate graphs over a library view: topics, co-authors, citations between authors.

Every self-join below is within one paper (its authors, its topics); no group of papers is ever joined with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioplan.functions import normalize as N
from folioplan.operators.library import topics_once


def paper_topics(papers: DataFrame) -> DataFrame:
    """paper_id, topic, starred: one row per topic of a paper; a topic listed twice counts twice."""
    return papers.select(F.col("id").alias("paper_id"), F.explode("topics").alias("topic"), F.coalesce("starred", F.lit(False)).alias("starred")).where("topic IS NOT NULL AND topic <> ''")


def topic_blocks(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """id, name, source, n_papers, starred (A1); a topic without a row keeps its raw id and the source "derived"."""
    blocks = paper_topics(papers).groupBy(F.col("topic").alias("id")).agg(F.count("*").alias("n_papers"), F.count_if("starred").alias("starred"))
    dim = topics_once(topics).select("id", "name", "source")
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("id"))
    return blocks.join(dim, "id", "left").select("id", name.alias("name"), F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("derived")).alias("source"), "n_papers", "starred")


def topic_links(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, weight: edges of any kind between papers of two different topics, directed."""
    t = paper_topics(papers).groupBy("paper_id", "topic").agg(F.count("*").alias("k"))
    # Edges between two papers count together first, so that a hot paper's edges shuffle once per neighbour.
    e = edges.groupBy("source", "target").agg(F.count("*").alias("n"))
    a = t.select(F.col("paper_id").alias("source"), F.col("topic").alias("s"), F.col("k").alias("ks"))
    b = t.select(F.col("paper_id").alias("target"), F.col("topic").alias("t"), F.col("k").alias("kt"))
    j = e.join(a, "source").join(b, "target").where("s <> t")
    return j.groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.sum(F.col("n") * F.col("ks") * F.col("kt")).alias("weight"))


def paper_authors(papers: DataFrame) -> DataFrame:
    """paper_id, author, name, ordinal, starred: distinct authors of each paper by folded name."""
    cells = papers.select(F.col("id").alias("paper_id"), F.coalesce("starred", F.lit(False)).alias("starred"), F.posexplode("authors").alias("ordinal", "raw"))
    named = cells.withColumn("name", N.squeeze(F.col("raw"))).withColumn("key", N.author_key(F.col("name"))).where("name <> '' AND key <> ''")
    first = named.groupBy("paper_id", "key", "starred").agg(F.min(F.struct("ordinal", "name")).alias("f"))
    return first.select("paper_id", F.concat(F.lit("author:"), "key").alias("author"), F.col("f.name").alias("name"), F.col("f.ordinal").alias("ordinal"), "starred")


def author_blocks(papers: DataFrame) -> DataFrame:
    """id, name, n_papers, starred, coauthors (A3); the name is the spelling of the smallest (paper, place)."""
    a = paper_authors(papers)
    blocks = a.groupBy(F.col("author").alias("id")).agg(F.min_by("name", F.struct("paper_id", "ordinal")).alias("name"), F.count("*").alias("n_papers"), F.count_if("starred").alias("starred"))
    pairs = coauthor_links(papers)
    degree = pairs.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("coauthors"))
    return blocks.join(degree, "id", "left").select("id", "name", "n_papers", "starred", F.coalesce("coauthors", F.lit(0)).alias("coauthors"))


def coauthor_links(papers: DataFrame) -> DataFrame:
    """source < target, weight: papers two authors share."""
    per_paper = paper_authors(papers).groupBy("paper_id").agg(F.array_sort(F.collect_set("author")).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform(F.slice(F.col("a"), i + 2, F.size("a")), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    return per_paper.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("weight"))


def author_citation_links(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, weight, citing papers (with repetitions): citations between authors; self-citations dropped."""
    a = paper_authors(papers).select("paper_id", "author")
    cites = edges.where(~N.is_research_relation(F.col("kind"), F.col("relation"))).groupBy("source", "target").agg(F.count("*").alias("n"))
    left = a.select(F.col("paper_id").alias("source"), F.col("author").alias("s"))
    right = a.select(F.col("paper_id").alias("target"), F.col("author").alias("t"))
    j = cites.join(left, "source").join(right, "target").where("s <> t")
    return j.groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.sum("n").alias("weight"), F.count_distinct(j["source"]).alias("citing_papers"))


def citation_map(papers: DataFrame) -> DataFrame:
    """id, label, radius, kind of each node of the citation map (G1)."""
    source = N.entry_source(F.col("libraryEntry.method"), F.col("source"))
    return papers.select("id", N.short_text(F.col("title"), 34, "Untitled").alias("label"), N.citation_radius(F.col("citationCount")).alias("radius"), N.node_kind(F.coalesce("starred", F.lit(False)), source).alias("kind"))
