"""Resolving printed references against candidates: scores, ranks, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioplan.compat import cut
from folioplan.functions import normalize as N

MATCH, MARGIN, FLOOR, CANDIDATES = 0.9, 0.1, 0.72, 5


def score(raw_tokens: Column, title_tokens: Column, surnames: Column, ref_year: Column, paper_year: Column) -> Column:
    """Coverage of the title's words, a surname, and the year, with the gates that make a score 0 (V8)."""
    raw, title = F.array_distinct(raw_tokens), F.array_distinct(title_tokens)
    n = F.size(title)
    coverage = F.size(F.array_intersect(title, raw)) / F.when(n > 0, n)
    known = F.size(surnames) > 0
    author = F.coalesce(F.arrays_overlap(surnames, raw), F.lit(False)) & known
    least = F.when(n <= 2, 1.0).otherwise(0.7)
    value = coverage * 0.7 + F.when(author, 1.0).when(known, 0.0).otherwise(0.5) * 0.2 + F.when(ref_year.isNotNull(), 1.0).otherwise(0.5) * 0.1
    zero = (F.size(raw) == 0) | (n == 0) | (ref_year.isNotNull() & ~F.coalesce(paper_year == ref_year, F.lit(False))) | (coverage < least) | (known & ~author & (coverage < 0.92))
    return F.when(F.coalesce(zero, F.lit(True)), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4))


def surnames(authors: Column) -> Column:
    last = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.coalesce(F.try_element_at(N.plain_tokens(a), F.lit(-1)), F.lit("")))
    return F.filter(last, lambda x: F.length(x) >= 3)


def scored(references: DataFrame, papers: DataFrame) -> DataFrame:
    """rid, paper_id, confidence of every pair that scores above 0.

    references: rid, rawText, year.  A pair covers at least 0.7 of the title's words, so it shares one of the title's
    rarest words, as many as may be missing and one more: an equi-join on those (and the year, where the reference has
    one) finds every pair, and common words are never joined on.
    """
    r = references.select("rid", F.array_distinct(N.meaningful_tokens(F.col("rawText"))).alias("raw"), N.normalized_year(F.col("year")).alias("ref_year")).where("size(raw) > 0")
    r = cut(r)
    p = papers.select(F.col("id").alias("paper_id"), F.array_distinct(N.meaningful_tokens(F.col("title"))).alias("title"), surnames(F.col("authors")).alias("names"), N.normalized_year(F.col("year")).alias("paper_year")).where("size(title) > 0")
    p = cut(p)
    df = p.select(F.explode("title").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    cells = p.select("paper_id", "paper_year", F.size("title").alias("n"), F.explode("title").alias("token")).join(df, "token")
    rare = F.row_number().over(Window.partitionBy("paper_id").orderBy("df", "token"))
    need = F.when(F.col("n") <= 2, 1).otherwise(F.col("n") - F.ceil(F.col("n") * 0.7 - 1e-9) + 1)
    seeds = cells.withColumn("k", rare).where(F.col("k") <= need)
    keyed = seeds.select("paper_id", "token", F.explode(F.array_compact(F.array(F.lit(0), F.col("paper_year")))).alias("y"))
    asked = r.select("rid", F.explode("raw").alias("token"), F.coalesce("ref_year", F.lit(0)).alias("y"))
    pairs = asked.join(keyed, ["token", "y"]).select("rid", "paper_id").distinct()
    full = pairs.join(r, "rid").join(p, "paper_id")
    return full.select("rid", "paper_id", score(F.col("raw"), F.col("title"), F.col("names"), F.col("ref_year"), F.col("paper_year")).alias("confidence")).where("confidence > 0")


def decisions(references: DataFrame, pairs: DataFrame) -> DataFrame:
    """rid, status, paper_id, confidence, n_candidates: matched, candidates, unresolved, or no text to go by."""
    order = Window.partitionBy("rid").orderBy(F.desc("confidence"), "paper_id")
    ranked = pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= CANDIDATES).where(F.col("confidence") >= FLOOR)
    ranked = ranked.withColumn("next", F.lead("confidence").over(order)).withColumn("n", F.count("*").over(Window.partitionBy("rid")))
    top = ranked.where("k = 1")
    sure = (F.col("confidence") >= MATCH) & (F.col("next").isNull() | (F.round(F.col("confidence") - F.col("next"), 6) >= MARGIN))
    verdict = top.select("rid", F.when(sure, "matched").otherwise("candidates").alias("status"), F.when(sure, F.col("paper_id")).alias("paper_id"), "confidence", F.col("n").alias("n_candidates"))
    empty = N.reference_search_query(F.col("rawText")) == ""
    j = references.select("rid", empty.alias("empty")).join(verdict, "rid", "left")
    status = F.when(F.col("empty"), "no-identifier").otherwise(F.coalesce("status", F.lit("unresolved")))
    return j.select("rid", status.alias("status"), "paper_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def by_identifier(references: DataFrame, crossref: DataFrame, semantic: DataFrame) -> DataFrame:
    """rid, provider, matched_by, confidence, key: the first service that knows the identifier.

    references: rid, doi, arxivId; crossref: doi; semantic: doi, arxivId.  A DOI asks Crossref, then Semantic Scholar;
    an arXiv id is asked for only without a DOI, and the same version counts more than the same paper.
    """
    r = references.select("rid", N.normalize_doi(F.col("doi")).alias("doi"), N.arxiv_versioned(F.col("arxivId")).alias("arxiv"), F.lower(N.arxiv_base(F.col("arxivId"))).alias("base"))
    c = crossref.select(N.normalize_doi(F.col("doi")).alias("doi")).where("doi <> ''").distinct().withColumn("c", F.lit(True))
    s = semantic.select(N.normalize_doi(F.col("doi")).alias("doi")).where("doi <> ''").distinct().withColumn("s", F.lit(True))
    a = semantic.select(F.lower(N.arxiv_base(F.col("arxivId"))).alias("base"), N.arxiv_versioned(F.col("arxivId")).alias("have")).where("base <> ''").groupBy("base").agg(F.collect_set("have").alias("have"))
    j = r.join(c, "doi", "left").join(s, "doi", "left").join(a, "base", "left")
    by_doi, by_arxiv = F.col("doi") != "", (F.col("doi") == "") & (F.col("arxiv") != "") & F.col("have").isNotNull()
    same = F.array_contains("have", F.col("arxiv"))
    return j.select(
        "rid",
        F.when(by_doi & F.col("c"), "crossref").when(by_doi & F.col("s") | by_arxiv, "semantic-scholar").alias("provider"),
        F.when(by_doi, "doi").when(F.col("arxiv") != "", "arxiv").alias("matched_by"),
        F.when(by_doi & F.col("c"), 0.99).when(by_doi & F.col("s"), 0.97).when(by_arxiv & same, 0.99).when(by_arxiv, 0.98).otherwise(0.0).alias("confidence"),
        F.when(by_doi, F.col("doi")).otherwise(F.col("arxiv")).alias("queried"),
    )


def online_query(title: Column, doi: Column, arxiv: Column, kind: Column) -> Column:
    """struct<kind, query, error>: what a search by title, DOI or arXiv id asks for; error names what is not fit to ask."""
    asked = F.when(kind == "doi", F.when(N.valid_doi(doi), N.normalize_doi(doi))).when(kind == "arxiv", F.when(N.valid_arxiv(arxiv), N.arxiv_bare(arxiv))).when(kind == "title", F.when(N.squeeze(title) != "", N.squeeze(title)))
    return F.struct(kind.alias("kind"), asked.alias("query"), F.when(asked.isNull(), kind).alias("error"))


def selected(resolution: Column, index: int) -> Column:
    """A resolution whose candidate of that index the user chose (V11); NULL where there is none."""
    c = F.try_element_at(resolution["candidates"], F.lit(index + 1))
    chosen = F.struct(F.lit("matched").alias("status"), c["provider"].alias("provider"), c["matchedBy"].alias("matchedBy"), c["confidence"].alias("confidence"), c["canonical"].alias("canonical"), F.lit("user").alias("selectedBy"), F.lit(index).alias("selectedCandidateIndex"))
    return F.when((resolution["status"] == "candidates") & c["canonical"].isNotNull(), chosen)
