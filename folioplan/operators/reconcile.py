"""Citation edges from reviewed bibliography entries, and other joins that an order of precedence decides.

An identity join "doi, else Semantic Scholar, else arXiv, else title and year" is not an equality: the first key that
both sides have decides.  It is planned as one equi-join per key, united, and verified with a single CASE; no OR
condition ever reaches the planner.  Library papers enter as signatures (their keys) with a count and two of their
ids, so that copies of a work never multiply candidates.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioplan.compat import cut
from folioplan.functions import normalize as N

KEYS = ("doi", "s2", "arxiv", "ty")


def keys_of(doi: Column, s2: Column, arxiv: Column, title: Column, year: Column) -> list[Column]:
    return [
        N.normalize_doi(doi).alias("doi"),
        F.lower(N.clean(s2)).alias("s2"),
        N.arxiv_identity(arxiv).alias("arxiv"),
        N.title_year_key(title, year, strict=True).alias("ty"),
    ]


def same_work(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """The first key that both sides have decides; title and year need all four."""
    test = (left["ty"] != "") & (left["ty"] == right["ty"])
    for k in reversed(KEYS[:3]):
        test = F.when((left[k] != "") & (right[k] != ""), left[k] == right[k]).otherwise(test)
    return test


def precedence_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (lid, rid) of the same work; both sides: lid or rid, and the columns of ``keys_of``."""
    left, r = cut(left), cut(right.select("rid", *[F.col(k).alias(f"r_{k}") for k in KEYS]))
    rungs = [left.join(r, (left[k] == r[f"r_{k}"]) & (left[k] != "")) for k in KEYS]
    return reduce(DataFrame.union, rungs).where(same_work({k: F.col(k) for k in KEYS}, {k: F.col(f"r_{k}") for k in KEYS})).select("lid", "rid").distinct()


def references(papers: DataFrame) -> DataFrame:
    """source_id, ordinal and the fields of every extracted reference."""
    return papers.select(F.col("id").alias("source_id"), F.posexplode("extractedReferences").alias("ordinal", "r")).select("source_id", "ordinal", "r.*")


_NO_ID = ("doi", "semanticScholarId", "arxivId")


def with_canonical(refs: DataFrame) -> DataFrame:
    """Adds ``canonical``: the stored canonical reference, else that of a matched resolution, else NULL."""

    def usable(c: Column) -> Column:
        some = reduce(lambda a, b: a | b, [N.clean(c[k]) != "" for k in _NO_ID])
        return c.isNotNull() & (some | (N.title_year_key(c["title"], c["year"], strict=True) != ""))

    stored, resolved = F.col("canonicalReference"), F.col("resolution.canonical")
    matched = (F.col("resolution.status") == "matched") & usable(resolved)
    return refs.withColumn("canonical", F.when(usable(stored), stored).when(matched, resolved))


def _evidence(papers: DataFrame) -> DataFrame:
    """id, the identity keys, what a printed title can be recognised by, and sig, a digest of all of it."""
    title, first = N.clean(F.col("title")), N.clean(F.get("authors", F.lit(0)))
    compact = N.compact_citation_text(title)
    surname = N.compact_citation_text(F.element_at(F.split(first, r"[\s\p{Z}]+"), -1))
    rows = papers.select(
        "id", *keys_of(F.col("doi"), F.col("semanticScholarId"), F.col("arxivId"), F.col("title"), F.col("year")), compact.alias("c"), surname.alias("s"), F.size(F.split(title, r"[\s\p{Z}]+")).alias("w"), N.normalized_year(F.col("year")).alias("year")
    )
    evident = (F.length("c") >= 40) & (F.col("w") >= 5) & (F.length("s") >= 3)
    rows = rows.select("id", *KEYS, F.when(evident, F.col("c")).alias("ctitle"), F.when(evident, F.col("s")).alias("surname"), "year")
    return rows.withColumn("sig", F.sha2(F.to_json(F.struct(*_SIGNED)), 256))


_SIGNED = (*KEYS, "ctitle", "surname", "year")


def signatures(papers: DataFrame) -> DataFrame:
    """sig, its keys and evidence, and of the papers that share all of them their number, smallest and largest id."""
    return _evidence(papers).groupBy("sig", *_SIGNED).agg(F.count_distinct("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def _verdict(hits: DataFrame) -> DataFrame:
    """rid, rung, n, target over hits (rid, rung, source_id, n, lo, hi, own): papers other than the source."""
    others = F.col("n") - F.col("own").cast("int")
    target = F.when(F.col("own") & (F.col("lo") == F.col("source_id")), F.col("hi")).otherwise(F.col("lo"))
    return hits.groupBy("rid", "rung").agg(F.sum(others).alias("n"), F.min(F.when(others > 0, target)).alias("target")).where("n > 0")


def _own(hits: DataFrame, papers_sig: DataFrame) -> DataFrame:
    return hits.join(papers_sig.withColumnRenamed("sig", "own_sig"), "source_id", "left").withColumn("own", F.coalesce(F.col("own_sig") == F.col("sig"), F.lit(False)))


def _sig_of(papers: DataFrame) -> DataFrame:
    """source_id, sig of the papers that have references and so could match themselves."""
    return _evidence(papers.where("size(extractedReferences) > 0")).select(F.col("id").alias("source_id"), "sig")


def canonical_targets(refs: DataFrame, papers: DataFrame, sigs: DataFrame | None = None) -> DataFrame:
    """source_id, ordinal, target: references whose canonical form is exactly one other paper of the library."""
    sigs = cut(signatures(papers)) if sigs is None else sigs
    c = with_canonical(refs).where("canonical IS NOT NULL")
    left = c.select("source_id", "ordinal", *keys_of(F.col("canonical.doi"), F.col("canonical.semanticScholarId"), F.col("canonical.arxivId"), F.col("canonical.title"), F.col("canonical.year")))
    left = cut(left.withColumn("rid", F.concat_ws("\x00", "source_id", "ordinal")))
    r = sigs.select("sig", "n", "lo", "hi", *[F.col(k).alias(f"r_{k}") for k in KEYS])
    rungs = [left.join(r, (left[k] == r[f"r_{k}"]) & (left[k] != "")) for k in KEYS]
    hits = reduce(DataFrame.union, rungs).where(same_work({k: F.col(k) for k in KEYS}, {k: F.col(f"r_{k}") for k in KEYS}))
    hits = hits.select("rid", "source_id", "sig", "n", "lo", "hi", F.lit(0).alias("rung")).distinct()
    found = _verdict(_own(hits, _sig_of(papers))).where("n = 1")
    return found.join(left.select("rid", "source_id", "ordinal"), "rid").select("source_id", "ordinal", "target")


@F.pandas_udf(T.ArrayType(T.StringType()))
def printed_dois(text: pd.Series, longest: pd.Series) -> pd.Series:
    """Strings of a text without white space that could be a whole DOI: from "10." to each place where one of at most
    ``longest`` characters (the longest there is in the library) may end."""
    out = []
    for t, most in zip(text, longest):
        found, at = [], (t or "").find("10.")
        while at >= 0:
            if at == 0 or not (t[at - 1].isascii() and t[at - 1].isalnum()):
                for end in range(at + 7, min(len(t), at + most) + 1):
                    after = t[end : end + 1]
                    if not (after and (after.isascii() and after.isalnum() or after in "/_-")):
                        d = t[at:end]
                        if t.find(d) == at:
                            found.append(d)
            at = t.find("10.", at + 1)
        out.append(found)
    return pd.Series(out)


LADDER = ("local-doi", "local-semanticScholarId", "local-arxivId", "local-doi-text", "local-title-author-year")


def local_targets(refs: DataFrame, papers: DataFrame, sigs: DataFrame | None = None) -> DataFrame:
    """source_id, ordinal, target, matched_by of reviewed references without a canonical form.

    The lowest rung with any paper decides, and only if it names exactly one.  Papers whose identifiers contradict
    those of the reference are no candidates on any rung.
    """
    sigs = cut(signatures(papers)) if sigs is None else sigs
    open_ = with_canonical(refs).where("canonical IS NULL AND reviewed")
    left = open_.select(
        "source_id", "ordinal", N.normalize_doi(F.col("doi")).alias("doi"), F.lower(N.clean(F.col("semanticScholarId"))).alias("s2"), N.arxiv_identity(F.col("arxivId")).alias("arxiv"), N.clean(F.col("rawText")).alias("raw"), N.normalized_year(F.col("year")).alias("ref_year")
    )
    left = cut(left.withColumn("rid", F.concat_ws("\x00", "source_id", "ordinal")))
    s = sigs.select("sig", "n", "lo", "hi", "ctitle", "surname", F.col("year").alias("r_year"), *[F.col(k).alias(f"r_{k}") for k in KEYS])

    def conflict(doi: Column) -> Column:
        pairs = ((doi, F.col("r_doi")), (F.col("s2"), F.col("r_s2")), (F.col("arxiv"), F.col("r_arxiv")))
        return reduce(lambda a, b: a | b, [(x != "") & (y != "") & (x != y) for x, y in pairs])

    out = []
    cols = ["rid", "source_id", "sig", "n", "lo", "hi"]
    for k, name in enumerate(("doi", "s2", "arxiv")):
        j = left.join(s, (left[name] == s[f"r_{name}"]) & (left[name] != "")).where(~conflict(F.col("doi")))
        out.append(j.select(*cols, F.lit(k).alias("rung")))
    longest = sigs.agg(F.max(F.length("doi"))).first()[0] or 0
    squashed = left.withColumn("flat", F.lower(F.regexp_replace("raw", r"[\s\p{Z}]+", "")))
    printed = squashed.where(F.col("flat").contains("10.")).withColumn("printed", F.explode(printed_dois("flat", F.lit(longest))))
    j = printed.join(s, printed["printed"] == s["r_doi"]).where(F.col("r_doi").startswith(F.col("doi")) & ~conflict(F.col("r_doi")))
    out.append(j.select(*cols, F.lit(3).alias("rung")))
    # A title is at least 40 characters, so its first 40 occur in any text that holds it.
    years = F.array_distinct(F.concat(F.regexp_extract_all("raw", F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), F.when(F.col("ref_year").isNotNull(), F.array(F.col("ref_year").cast("string"))).otherwise(F.array().cast("array<string>"))))
    text = left.withColumn("compact", N.compact_citation_text(F.col("raw"))).withColumn("years", years).where("size(years) > 0 AND length(compact) >= 40")
    seeds = text.withColumn("seed", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("compact") - 39), lambda k: F.xxhash64(F.substring(F.col("compact"), k, F.lit(40)))))))
    titled = s.where("ctitle IS NOT NULL").withColumn("seed", F.xxhash64(F.substring("ctitle", 1, 40)))
    at = F.instr(F.col("compact"), F.col("ctitle"))
    before = F.substring(F.col("compact"), F.greatest(F.lit(1), at - 350), F.least(F.lit(350), at - 1))
    fits = F.col("r_year").isNull() | (F.array_contains("years", F.col("r_year").cast("string")) & (F.col("ref_year").isNull() | (F.col("ref_year") == F.col("r_year"))))
    j = seeds.join(titled, "seed").where((at > 0) & ~conflict(F.col("doi")) & fits & before.contains(F.col("surname")))
    out.append(j.select(*cols, F.lit(4).alias("rung")))
    hits = reduce(DataFrame.union, out).distinct()
    verdict = _verdict(_own(hits, _sig_of(papers)))
    first = verdict.groupBy("rid").agg(F.min(F.struct("rung", "n", "target")).alias("v")).where("v.n = 1")
    names = F.array(*[F.lit(x) for x in LADDER])
    known = sigs.where("year IS NULL").select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("target")).distinct().withColumn("undated", F.lit(True))
    found = first.join(left.select("rid", "source_id", "ordinal"), "rid").select("source_id", "ordinal", F.col("v.target").alias("target"), F.get(names, F.col("v.rung")).alias("matched_by"))
    label = F.when((F.col("matched_by") == LADDER[4]) & F.col("undated"), "local-title-author").otherwise(F.col("matched_by"))
    return found.join(known, "target", "left").select("source_id", "ordinal", "target", label.alias("matched_by"))


def inferred_edges(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """New citation edges from references, in the form of the edges table; running it again finds none.

    A rejected reference never links.  Of several references to one paper the first gives the edge.
    """
    refs = cut(references(papers).where("reviewed IS NULL OR reviewed"))
    sigs = cut(signatures(papers))
    resolved = with_canonical(refs).where("canonical IS NOT NULL").select("source_id", "ordinal", "resolution")
    a = canonical_targets(refs, papers, sigs).join(resolved, ["source_id", "ordinal"]).select("source_id", "ordinal", "target", N.clean(F.col("resolution.provider")).alias("provider"), N.clean(F.col("resolution.matchedBy")).alias("matchedBy"), N.clean(F.col("resolution.resolvedAt")).alias("resolvedAt"))
    b = local_targets(refs, papers, sigs).select("source_id", "ordinal", "target", F.lit("local-library").alias("provider"), F.col("matched_by").alias("matchedBy"), F.lit("").alias("resolvedAt"))
    first = a.union(b).groupBy("source_id", "target").agg(F.min_by(F.struct("provider", "matchedBy", "resolvedAt"), "ordinal").alias("referenceResolution"))
    new = first.select(
        N.edge_id(F.col("source_id"), F.col("target")).alias("id"), F.col("source_id").alias("source"), "target", F.lit("citation").alias("kind"), F.lit(None).cast("string").alias("relation"), F.lit("reviewed-reference").alias("provenance"), "referenceResolution"
    )
    return new.join(edges.select("id"), "id", "left_anti")


def stored_reference_paper(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """source_id, ordinal, target: references that any one key ties to exactly one paper - the looser lookup."""
    r = refs.select("source_id", "ordinal", *keys_of(F.col("doi"), F.col("semanticScholarId"), F.col("arxivId"), F.col("title"), F.col("year")))
    p = papers.select(F.col("id").alias("target"), *[c.alias(f"r_{k}") for k, c in zip(KEYS, keys_of(F.col("doi"), F.col("semanticScholarId"), F.col("arxivId"), F.col("title"), F.col("year")))])
    # Per key only its number of papers and one of them: a key that many papers share names none.
    hits = []
    for k in KEYS:
        one = p.where(F.col(f"r_{k}") != "").groupBy(F.col(f"r_{k}").alias(k)).agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
        hits.append(r.where(F.col(k) != "").select("source_id", "ordinal", k).join(one, k).select("source_id", "ordinal", "lo", "hi"))
    found = reduce(DataFrame.union, hits).groupBy("source_id", "ordinal").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return found.where("lo = hi").select("source_id", "ordinal", F.col("lo").alias("target"))


# ---- merging references (A7, A8, A14, A17) ------------------------------------------------------------------------


def merged_references(cells: DataFrame) -> DataFrame:
    """References of one paper from several deliveries, merged by identity, in order of first appearance.

    ``cells``: source_id, ordinal (over all deliveries) and the fields of a reference.  Later fields override where
    they are present; reviewed is true if any says so, false if all say so, else the latest word; a reference without
    any identity stays by itself.
    """
    r = with_canonical(cells)
    canonical = {k: F.col(f"canonical.{k}") for k in ("doi", "semanticScholarId", "arxivId", "title", "year")}
    key = N.reference_provenance_key({k: F.col(k) for k in ("doi", "arxivId", "rawText")}, canonical)
    keyed = r.withColumn("key", F.when(key != "", key).otherwise(F.concat(F.lit("anonymous:"), F.col("ordinal").cast("string"))))
    fields = [c for c in cells.columns if c not in ("source_id", "ordinal", "reviewed")]
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in fields]
    reviewed = F.when(F.bool_or("reviewed"), True).when(F.count("reviewed") == F.count("*"), False).otherwise(F.max_by("reviewed", F.when(F.col("reviewed").isNotNull(), F.col("ordinal"))))
    return keyed.groupBy("source_id", "key").agg(F.min("ordinal").alias("ordinal"), reviewed.alias("reviewed"), *last)


def merged_reference_records(cells: DataFrame) -> DataFrame:
    """References of one paper from several sets, merged by the key of providers, in order of first appearance.

    ``cells``: source_id, ordinal (over all sets, in their order) and the fields of a reference.  Later fields override
    where they are present, so that a resolution or a canonical reference is never lost; a reference without any
    identity stays by itself.
    """
    key = N.provider_reference_key({k: F.col(k) for k in ("doi", "arxivId", "semanticScholarId", "openAlexId", "title", "year", "rawText")})
    keyed = cells.withColumn("key", F.when(key != "", key).otherwise(F.concat(F.lit("anonymous:"), F.col("ordinal").cast("string"))))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in cells.columns if c not in ("source_id", "ordinal")]
    return keyed.groupBy("source_id", "key").agg(F.min("ordinal").alias("ordinal"), *last)


def resolution_counts(refs: DataFrame) -> DataFrame:
    """Per paper: references matched, with candidates, unresolved, with an identifier, and as text only."""
    identified = (N.normalize_doi(F.col("doi")) != "") | (N.arxiv_identity(F.col("arxivId")) != "")
    return refs.groupBy("source_id").agg(
        F.count("*").alias("n_references"),
        F.count_if(F.col("resolution.status").isin("matched", "resolved")).alias("matched"),
        F.count_if(F.col("resolution.status") == "candidates").alias("candidates"),
        F.count_if(F.col("resolution.status") == "unresolved").alias("unresolved"),
        F.count_if(identified).alias("identifiable"),
        F.count_if(~identified).alias("text_only"),
        F.count_if(N.normalize_doi(F.col("doi")) != "").alias("with_doi"),
        F.count_if(N.arxiv_identity(F.col("arxivId")) != "").alias("with_arxiv"),
    )


def kept_selections(old: DataFrame, new: DataFrame, key: str = "key", order: str = "ordinal") -> DataFrame:
    """New rows with the user's latest choice for a row of the same key before."""
    return new.join(old.where("use IS NOT NULL").groupBy(key).agg(F.max_by("use", order).alias("use")), key, "left")

