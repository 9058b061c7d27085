"""Scalar normalisers as Column -> Column functions; NULL counts as "" wherever the result is text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioplan.compat import js_trim
from folioplan.functions.folding import nfkd_no_marks, nfkd_plain


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean(c: Column) -> Column:
    return js_trim(text(c))


def squeeze(c: Column) -> Column:
    """White space runs to one space, trimmed."""
    return js_trim(F.regexp_replace(text(c), r"[\s\p{Z}\x{FEFF}]+", " "))


# ---- titles, slugs, keys (N1-N6, N10) ---------------------------------------------------------------------------


def normalize_doi(c: Column) -> Column:
    v = F.regexp_replace(clean(c), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.lower(F.regexp_replace(v, r"(?i)^doi:\s*", ""))


def normalized_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(nfkd_plain(F.lower(text(c))), "[^a-z0-9]+", " "))


def slug(c: Column, size: int = 80) -> Column:
    """Hyphenated ASCII words; one hyphen at either end goes before the cut, not after it."""
    dashed = F.regexp_replace(nfkd_plain(F.lower(text(c))), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, size)


def slug_topic(c: Column) -> Column:
    return slug(squeeze(c), 72)


def compact_citation_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(nfkd_no_marks(clean(c))), r"[^\p{L}\p{N}]", "")


def author_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(nfkd_plain(text(c))), "[^a-z0-9]+", " "))


def archive_key(c: Column, size: int = 80) -> Column:
    v = F.regexp_replace(nfkd_plain(clean(c)), "[^A-Za-z0-9._-]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(v, r"^[.-]+|[.-]+$", ""), 1, size), r"[.-]+$", "")


def default_archive_key(title: Column, authors: Column, year: Column) -> Column:
    """surname-year-first four words of the title; whatever is missing is left out."""
    surname = F.element_at(F.split(squeeze(F.get(authors, F.lit(0))), " "), -1)
    words = F.array_join(F.slice(F.split(squeeze(title), " "), 1, 4), "-")
    parts = F.filter(F.array(text(surname), F.coalesce(year.cast("string"), F.lit("")), words), lambda x: x != "")
    return archive_key(F.array_join(parts, "-"))


# ---- arXiv: the behaviours that differ, each by its own name (N4) -------------------------------------------------


def _arxiv_prefix(c: Column) -> Column:
    return F.regexp_replace(clean(c), r"(?i)^arxiv:\s*", "")


def arxiv_identity(c: Column) -> Column:
    """Prefix or URL, .pdf and version removed, lower case."""
    v = F.regexp_replace(clean(c), r"(?i)^(arxiv:\s*|https?://arxiv\.org/(abs|pdf)/)", "")
    return F.lower(F.regexp_replace(F.regexp_replace(v, r"(?i)\.pdf$", ""), r"(?i)v\d+$", ""))


def arxiv_reference(c: Column) -> Column:
    """Prefix and version removed, lower case."""
    return F.lower(F.regexp_replace(_arxiv_prefix(c), r"(?i)v\d+$", ""))


def arxiv_versioned(c: Column) -> Column:
    """Prefix removed, lower case; the version stays."""
    return F.lower(_arxiv_prefix(c))


def arxiv_bare(c: Column) -> Column:
    """Prefix removed only."""
    return _arxiv_prefix(c)


def arxiv_base(c: Column) -> Column:
    """Prefix and version removed; case stays."""
    return F.regexp_replace(_arxiv_prefix(c), r"(?i)v\d+$", "")


# ---- tokens (N7-N9) -----------------------------------------------------------------------------------------------

#: Words that say nothing about the theme of a paper.
THEME_STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just may me might more most must my myself no nor not of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves
abstract approach approaches based data dataset datasets method methods model models paper results study system systems using use used via new propose proposed show shows work
""".split()  # fmt: skip
#: Words of bibliography entries that do not tell references apart.
REFERENCE_STOP_WORDS = (
    "a an and by et for from in of on or the to with without journal proceedings conference volume vol issue number pages page pp"
).split()


def theme_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(nfkd_plain(F.lower(text(c))), F.lit("[a-z0-9][a-z0-9-]{1,}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in THEME_STOP_WORDS])
    return F.filter(found, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t) & ~t.rlike(r"^\d+$"))


def plain_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(nfkd_plain(clean(c))), F.lit("[a-z0-9]+"), F.lit(0))


def meaningful_tokens(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in REFERENCE_STOP_WORDS])
    return F.filter(plain_tokens(c), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def query_tokens(c: Column) -> Column:
    """Distinct search words, longest first, ties in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(clean(c)), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}._:/+\-]*"), F.lit(0)))
    ranked = F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda r: r["x"])


# ---- years, texts, identifiers (N11-N17) --------------------------------------------------------------------------


def normalized_year(c: Column) -> Column:
    y = c.cast("double")
    return F.when((y > 0) & (y == F.floor(y)), y.cast("int"))


def valid_year(c: Column) -> Column:
    """A whole number above 0."""
    y = clean(c).try_cast("double")
    return F.coalesce((y > 0) & (y == F.floor(y)), F.lit(False))


def valid_doi(c: Column) -> Column:
    return normalize_doi(c).rlike(r"^10\.\d{4,9}/\S+$")


def valid_arxiv(c: Column) -> Column:
    return _arxiv_prefix(c).rlike(r"(?i)^(\d{4}\.\d{4,5}|[a-z-]+(\.[a-z]{2})?/\d{7})(v\d+)?$")


def first_date_year(*date_parts: Column) -> Column:
    """The first valid year of several date-parts (array<array<int>>), in order."""
    return F.coalesce(*[F.when(F.get(F.get(d, F.lit(0)), F.lit(0)) > 0, F.get(F.get(d, F.lit(0)), F.lit(0))) for d in date_parts])


def plain_abstract(c: Column) -> Column:
    """Markup to spaces, five entities decoded in order, white space collapsed."""
    v = F.regexp_replace(text(c), "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        v = F.replace(v, F.lit(entity), F.lit(char))
    return squeeze(v)


def abstract_from_inverted_index(c: Column) -> Column:
    """map<word, positions> to text; of two words at one position the later one in the map wins."""
    cells = F.flatten(F.transform(F.map_entries(c), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    ordered = F.array_sort(cells)
    last = F.filter(ordered, lambda x, k: ~F.coalesce(F.get(ordered, k + 1)["p"] == x["p"], F.lit(False)))
    return F.array_join(F.transform(last, lambda x: x["w"]), " ")


def open_alex_id(c: Column) -> Column:
    return F.upper(F.regexp_extract(text(c), r"(?i)(W\d+)$", 1))


def arxiv_from_locations(urls: Column) -> Column:
    """The first arXiv id in a list of location URLs."""
    ids = F.transform(urls, lambda u: F.regexp_extract(text(u), r"(?i)arxiv\.org/(?:abs|pdf)/([^\s?#]+?)(?:\.pdf)?$", 1))
    return F.coalesce(F.get(F.filter(ids, lambda x: x != ""), F.lit(0)), F.lit(""))


def open_alex_topics(names: Column, concepts: Column, least: float = 0.45, most: int = 6) -> Column:
    """Topic names, then the first concepts of at least a score (array<struct<display_name, score>>)."""
    good = F.transform(F.slice(F.filter(concepts, lambda x: x["score"] >= least), 1, most), lambda x: x["display_name"])
    return F.array_union(F.coalesce(names, F.array().cast("array<string>")), F.coalesce(good, F.array().cast("array<string>")))


# ---- identity keys (N17-N24) --------------------------------------------------------------------------------------


def _ladder(*rungs: tuple[str, Column]) -> Column:
    """prefix + value of the first rung with a value; "" where none has one."""
    return F.coalesce(*[F.when(v != "", F.concat(F.lit(p), v)) for p, v in rungs], F.lit(""))


def _year_text(c: Column) -> Column:
    return F.coalesce(F.when(c != 0, c.cast("string")), F.lit(""))


def paper_identity_key(p: dict[str, Column]) -> Column:
    """doi, else Semantic Scholar, else arXiv, else title and year (also where both are empty)."""
    title = F.concat(F.lit("title:"), normalized_title(p["title"]), F.lit(":"), _year_text(p["year"]))
    key = _ladder(("doi:", normalize_doi(p["doi"])), ("s2:", text(p["semanticScholarId"])), ("arxiv:", F.lower(text(p["arxivId"]))))
    return F.when(key != "", key).otherwise(title)


def reviewed_paper_identity(p: dict[str, Column], fallback: Column) -> Column:
    key = _ladder(("doi:", normalize_doi(p["doi"])), ("s2:", clean(p["semanticScholarId"])), ("arxiv:", arxiv_bare(p["arxivId"])))
    return F.when(key != "", key).otherwise(text(fallback))


def provider_reference_key(r: dict[str, Column]) -> Column:
    """doi, arXiv, Semantic Scholar, OpenAlex, title and year, raw text."""
    title = normalized_title(r["title"])
    return _ladder(
        ("doi:", normalize_doi(r["doi"])),
        ("arxiv:", arxiv_reference(r["arxivId"])),
        ("s2:", F.lower(clean(r["semanticScholarId"]))),
        ("openalex:", F.lower(clean(r["openAlexId"]))),
        ("title:", F.when(title != "", F.concat(title, F.lit(":"), _year_text(r["year"]))).otherwise("")),
        ("raw:", F.lower(squeeze(r["rawText"]))),
    )


def reference_provenance_key(r: dict[str, Column], canonical: dict[str, Column]) -> Column:
    """doi, arXiv, raw text, Semantic Scholar, title and year: raw text comes before the softer identities."""
    title, year = normalized_title(canonical["title"]), normalized_year(canonical["year"])
    doi = normalize_doi(r["doi"])
    arxiv = arxiv_identity(r["arxivId"])
    return _ladder(
        ("doi:", F.when(doi != "", doi).otherwise(normalize_doi(canonical["doi"]))),
        ("arxiv:", F.when(arxiv != "", arxiv).otherwise(arxiv_identity(canonical["arxivId"]))),
        ("raw:", F.lower(squeeze(r["rawText"]))),
        ("s2:", F.lower(clean(canonical["semanticScholarId"]))),
        ("title:", F.when((title != "") & year.isNotNull(), F.concat(title, F.lit(":"), year.cast("string"))).otherwise("")),
    )


def review_reference_key(r: dict[str, Column], strip_arxiv_prefix: bool = True) -> Column:
    arxiv = arxiv_versioned(r["arxivId"]) if strip_arxiv_prefix else F.lower(clean(r["arxivId"]))
    return _ladder(("doi:", normalize_doi(r["doi"])), ("arxiv:", arxiv), ("raw:", F.lower(squeeze(r["rawText"]))))


def candidate_key(p: dict[str, Column], index: Column) -> Column:
    """openalex, doi, arXiv; a candidate with a title alone is like no other."""
    key = _ladder(("openalex:", F.lower(clean(p["openAlexId"]))), ("doi:", normalize_doi(p["doi"])), ("arxiv:", arxiv_versioned(p["arxivId"])))
    return F.when(key != "", key).otherwise(F.concat(F.lit("title:"), normalized_title(p["title"]), F.lit(":"), _year_text(p["year"]), F.lit(":"), index.cast("string")))


def title_year_key(title: Column, year: Column, strict: bool = False) -> Column:
    """Always a key; with ``strict`` only where the title and a valid year are known."""
    if strict:
        t, y = normalized_title(title), normalized_year(year)
        return F.when((t != "") & y.isNotNull(), F.concat(t, F.lit(":"), y.cast("string"))).otherwise("")
    return F.concat(normalized_title(title), F.lit(":"), _year_text(year))


def stable_id(p: dict[str, Column], order: tuple[str, ...], fallback: Column) -> Column:
    """Ids that providers' records get: the first known identifier of ``order``."""
    value = {
        "doi": ("doi:", normalize_doi(p["doi"])),
        "s2": ("s2:", text(p["semanticScholarId"])),
        "arxiv": ("arxiv:", text(p["arxivId"])),
        "openalex": ("openalex:", text(p["openAlexId"])),
    }
    key = _ladder(*[value[o] for o in order])
    return F.when(key != "", key).otherwise(fallback)


def attachment_key(p: dict[str, Column], file_name: Column, size: Column, modified: Column) -> Column:
    """doi, arXiv, title and year, file name, file with size and time."""
    title = normalized_title(p["title"])
    return _ladder(
        ("doi:", normalize_doi(p["doi"])),
        ("arxiv:", arxiv_identity(p["arxivId"])),
        ("title:", F.when((title != "") & (p["year"] > 0), F.concat(title, F.lit(":"), p["year"].cast("string"))).otherwise("")),
        ("file:", F.when(size.isNull(), F.lower(clean(file_name))).otherwise(F.concat_ws(":", F.lower(clean(file_name)), size.cast("string"), modified.cast("string")))),
    )


# ---- references as text (N25, N26, N38, N43) ----------------------------------------------------------------------


def reference_text(authors: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    """Authors. (year). Title. Venue. https://doi.org/... with doubled stops collapsed."""
    names = F.array_join(F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), clean), lambda x: x != ""), ", ")
    d = normalize_doi(doi)
    parts = F.filter(
        F.array(names, F.when(year > 0, F.format_string("(%d)", year.cast("int"))).otherwise(""), clean(title), clean(venue), F.when(d != "", F.concat(F.lit("https://doi.org/"), d)).otherwise("")),
        lambda x: x != "",
    )
    return F.regexp_replace(F.array_join(parts, ". "), r"\.{2,}", ".")


def crossref_confidence(doi: Column, title: Column, raw: Column) -> Column:
    """.98 with a DOI, .86 with a title, .65 with text alone, NULL (dropped) with nothing."""
    return F.when(normalize_doi(doi) != "", 0.98).when(clean(title) != "", 0.86).when(clean(raw) != "", 0.65)


def reference_search_query(raw: Column) -> Column:
    v = F.regexp_replace(clean(raw), r"^\s*(?:\[[^\]]+\]|\d+[.)])\s*", "")
    v = F.regexp_replace(v, r"(?<![A-Za-z0-9_])(?:18|19|20)\d{2}(?![A-Za-z0-9_])", " ")
    return F.substring(squeeze(v), 1, 300)


def reference_meta(r: dict[str, Column]) -> Column:
    """Label, pages, year, DOI and confidence as one line."""
    pages = F.when(r["pageStart"].isNull(), F.lit(None)).when(r["pageEnd"].isNull() | (r["pageEnd"] == r["pageStart"]), F.format_string("p. %d", r["pageStart"])).otherwise(F.format_string("pp. %d–%d", r["pageStart"], r["pageEnd"]))
    label = F.when(clean(r["label"]) != "", F.concat(F.lit("["), clean(r["label"]), F.lit("]")))
    doi = normalize_doi(r["doi"])
    sure = F.when(r["confidence"].isNotNull(), F.concat(F.floor(r["confidence"] * 100 + 0.5).cast("string"), F.lit("%")))
    return F.concat_ws(" · ", label, pages, F.when(r["year"] > 0, r["year"].cast("string")), F.when(doi != "", F.concat(F.lit("DOI "), doi)), sure)


def citation_string(authors: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    """Authors (year or n.d.). Title. Venue. https://doi.org/..."""
    names = F.array_join(F.coalesce(authors, F.array().cast("array<string>")), ", ", "")
    d = normalize_doi(doi)
    head = F.concat(names, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("). "), text(title), F.lit("."))
    return F.concat(head, F.when(clean(venue) != "", F.concat(F.lit(" "), clean(venue), F.lit("."))).otherwise(""), F.when(d != "", F.concat(F.lit(" https://doi.org/"), d)).otherwise(""))


# ---- lists (N28, N29) ---------------------------------------------------------------------------------------------


def unique_strings(c: Column, most: int | None = None) -> Column:
    """Distinct without regard to case, first spelling and first place; blanks dropped."""
    kept = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), squeeze), lambda x: x != "")
    keys = F.transform(kept, F.lower)
    first = F.filter(kept, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
    return first if most is None else F.slice(first, 1, most)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


# ---- sources, kinds, looks (N30-N36, N40-N47) ---------------------------------------------------------------------

#: How sources of papers are labelled.
SOURCE_LABELS = {
    "demo": "Bundled demo dataset",
    "demo-dataset": "Bundled demo dataset",
    "bibtex": "BibTeX import",
    "bibtex-import": "BibTeX import",
    "semantic-scholar": "Semantic Scholar",
    "semantic-scholar-resolve": "Semantic Scholar lookup",
    "semantic-scholar-enrichment": "Semantic Scholar enrichment",
    "semantic-scholar-expansion": "Semantic Scholar citation expansion",
    "openalex": "OpenAlex",
    "openalex-resolve": "OpenAlex lookup",
    "openalex-enrichment": "OpenAlex enrichment",
    "openalex-expansion": "OpenAlex citation expansion",
    "openalex-search": "OpenAlex search",
    "openalex-title-search": "OpenAlex search",
    "crossref": "Crossref",
    "crossref-resolve": "Crossref lookup",
    "crossref-enrichment": "Crossref enrichment",
    "reviewed-pdf": "Reviewed PDF import",
    "ai-pdf": "Reviewed AI PDF extraction",
    "local-pdf": "Reviewed local PDF extraction",
    "backup-merge": "Backup merge",
}
#: Research relations, each with its label and that of its inverse.
RELATIONS = {
    "builds_on": ("Builds on", "Built on by"), "improves_on": ("Improves on", "Improved by"), "extends": ("Extends", "Extended by"), "outperforms": ("Outperforms", "Outperformed by"),
    "invalidates": ("Invalidates", "Invalidated by"), "contradicts": ("Contradicts", "Contradicted by"), "supports": ("Supports", "Supported by"), "replicates": ("Replicates", "Replicated by"),
}


def entry_source(method: Column, source: Column) -> Column:
    """How a paper came into the library, else its source, else "unknown"."""
    first = js_trim(F.coalesce(F.when(text(method) != "", method), F.when(text(source) != "", source), F.lit("unknown")))
    return F.when(first != "", first).otherwise("unknown")


def source_label(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv])
    key = F.when(clean(c) != "", clean(c)).otherwise("unknown")
    words = F.split(F.translate(key, "-", " "), " ")
    return F.coalesce(F.try_element_at(known, key), F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " "))


def node_kind(starred: Column, source: Column) -> Column:
    return F.when(starred, "starred").when(source.endswith("-expansion"), "auto-added").when(source.endswith("-resolve"), "manual-added").otherwise("other")


def citation_radius(count: Column) -> Column:
    return F.when(count > 0, F.greatest(F.lit(8.0), F.least(F.lit(15.0), 8 + F.log10(count + 1) * 1.75))).otherwise(8.0)


def fnv1a(c: Column) -> Column:
    """FNV-1a over code points, 32 bits, as a non-negative BIGINT."""
    codes = F.transform(F.regexp_extract_all(text(c), F.lit("(?s)."), F.lit(0)), lambda x: F.ascii(x).cast("bigint"))
    mask = F.lit(0xFFFFFFFF).cast("bigint")

    def step(h: Column, x: Column) -> Column:
        v = h.bitwiseXOR(x)
        # 16777619 = 2^24 + 403: the two products stay within 63 bits.
        return (F.shiftleft(v.bitwiseAND(F.lit(0xFF).cast("bigint")), 24) + v * F.lit(403).cast("bigint")).bitwiseAND(mask)

    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)


def short_text(c: Column, most: int = 34, fallback: str = "") -> Column:
    t = squeeze(F.when(text(c) != "", c).otherwise(F.lit(fallback)))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def relation_label(relation: Column, inverse: bool = False) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in RELATIONS.items() for x in (k, v[inverse])])
    return F.coalesce(F.try_element_at(table, text(relation)), F.translate(text(relation), "_", " "))


def is_research_relation(kind: Column, relation: Column) -> Column:
    """Anything that is not a valid research relation is a citation."""
    return F.coalesce((kind == "research-relation") & relation.isin(*RELATIONS), F.lit(False))


def relation_edge_id(source: Column, target: Column, relation: Column) -> Column:
    return F.concat(F.lit("relation:"), relation, F.lit(":"), source, F.lit("->"), target)


def edge_id(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit("->"), target)


def identifier_kind(c: Column) -> Column:
    """doi, semantic-scholar, openalex, arxiv, or title."""
    t = clean(c)
    return (
        F.when(normalize_doi(t).rlike(r"(?i)^10\.\d{4,9}/"), "doi")
        .when(t.rlike("(?i)^[0-9a-f]{40}$"), "semantic-scholar")
        .when(t.rlike(r"(?i)^(https?://openalex\.org/)?W\d+$"), "openalex")
        .when(t.rlike(r"(?i)^(arxiv:)?(\d{4}\.\d{4,5}|[a-z][a-z0-9.\-]+/\d{7})(v\d+)?$"), "arxiv")
        .when(t != "", "title")
        .otherwise("")
    )


def request_source(url: Column) -> Column:
    """Which service a request went to, by its host."""
    host = F.lower(text(F.try_parse_url(url, F.lit("HOST"))))
    return (
        F.when(host.endswith("semanticscholar.org"), "Semantic Scholar").when(host.endswith("openalex.org"), "OpenAlex").when(host.endswith("crossref.org"), "Crossref").when(host.endswith("arxiv.org"), "arXiv").when(host != "", host).otherwise("Local")
    )


def request_target(url: Column) -> Column:
    """Host and path; queries and fragments may hold secrets and go."""
    return F.concat(text(F.try_parse_url(url, F.lit("HOST"))), text(F.try_parse_url(url, F.lit("PATH"))))


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(c), r"^.*[/\\]", ""), r"\.[^.]+$", "")


def file_kind(name: Column, mime: Column | None = None) -> Column:
    """pdf, json, bib or unsupported, by extension or MIME type."""
    n, m = F.lower(clean(name)), F.lower(text(mime)) if mime is not None else F.lit("")
    return F.when(n.endswith(".pdf") | (m == "application/pdf"), "pdf").when(n.endswith(".json") | (m == "application/json"), "json").when(n.endswith(".bib") | n.endswith(".bibtex") | m.contains("bibtex"), "bib").otherwise("unsupported")


def reading_status(c: Column) -> Column:
    return F.when(c == "key", "read").otherwise(c)


def highlight_parts(c: Column, query: str) -> Column:
    """array<struct<text, match>>: the phrase with flexible spaces where it occurs, else any of its words."""
    import re

    words = [w for w in re.split(r"\s+", query.strip()) if w]
    if not words:
        return F.array(F.struct(text(c).alias("text"), F.lit(False).alias("match")))
    phrase = r"\s+".join(re.escape(w) for w in words)
    tokens = sorted(dict.fromkeys(re.findall(r"[^\W_][\w.:/+\-]*", query.lower())), key=len, reverse=True)
    anyword = "|".join(re.escape(t) for t in tokens) or phrase

    def spans(pattern: str) -> Column:
        p = f"(?iu)({pattern})"
        hits = F.regexp_extract_all(text(c), F.lit(p), F.lit(1))
        rest = F.split(text(c), p, -1)
        woven = F.flatten(F.transform(rest, lambda t, i: F.array(F.struct(t.alias("text"), F.lit(False).alias("match")), F.struct(F.coalesce(F.get(hits, i), F.lit("")).alias("text"), F.lit(True).alias("match")))))
        return F.filter(woven, lambda x: x["text"] != "")

    return F.when(text(c).rlike(f"(?iu){phrase}"), spans(phrase)).otherwise(spans(anyword))


def ai_text(c: Column, limit: int = 120_000) -> Column:
    """Head and tail of a text too long for a model, with a marker between."""
    tail = min(20_000, limit // 4)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - tail), F.lit("\n\n[... document truncated ...]\n\n"), F.right(c, F.lit(tail))))


def ai_metadata(m: dict[str, Column]) -> dict[str, Column]:
    """Bounds on what a model returns: confidence in [0, 1], at most 12 topics, 50 authors, 20 keywords."""
    topics = F.transform(F.slice(F.filter(m["topics"], lambda t: squeeze(t["name"]) != ""), 1, 12), lambda t: F.struct(squeeze(t["name"]).alias("name"), clamp(F.coalesce(t["confidence"], F.lit(0.0)), 0.0, 1.0).alias("confidence")))
    return {
        "title": squeeze(m["title"]), "authors": unique_strings(m["authors"], 50), "year": normalized_year(m["year"]), "keywords": unique_strings(m["keywords"], 20),
        "topics": topics, "confidence": clamp(F.coalesce(m["confidence"], F.lit(0.0)), 0.0, 1.0), "warnings": unique_strings(m["warnings"], 20),
    }


# ---- pattern catalogue (R1-R5) ------------------------------------------------------------------------------------

DOI_PATTERN = r"(?i)(?<![A-Za-z0-9_])10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
YEAR_PATTERN = r"(?<![\p{L}\p{N}_])((?:19|20)\d{2})[a-z]?(?![\p{L}\p{N}_])"
NUMBERED_PATTERN = r"^\s*(?:\[(\d{1,4})\]|(\d{1,3})[.)])\s*(.*)$"
AUTHOR_YEAR_PATTERN = r"^\s*\p{Lu}[\p{L}'’\-]+(?:,|\s).{0,150}(?<![\p{L}\p{N}_])(?:19|20)\d{2}[a-z]?(?![\p{L}\p{N}_])"


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def extract_doi(c: Column) -> Column:
    """First DOI, lower case, without closing stops and unbalanced brackets; NULL where there is none."""
    d = F.lower(F.regexp_replace(F.regexp_extract(text(c), DOI_PATTERN, 0), r"[.,;:]+$", ""))
    extra = F.greatest(F.lit(0), _count(d, ")") - _count(d, "("))
    closing = F.length(d) - F.length(F.regexp_replace(d, r"\)+$", ""))
    d = F.substring(d, F.lit(1), F.length(d) - F.least(extra, closing))
    return F.when(d != "", d)


def extract_arxiv(c: Column, strict: bool = False) -> Column:
    """New-style id anywhere (also inside other numbers unless ``strict``), else an old-style one in lower case."""
    edge = (r"(?<![\d.])", r"(?!\d)") if strict else ("", "")
    new = F.regexp_extract(text(c), rf"(?i)(?:arxiv\s*:\s*)?{edge[0]}(\d{{4}}\.\d{{4,5}}(?:v\d+)?){edge[1]}", 1)
    old = F.lower(F.regexp_extract(text(c), r"(?i)(?:arxiv\s*:\s*)?([a-z][a-z0-9.\-]+/\d{7}(?:v\d+)?)", 1))
    return F.when(new != "", new).when(old != "", old)


def extract_year(c: Column) -> Column:
    return F.regexp_extract(text(c), YEAR_PATTERN, 1).try_cast("int")
