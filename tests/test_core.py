"""Golden cases of the library's operators on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from folioplan.functions import normalize as N
from folioplan.functions import rows as R
from folioplan.operators import cluster, components, extract, front_matter, graph, layout, library, merge, quality, reconcile, resolve
from folioplan.operators.library import Filters
from folioplan.schema import PAPER, fields


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (N.normalize_doi, " https://doi.org/10.1/AbC ", "10.1/abc"), (N.normalize_doi, "DOI: 10.1/x", "10.1/x"), (N.normalize_doi, None, ""),
        (N.normalized_title, "Ünïcode — Titles, №1!", "unicode titles o1"), (N.normalized_title, "漢字", ""), (N.slug, "-- A b  C! --", "a-b-c"),
        (N.arxiv_identity, "https://arxiv.org/pdf/2101.00001v2.pdf", "2101.00001"), (N.arxiv_versioned, "arXiv: 2101.00001V2", "2101.00001v2"), (N.arxiv_base, "arXiv:CS/0101001v3", "CS/0101001"),
        (N.author_key, "Müller,  J.", "muller j"), (N.compact_citation_text, "A-b ç Дж", "abcдж"), (N.plain_abstract, "<p>a &lt; b &amp;amp; c</p>", "a < b &amp; c"),
        (N.extract_doi, "see (doi:10.1234/AB(c)1). Next", "10.1234/ab(c)1"), (N.extract_doi, "none", None), (N.extract_arxiv, "arXiv: 2101.00001v2", "2101.00001v2"), (N.extract_arxiv, "cs.AI/0101001", "cs.ai/0101001"), (N.extract_year, "in 1999a and 2001", 1999),
        (N.source_label, "my-new-source", "My New Source"), (N.source_label, "crossref-resolve", "Crossref lookup"), (N.identifier_kind, "W123", "openalex"), (N.identifier_kind, "10.1234/x", "doi"), (N.identifier_kind, "2101.00001", "arxiv"),
        (N.reference_search_query, "[12] Some title, 2019.", "Some title, ."), (N.file_stem, "/a/b/c.d.pdf", "c.d"), (N.fnv1a, "a", 3826002220), (N.open_alex_id, "https://openalex.org/w42", "W42"),
    ],
)
def test_normalisers(spark, make, value, want):
    assert one(spark, make, value) == want


def test_highlight(spark):
    parts = lambda t, q: [(x.text, x.match) for x in one(spark, lambda c: N.highlight_parts(c, q), t)]
    assert parts("Deep  learning of graphs", "deep learning") == [("Deep  learning", True), (" of graphs", False)]
    assert parts("graphs are deep", "deep graphs") == [("graphs", True), (" are ", False), ("deep", True)]
    assert parts("a (b) c", "(b)") == [("a ", False), ("(b)", True), (" c", False)]


def papers(spark, rows):
    base = dict.fromkeys(fields(PAPER))
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], PAPER)


EDGES = "id string, source string, target string, kind string, relation string, provenance string, createdAt timestamp"


def edges(spark, rows):
    return spark.createDataFrame([(f"{s}->{t}", s, t, k, r, None, None) for s, t, k, r in rows], EDGES)


def topics(spark, rows=()):
    return spark.createDataFrame([(i, n, "ai", None) for i, n in rows], "id string, name string, source string, createdAt timestamp")


LIBRARY = [
    {"id": "a", "title": "Deep graphs", "authors": ["Ann Lee", "Bo Li", "ann  lee"], "year": 2001, "topics": ["t1", "t2"], "starred": True, "type": "article"},
    {"id": "b", "title": "Sparse graphs", "authors": ["Bo Li", "Cy Ng"], "year": 2003, "topics": ["t2"], "type": "article"},
    {"id": "c", "title": "Nothing else", "authors": None, "year": None, "topics": [], "tags": ["x"]},
]


def test_graphs(spark):
    p, e = papers(spark, LIBRARY), edges(spark, [("a", "b", None, None), ("b", "a", "research-relation", "extends"), ("a", "gone", "citation", None), ("c", "a", "research-relation", "odd")])
    blocks = {r.id: (r.name, r.source, r.n_papers, r.starred) for r in graph.topic_blocks(p, topics(spark, [("t1", "Topic one")])).collect()}
    assert blocks == {"t1": ("Topic one", "ai", 1, 1), "t2": ("t2", "derived", 2, 1)}
    assert {(r.source, r.target): r.weight for r in graph.topic_links(p, e).collect()} == {("t1", "t2"): 1, ("t2", "t1"): 1}
    people = {r.id: (r.name, r.n_papers, r.coauthors) for r in graph.author_blocks(p).collect()}
    assert people == {"author:ann lee": ("Ann Lee", 1, 1), "author:bo li": ("Bo Li", 2, 2), "author:cy ng": ("Cy Ng", 1, 1)}
    assert {(r.source, r.target): r.weight for r in graph.author_citation_links(p, e).collect()} == {("author:ann lee", "author:bo li"): 1, ("author:ann lee", "author:cy ng"): 1, ("author:bo li", "author:cy ng"): 1}
    summary = {r.id: (r.references_out, r.citations_in, r.research_links) for r in library.citation_summary(p, e).collect()}
    assert summary == {"a": (2, 1, 1), "b": (0, 1, 1), "c": (1, 0, 0)}
    ranked = {r.id: (r.column, r.row) for r in layout.ranked(graph.author_blocks(p), "coauthors").collect()}
    assert ranked == {"author:bo li": (0, 0), "author:ann lee": (1, 0), "author:cy ng": (1, 1)}


def test_filters(spark):
    p, t = papers(spark, LIBRARY), topics(spark, [("t1", "Sensor nets")])
    ids = lambda **f: {r.id for r in library.view(p, t, Filters(**f)).collect()}
    assert ids(query=" SENSOR ") == {"a"} and ids(query="t2") == {"a", "b"} and ids(year_min=2002) == {"b"} and ids(year_max=2002) == {"a"}
    assert ids(author="li") == {"a", "b"} and ids(focus_authors=("ANN LEE ",)) == {"a"} and ids(starred=True) == {"a"} and ids(topic="tag|x") == {"c"} and ids(topic="topic|t2|rest") == {"a", "b"}
    assert {r.id for r in library.view(p, t, Filters(year_max=1990), legacy_null_year=True).collect()} == {"c"}
    assert Filters(query="q", author="x", focus_topics=("a", "b")).active() == 2


def test_layers_with_a_cycle(spark):
    b = spark.createDataFrame([(x, x, 1) for x in "abcde"], "id string, name string, n_papers int")
    l = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("d", "e", 1), ("e", "d", 1), ("a", "a", 1)], "source string, target string, weight int")  # noqa: E741
    assert {r.id: r.level for r in layout.levels(b, l).collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None}
    assert {r.id: r.level for r in layout.hierarchy(b, l).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 1}
    once, again = ({(r.id, r.x, r.y) for r in layout.gravity(b, l).collect()} for _ in range(2))
    assert once == again and len(once) == 5


def test_components_over_a_long_chain_and_a_hot_key(spark):
    pairs = [(f"{k:03}", f"k{k}") for k in range(200)] + [(f"{k + 1:03}", f"k{k}") for k in range(199)] + [(f"x{k}", "hot") for k in range(300)] + [("z", None)]
    got = {r.item: r.component for r in components.components(spark.createDataFrame(pairs, "item string, key string")).collect()}
    assert {got[f"{k:03}"] for k in range(200)} == {"000"} and {got[f"x{k}"] for k in range(300)} == {"x0"} and "z" not in got


def ref(**f):
    names = ["index", "label", "rawText", "title", "authors", "year", "venue", "doi", "arxivId", "semanticScholarId", "openAlexId", "url", "pageStart", "pageEnd", "confidence", "source", "reviewed", "canonicalReference", "resolution"]
    return tuple((dict.fromkeys(names) | f)[n] for n in names)


def canonical(**f):
    return tuple((dict.fromkeys(["doi", "semanticScholarId", "arxivId", "openAlexId", "title", "year"]) | f).values())


TITLE = "An uncommonly long and distinctive title about lake plankton samples"


def infer(spark, refs, targets, existing=()):
    rows = [{"id": "s", "title": "Source", "extractedReferences": refs}, *targets]
    return {(r.source, r.target): r.referenceResolution.matchedBy for r in reconcile.inferred_edges(papers(spark, rows), edges(spark, existing)).collect()}


def test_reconciliation(spark):
    t = {"id": "t", "title": TITLE, "authors": ["Ann Lee"], "year": 2001, "doi": "10.1234/abc", "semanticScholarId": "S1"}
    yes = ("s", "t")
    assert yes in infer(spark, [ref(reviewed=None, canonicalReference=canonical(doi="10.1234/ABC"))], [t])
    assert infer(spark, [ref(reviewed=True, canonicalReference=canonical(doi="10.9/no", semanticScholarId="S1"))], [t]) == {}
    assert yes in infer(spark, [ref(reviewed=True, canonicalReference=canonical(semanticScholarId="s1"))], [t])
    assert infer(spark, [ref(reviewed=False, canonicalReference=canonical(doi="10.1234/abc"))], [t]) == {}
    assert infer(spark, [ref(reviewed=True, canonicalReference=canonical(doi="10.1234/abc"))], [t, t | {"id": "u"}]) == {}
    assert infer(spark, [ref(reviewed=True, canonicalReference=canonical(doi="10.1234/abc"))], [t], [("s", "t", None, None)]) == {}
    assert infer(spark, [ref(reviewed=None, doi="10.1234/abc")], [t]) == {}
    assert infer(spark, [ref(reviewed=True, doi="10.1234/abc")], [t])[yes] == "local-doi"
    assert infer(spark, [ref(reviewed=True, doi="10.1234/ab", rawText="Lee. x. doi:10.1234/ abc.")], [t])[yes] == "local-doi-text"
    assert infer(spark, [ref(reviewed=True, rawText="doi:10.1234/abcd")], [t]) == {}
    glued = "Lée, A. An uncommonly long and dis- tinctive title aboutlake plankton samples. 2001."
    assert infer(spark, [ref(reviewed=True, rawText=glued)], [t])[yes] == "local-title-author-year"
    assert infer(spark, [ref(reviewed=True, rawText=glued)], [t | {"year": None}])[yes] == "local-title-author"
    for bad in (glued.replace("2001", "1999"), glued.replace("Lée", "Moe"), glued.replace("2001", ""), glued.replace("plankton", "")):
        assert infer(spark, [ref(reviewed=True, rawText=bad)], [t]) == {}
    assert infer(spark, [ref(reviewed=True, rawText=glued, semanticScholarId="other")], [t]) == {}


def test_merging_references(spark):
    cells = papers(spark, [{"id": "s", "extractedReferences": [ref(doi="10.1/a", reviewed=False, title="old"), ref(doi="10.1/A", reviewed=True, year=2000), ref(), ref()]}])
    m = {r.key: (r.reviewed, r.title, r.year) for r in reconcile.merged_references(reconcile.references(cells)).collect()}
    assert m["doi:10.1/a"] == (True, "old", 2000) and len(m) == 3


def test_ordered_merge_sees_earlier_rows(spark):
    old = papers(spark, [{"id": "a", "title": "T", "year": 2000, "doi": "10.1/x", "notes": "mine"}]).select("id", "title", "year", "doi", "notes", "tags", "semanticScholarId", "arxivId", "authors")
    new = [("n1", "Other", 2001, None, "theirs", ["g"], "S", None, ["A B"]), ("n2", "Later", 2002, "10.1/X", "", None, "S", None, []), ("n3", "other", 2001, None, None, ["h"], None, None, None)]
    inc = spark.createDataFrame([(*r, k) for k, r in enumerate(new)], "id string, title string, year int, doi string, notes string, tags array<string>, semanticScholarId string, arxivId string, authors array<string>, ordinal bigint")
    got = {r.id: r for r in merge.merge_library(old, inc).collect()}
    assert set(got) == {"a", "n1"}
    assert got["a"].record.title == "Later" and got["a"].record.notes == "mine" and sorted(got["n1"].record.tags) == ["g", "h"] and got["n1"].merged == 2
    assert got["a"].incoming_ids == ["n2"]


def test_provider_merge():
    a = {"doi": "10.1/x", "title": "Short", "authors": ["A"], "citationCount": 0, "year": 2000}
    b = {"doi": "10.1/X", "title": "A longer title", "authors": ["A", "B"], "citationCount": 9, "venue": "V"}
    m = merge.merge_provider_rows([a, b, {"doi": "10.2/y", "title": "A much longer wrong title"}])
    assert m["title"] == "A longer title" and m["authors"] == ["A", "B"] and m["citationCount"] == 0 and m["venue"] == "V"
    assert R.same_work({"doi": "10.1/a", "title": "t", "year": 1}, {"title": "T!", "year": 1}) and not R.same_work({"title": "t"}, {"title": "t"})


def test_themes(spark):
    rows = [{"id": f"g{k}", "title": f"graph network nodes {w}", "year": 1990 + k} for k, w in enumerate(("alpha", "beta", "gamma"))] + [{"id": f"p{k}", "title": f"protein folding enzyme {w}", "year": 2020} for k, w in enumerate(("alpha", "delta"))] + [{"id": "empty"}]
    assigned, centroids = cluster.kmeans(papers(spark, rows), k=3)
    band = {r.id: r.band for r in assigned.collect()}
    assert len(band) == 6 and len({band[f"g{k}"] for k in range(3)}) == 1 and band["p0"] == band["p1"] != band["g0"]
    named = cluster.themes(assigned, centroids).collect()
    assert {r.theme for r in named} == {1, 2, 3} and any("graph" in r.label for r in named)
    cards = layout.timeline(papers(spark, rows), assigned).collect()
    assert len(cards) == 6 and len({(r.x, r.y) for r in cards}) == 6
    buckets = {r.year: r.bucket for r in layout.year_buckets(papers(spark, rows)).collect()}
    assert buckets == {1990: 0, 1991: 1, 1992: 2, 2020: 3}


def test_resolver(spark):
    refs = spark.createDataFrame([("r1", "[3] Lee. Deep graph models for lakes. 2001.", 2001), ("r2", "Nothing like it", None), ("r3", "", None)], "rid string, rawText string, year int")
    p = papers(spark, [{"id": "x", "title": "Deep Graph Models for Lakes", "authors": ["Ann Lee"], "year": 2001}, {"id": "y", "title": "Deep Graph Models for Rivers", "authors": ["Bo Liang"], "year": 2001}, {"id": "z", "title": "Deep Graph Models for Lakes", "authors": ["Ann Lee"], "year": 1999}])
    pairs = {(r.rid, r.paper_id): r.confidence for r in resolve.scored(refs, p).collect()}
    assert pairs == {("r1", "x"): 1.0}
    got = {r.rid: (r.status, r.paper_id) for r in resolve.decisions(refs, resolve.scored(refs, p)).collect()}
    assert got == {"r1": ("matched", "x"), "r2": ("unresolved", None), "r3": ("no-identifier", None)}


NUMBERED = "Body\nReferences\n[1] Ann Lee. A title. 2001. doi:10.1234/x.\nmore of the en-\ntry here\n[2] Bo Li. Another one, 2002. arXiv:2101.00001v2\n\nTrailing prose that is no reference"
DATED = "Bibliography:\nLee, A. (2001). A first title of\nsome length.\n\nLi, B. (2003). Second title.\nNg, Cy and Ode, D. Third\n2004, a venue\nBo Li, Cy Ng\nFourth title, 2010"


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, page int, width double, height double, text string, citation_text string")


def test_segmentation(spark):
    p = pages(spark, [("n", 1, 1.0, 1.0, NUMBERED, NUMBERED), ("n", 1, 1.0, 1.0, NUMBERED, NUMBERED), ("d", 1, 1.0, 1.0, DATED, DATED), ("e", 1, 1.0, 1.0, "no list", "no list"), ("z", 1, None, None, None, None)])
    got = {}
    for r in extract.references(p).orderBy("doc_id", "index").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.label, r.doi, r.arxivId, r.year, r.confidence) for r in got["n"]] == [("1", "10.1234/x", None, 2001, 0.99), ("2", None, "2101.00001v2", 2002, 0.97)]
    assert got["n"][0].rawText.endswith("more of the entry here") and "Trailing" not in got["n"][1].rawText
    assert len(got["d"]) >= 3 and set(got) == {"n", "d"}
    start = {r.doc_id: (r.page, r.line, r.heading) for r in extract.bibliography_start(extract.pages_once(p)).collect()}
    assert start == {"n": (1, 2, "References"), "d": (1, 1, "Bibliography")}


def test_two_columns():
    left = ["References", *[f"[{k}] Lee, A. Left title {k}. 2001." for k in range(1, 6)], "", ""]
    right = ["", *[f"[{k}] Li, B. Right title {k}. 2002." for k in range(6, 11)], "", ""]
    text = "\n".join(f"{a:<58}{b}" for a, b in zip(left, right)) + "\n" + "\n".join(f"{'[' + str(k) + '] tail':<58}{'more text to the right of it'}" for k in range(11, 13))
    lines, two = extract.reading_order(text)
    assert two and lines[1].startswith("[1]")
    assert len(extract.two_column([(1, text)])) >= 10


def test_front_matter():
    m = front_matter.front_matter("ANNALS OF LAKES    12\nDeep Graph Models for\nLake Plankton\nAnn Lee, Bo Li and Cy van Ng\nUniversity of Somewhere\nAbstract\nText 1999\n© 2021 The Authors. doi:10.1234/ABC")
    assert (m["title"], m["authors"], m["year"], m["doi"]) == ("Deep Graph Models for Lake Plankton", ["Ann Lee", "Bo Li", "Cy van Ng"], 2021, "10.1234/abc")
    assert front_matter.front_matter("", "name")["title"] == "name"


def test_quality(spark):
    e = spark.createDataFrame([("d", "e1", "Lee. A fine title about lakes."), ("d", "e2", "Li. Another title on rivers."), ("x", "e3", "Lee. A fine title about lakes.")], "doc_id string, eid string, text string")
    a = spark.createDataFrame([("d", "a1", "[1] Lee. A fine title about la kes"), ("d", "a2", "Lee. A fine title about lakes."), ("d", "a3", "unrelated words")], "doc_id string, aid string, text string")
    pairs = quality.gram_similarity(e, a).withColumn("page_match", F.lit(True))
    m = quality.greedy(pairs)
    assert {(r.eid) for r in m.collect()} == {"e1"} and m.count() == 1
    s = {r.doc_id: (r.matched, r.complete) for r in quality.reference_scores(e, a, m).collect()}
    assert s == {"d": (1, False), "x": (0, False)}
    rows = spark.createDataFrame([("i", ["a", "b", "c"], ["a", "c", "b"]), ("j", [], ["a"]), ("k", None, None)], "id string, actual array<string>, expected array<string>")
    got = {r.id: (round(r.f1, 3), round(r.order_coverage, 3)) for r in quality.author_scores(rows).collect()}
    assert got == {"i": (1.0, 0.667), "j": (0.0, 0.0), "k": (0.0, 0.0)}
    parts = spark.createDataFrame([("full", True, 1.0, 1.0, 1.0, None, 1.0), ("half", True, 1.0, 0.0, 0.0, 1.0, 0.0), ("bad", False, 1.0, 1.0, 1.0, 1.0, 1.0)], "id string, ok boolean, title double, authors double, year double, doi double, references double")
    assert {r.id: r.score for r in quality.rubric(parts).collect()} == {"full": 100.0, "half": 30.0, "bad": 0.0}


def test_schema_fields():
    assert fields(PAPER)[:3] == ["id", "citationKey", "title"] and json.dumps(fields(PAPER))


def test_topic_gravity_covers_papers_of_all_years(spark, monkeypatch):
    from folioplan.plans import maps

    rows = [("a", 1990, ["t1"]), ("b", None, ["t2"]), ("c", 2022, ["t3"])]
    p = spark.createDataFrame(rows, "id string, year int, topics array<string>").withColumn("starred", F.lit(False))
    monkeypatch.setattr(maps, "papers", lambda s, d: p)
    monkeypatch.setattr(maps, "topics", lambda s, d: topics(spark, [("t1", "Sensor nets")]))
    monkeypatch.setattr(maps, "edges", lambda s, d: spark.createDataFrame([("e", "c", "a")], "id string, source string, target string"))
    assert {r.id for r in maps.topic_gravity(spark, "").collect()} == {"t1", "t2", "t3"}
