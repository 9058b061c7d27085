from folioplan.llm import scans as S

WORDS = (
    "Prior robust systems treat symbolic search and error propagation as separate stages. The library keeps both versions until a curator decides. Results under tight memory budgets remain stable when references are removed. "
    "Existing work on matrix factorisation assumes clean input, yet mathematical proof libraries are rarely complete. We study density estimation for grain market prices. One federated variant was trained on graph based data. "
    "Many entries cite museum accession ledgers twice, once under an older title. Published 2011 by Kibredi."
)
PAPERS = [(f"p{k}", "A title", WORDS, None, None, "10.5555/ab.c1d2", ["Eamon Kibredi"], None) for k in range(30)]
PAGES = [
    ("pdf:a", 1, "12    EAMON KIBREDI ET AL.\nMatrix Factorisation for Grain Market Prices\nEamon Kibredi\n\nPrior robust systerns treat symbolic search and error prop-\nagation as separate stages. The 1ibrary keeps both\nversions until a curator decides. Results under tightmemory\nbudgets rem ain stable when references are\n- 1 -"),
    ("pdf:a", 2, "JOURNAL OF GRAIN MARKETS\nremoved. Existing work on matrix factorisation assumes clean in­\nput, yet mathematical proof libraries are rarely com-\nScanned from the reading room copy, not for resale\n[2]"),
    ("pdf:a", 3, "JOURNAL OF GRAIN MARKETS\nplete. We study density estimation. One federated variant\nwas trained on graph-\nbased data. Published 20l1 by Kibrcdi. Short- and long-\nonce under an older title. doi:10.5555/ab.cld2\n\n[3]"),
    ("pdf:a", 3, "JOURNAL OF GRAIN MARKETS\nplete. We study density estimation. One federated variant\nwas trained on graph-\nbased data. Published 20l1 by Kibrcdi. Short- and long-\nonce under an older title. doi:10.5555/ab.cld2\n\n[3]"),
    ("pdf:a", 4, None), ("pdf:b", 1, ""), (None, 1, "x"), ("pdf:b", None, "y"),
]
DRAFTS = [("pdf:a", 1, [(3, "was trained on graph-"), (3, "[3]"), (3, "based data. Published 20l1 by Kibrcdi. Short- and long-")]), ("pdf:a", 2, None), ("pdf:a", 3, []), ("pdf:a", 4, [(None, None)])]


def tables(spark, pages=PAGES, drafts=DRAFTS, papers=PAPERS):
    p = spark.createDataFrame([(*x, "clash") for x in pages], "doc_id string, page int, text string, kind string")
    d = spark.createDataFrame(drafts, "doc_id string, draft_no int, lines array<struct<page:int,text:string>>")
    c = spark.createDataFrame(papers, "id string, title string, abstract string, venue string, publisher string, doi string, authors array<string>, keywords array<string>")
    return p, d, c


def found(spark, *args, **options):
    return {(r.src, r.doc_id, r.item_no, r.line_no, r.kind) for r in S.noise(*tables(spark, *args), **options).collect()}


WANT = {
    ("pdf_pages", "pdf:a", p, k, kind)
    for p, k, kind in [
        (1, 0, "furniture"), (1, 8, "furniture"), (2, 0, "furniture"), (2, 3, "furniture"), (2, 4, "furniture"), (3, 0, "furniture"), (3, 6, "furniture"),
        (1, 4, "broken"), (2, 1, "broken"), (2, 2, "broken"), (3, 2, "broken"),
        (1, 4, "misread"), (1, 5, "misread"), (1, 6, "misread"), (1, 7, "misread"), (3, 3, "misread"), (3, 4, "misread"),
    ]
}


def test_pages(spark):
    got = {x for x in found(spark) if x[0] == "pdf_pages"}
    # "long-" goes on in "once" or stands for a word to come: either reading is one.
    assert got - {("pdf_pages", "pdf:a", 3, 3, "broken")} == WANT


def test_drafts_share_the_furniture_of_their_pages(spark):
    got = {x[3:] for x in found(spark) if x[0] == "reference_drafts" and x[2] == 1}
    assert {(1, "furniture"), (0, "broken"), (2, "misread")} <= got


def test_a_small_broadcast_lexicon_changes_nothing(spark):
    assert found(spark, common=5) == found(spark)


def test_paragraphs_read_on(spark):
    rows = {(r.src, r.item_no): r.text for r in S.paragraphs(*tables(spark)).collect() if r.doc_id == "pdf:a"}
    text = " ".join(r.text for r in S.paragraphs(*tables(spark)).orderBy("item_no", "para_no").collect() if r.doc_id == "pdf:a" and r.src == "pdf_pages")
    for good in ("robust systems treat", "error propagation as", "The library keeps", "tight memory budgets remain stable", "Published 2011 by Kibredi", "10.5555/ab.c1d2"):
        assert good in text, good
    assert "ET AL" not in text and "resale" not in text and rows


def test_empty_tables_and_no_clean_paper(spark):
    assert found(spark, [], []) == set()
    got = found(spark, PAGES, [], [])
    assert ("pdf_pages", "pdf:a", 2, 3, "furniture") in got and ("pdf_pages", "pdf:a", 3, 3, "misread") in got


def test_clean_text_has_no_misreadings(spark):
    clean = [("pdf:c", 1, WORDS.replace(". ", ".\n"))]
    assert {x for x in found(spark, clean, []) if x[4] == "misread"} == set()


def test_skeletons_meet_what_scanners_confuse():
    for a, b in (("systems", "systerns"), ("modern", "modem"), ("clinic", "chnic"), ("title", "tifle"), ("cycle", "cyde"), ("computing", "compuüng"), ("library", "1ibrary"), ("robust", "robu5t"), ("study", "stiidy"), ("search", "seárch"), ("archive", "ar¢hive")):
        assert S.skeleton(a) == S.skeleton(b), (a, b)


def test_paragraphs_run_over_pages(spark):
    pages = [
        ("pdf:d", 1, "JOURNAL OF GRAIN MARKETS\nExisting work on matrix factorisation assumes clean input, yet mathe-\nmatical proof libraries are rarely com-\n- 1 -"),
        ("pdf:d", 2, "JOURNAL OF GRAIN MARKETS\nplete. We study density estimation for grain market prices under tight\nmemory budgets and the library keeps both versions until\n- 2 -"),
        ("pdf:d", 3, "JOURNAL OF GRAIN MARKETS\na curator decides.\n\nMany entries cite museum accession ledgers twice.\n- 3 -"),
    ]
    got = [(r.item_no, r.para_no, r.text) for r in S.paragraphs(*tables(spark, pages, [])).orderBy("item_no", "para_no").collect()]
    whole = "Existing work on matrix factorisation assumes clean input, yet mathematical proof libraries are rarely complete. We study density estimation for grain market prices under tight memory budgets and the library keeps both versions until a curator decides."
    assert got == [(1, 0, whole), (3, 0, "Many entries cite museum accession ledgers twice.")]


def test_a_paragraph_may_have_any_number_of_lines():
    lines = [f"line {k} of one paragraph that goes on and on over all the lines of" for k in range(150)]
    lines += ["a page and ends here.", "", "Another one begins after a blank line and is a paragraph by itself, too."]
    page = S.Page(lines, [False] * len(lines), None, S.Lexicon([], 1, 1))
    page.decode()
    assert len(page.paragraphs()) == 2


def test_boundaries_depend_on_whole_paragraphs():
    def paragraphs(lines):
        page = S.Page(lines, [False] * len(lines), None, S.Lexicon([], 1, 1))
        page.decode()
        return page.paragraphs()

    # A short line that ends a sentence ends a paragraph among long lines, not among lines as short as itself.
    wide = ["The first line of these is as wide as the measure of the whole page is.", "Its end comes early.", "The next line is again as wide as the measure of the page, or nearly so."]
    narrow = ["The first line is short.", "Its end comes early too.", "The next one is as short."]
    assert len(paragraphs(wide)) == 2 and len(paragraphs(narrow)) == 1


def test_hyphens_are_options_of_the_decoding():
    lex = S.Lexicon([(w, n, S.skeleton(w)) for w, n in (("propagation", 40), ("graph", 50), ("based", 60), ("-based", 30), ("and", 900), ("range", 40), ("short", 50))], 5000, 100)
    read = lambda a, b, h=S.HYPHENED: [(words, kind) for _, _, words, kind in S.readings([a, b], [False, False], [h, S.PLAIN], lex)]
    assert read("prop", "agation") == [(["propagation"], "word")]
    assert read("pr0p", "agation") == [(["propagation"], "word")]
    assert read("graph", "based") == [(["graph", "based"], "compound")]
    assert read("short", "and") == []
    assert read("graph", "based", S.SOFT) == [(["graphbased"], "word")]
