import datetime as dt

from folioplan.llm import survivors

SCHEMA = "id string, doi string, semanticScholarId string, openAlexId string, arxivId string, abstract string, venue string, citationCount bigint, source string, updatedAt timestamp, importedAt timestamp, title string, group_id string"
FULL = "One two three four five six seven. Eight nine ten eleven twelve thirteen."


def row(i, doi=None, s2=None, ax=None, abstract=None, venue=None, count=None, source=None, updated=None, imported=None):
    day = lambda n: dt.datetime(2020, 1, n) if n else None
    return (i, doi, s2, None, ax, abstract, venue, count, source, day(updated), day(imported), "t", "clash")


def run(spark, rows, **options):
    papers = spark.createDataFrame(rows, SCHEMA)
    trust = spark.createDataFrame([("crossref", 1), ("pdf", 4), (None, 2)], "source string, trust_rank int")
    return {(r.group_id, r.field): r.paper_id for r in survivors.survivors(papers, trust, **options).collect()}


def test_fields_survive_by_their_rules(spark):
    rows = [
        row("a", doi="10.1/X", abstract=FULL[:40] + " [truncated]", venue="Ann. Sig. Geom.", count=5, source="pdf ", updated=3),
        row("b", doi="https://doi.org/10.1/x", abstract=FULL, venue="Preprint", count=9, source=None, imported=9),
        row("c", doi="doi:10.1/x.", abstract="n/a", venue="Annals of Signal Geometry", count=-1, source="CROSSREF", updated=20),
        row("d", doi="10.1/x", abstract="Skip to main content. This page uses cookies to remember you.", venue="ASG", count=None, source="ai"),
    ]
    assert run(spark, rows) == {("a", "abstract"): "b", ("a", "venue"): "c", ("a", "citationCount"): "b", ("a", "source"): "c"}


def test_chains_versions_and_placeholders(spark):
    rows = [row("a", doi="10.1/x"), row("b", doi="10.1/x", ax="arXiv:1020.00001v2"), row("c", ax="1020.00001", s2="f" * 40), row("d", s2="F" * 40, source="pdf"), row("e", doi="n/a"), row("f", doi="N/A "), row(None, doi="10.1/x"), row("g")]
    assert run(spark, rows) == {("a", "source"): "d"}


def test_no_usable_value_gives_no_row_and_ties_fall_to_the_smaller_id(spark):
    rows = [row("b", doi="10.1/x", abstract=FULL, count=3, updated=2), row("a", doi="10.1/x", abstract=FULL, count=3, updated=2), row("a", doi="10.1/x", abstract=FULL, count=3, updated=2)]
    assert run(spark, rows) == {("a", "abstract"): "a", ("a", "citationCount"): "a"}


def test_hot_group_in_blocks(spark):
    rows = [row(f"p{k:03}", doi="10.1/hot", abstract=" ".join(FULL.split()[: 4 + k % 9]) + "…", count=k, updated=1 + k % 27) for k in range(150)] + [row("q", doi="10.1/hot", abstract=FULL)]
    got = run(spark, rows, block=4)
    assert got["p000", "abstract"] == "q"


def test_consensus_outvotes_a_misprint():
    texts = ["the quick brown fox jumps.", "the quick brwon fox jumps.", "the quick brown fox jumps."]
    tokens, *_ = survivors.consensus([(t.split(), [1.0] * 5, 1.0, False) for t in texts])
    assert tokens == "the quick brown fox jumps.".split()
    assert survivors.distance(texts[1].split(), tokens) == 1 and survivors.distance(texts[0].split(), tokens) == 0
    assert survivors.distance("J. Comput. Pal.".split(), "Journal of Computational Palaeography".split()) < 4


def test_empty_tables(spark):
    assert run(spark, []) == {}


def test_wide_alignments_are_exact(monkeypatch):
    import random

    rng = random.Random(1)
    words = ["a", "b", "Comput.", "Computational", "c.", "c", "cat", "Cat.", "d", "A"]

    def score(path, x, y):
        return sum(-1 if i is None or j is None else 2 if survivors._same(x[i], y[j]) else -1 for i, j in path)

    for _ in range(40):
        x, y = ([rng.choice(words) for _ in range(rng.randint(33, 60))] for _ in range(2))
        small = survivors._small(x, y, 0, 0)
        assert survivors._table(x, y, 0, 0) == small
        monkeypatch.setattr(survivors, "CELLS", 50)
        halved = survivors._best_path(x, y, 0, 0)
        monkeypatch.undo()
        assert score(halved, x, y) == score(small, x, y)
        assert [i for i, _ in halved if i is not None] == list(range(len(x))) and [j for _, j in halved if j is not None] == list(range(len(y)))


def test_a_text_that_different_works_share_is_nobodys_abstract(spark):
    def group(k, title):
        return [(*row(f"{k}{x}", doi=f"10.1/{k}", abstract=FULL)[:-2], title, "clash") for x in "ab"]

    one_work = [r for k in range(8) for r in group(k, "One title in eight groups that no identifier joins")]
    assert len(run(spark, one_work)) == 8
    others = [r for k in range(3) for r in group(k, f"{'XYZ'[k]} title of its own")]
    assert run(spark, others) == {}
