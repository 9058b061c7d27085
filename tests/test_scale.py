"""What must hold at any size: hot groups, other physical ways with equal results, loops that end or say so."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioplan.operators import cluster, layout, library, merge, ranking, reconcile, resolve
from folioplan.sources import archive, demo


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_numbers_by_parts_are_those_of_one_window(spark, by):
    rows = [("hot" if k % 3 else None if k % 2 else f"g{k % 7}", k % 2, (k * 7919) % 501, k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, h int, v int, id int").repartition(5)
    order = [F.desc("v"), F.col("id")]
    want = {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).collect()}
    for most in (10**6, 40):
        assert {r.id: r.n for r in ranking.numbered(df, by, order, "n", most).collect()} == want


def test_a_column_with_most_of_the_blocks_is_ranked_by_parts(spark, monkeypatch):
    blocks = spark.createDataFrame([(f"a{k:03}", f"n{k % 5}", k % 4, 0 if k % 3 else k) for k in range(300)], "id string, name string, n_papers int, coauthors int")
    want = {(r.id, r.column, r.row) for r in layout.ranked(blocks, "coauthors").collect()}
    monkeypatch.setattr(ranking.numbered, "__defaults__", (20,))
    assert {(r.id, r.column, r.row) for r in layout.ranked(blocks, "coauthors").collect()} == want
    assert len(want) == 300 and max(c for _, c, _ in want) == 99


def test_archive_keys_of_one_name_by_parts(spark, monkeypatch):
    rows = [(f"p{k:03}", "Same" if k % 2 else "same", "t", ["A B"], 2000) for k in range(60)] + [("q", "same-2", "t", None, None)]
    df = spark.createDataFrame(rows, "id string, citationKey string, title string, authors array<string>, year int")
    want = {r.id: r.key for r in archive.assigned_keys(df).collect()}
    assert len({k.lower() for k in want.values()}) == 61
    monkeypatch.setattr(ranking.numbered, "__defaults__", (10,))
    assert {r.id: r.key for r in archive.assigned_keys(df).collect()} == want


def test_themes_by_joins_are_those_by_matrix(spark):
    words = ["graph", "network", "lake", "plankton", "protein", "enzyme", "tram", "ticket"]
    rows = [(f"p{k:02}", " ".join(words[(k % 4) * 2 : (k % 4) * 2 + 2] + [f"w{k % 5}x", f"v{k}y"]), None if k % 3 else [words[k % 8]], "") for k in range(40)] + [("z", "", None, None)]
    p = spark.createDataFrame(rows, "id string, title string, keywords array<string>, abstract string")
    a, ca = cluster.kmeans(p, k=4)
    b, cb = cluster.kmeans(p, k=4, most=0)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()} and a.count() == 41
    cell = lambda c: {(r.band, r.term): round(r.w, 9) for r in c.collect() if abs(r.w) > 1e-12}
    assert cell(ca) == cell(cb)
    none = spark.createDataFrame([], "id string, title string, keywords array<string>, abstract string")
    assert cluster.kmeans(none)[0].count() == cluster.kmeans(none)[1].count() == 0


def test_levels_say_so_when_a_path_is_too_long(spark):
    blocks = spark.createDataFrame([(f"b{k}",) for k in range(6)], "id string")
    links = spark.createDataFrame([(f"b{k}", f"b{k + 1}") for k in range(4)] + [("b5", "b5")], "source string, target string")
    assert {r.id: r.level for r in layout.levels(blocks, links).collect()} == {"b0": 0, "b1": 1, "b2": 2, "b3": 3, "b4": 4, "b5": 0}
    with pytest.raises(RuntimeError):
        layout.levels(blocks, links, max_rounds=2)


def test_pages_of_a_list(spark):
    df = spark.createDataFrame([(k,) for k in range(25)], "id int").repartition(4)
    page = lambda at: [(r.id, r.next) for r in library.page_of(df, [F.desc("id")], at, 10).collect()]
    assert page(0) == [(k, 10) for k in range(24, 14, -1)] and page(20) == [(k, None) for k in range(4, -1, -1)] and page(30) == []


def test_candidates_are_cut_per_provider_before_they_meet(spark):
    w = spark.createDataFrame([(p, k, "hot") for p in "ab" for k in range(50)] + [("a", 99, "")], "provider string, ordinal int, k string")
    q = spark.createDataFrame([("q1", "hot"), ("q2", "cold"), ("q3", "")], "query_id string, k string")
    got = {(r.query_id, r.provider, r.ordinal) for r in merge.united_candidates(q, w, 3).collect()}
    assert got == {("q1", p, k) for p in "ab" for k in range(3)}
    assert merge.united_candidates(q, w, 500).count() == 40 and merge.united_candidates(q, w, 0).count() == 2


def test_reference_sets_keep_resolutions(spark):
    schema = "source_id string, ordinal int, doi string, arxivId string, semanticScholarId string, openAlexId string, title string, year int, rawText string, resolution string"
    rows = [("p", 0, "10.1/X", None, None, None, "Old", 2000, "a", "kept"), ("p", 1, None, None, None, None, None, None, None, None), ("p", 2, "doi:10.1/x", None, None, None, "New", None, None, None), ("q", 3, "10.1/x", None, None, None, None, None, None, None)]
    got = {(r.source_id, r.ordinal): (r.title, r.year, r.resolution) for r in reconcile.merged_reference_records(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("p", 0): ("New", 2000, "kept"), ("p", 1): (None, None, None), ("q", 3): (None, None, None)}


def test_review_searches(spark):
    rows = [("A  title", " https://doi.org/10.1234/Ab ", "x", "doi"), ("t", "10.1/x", "", "doi"), ("t", "", "arXiv:2101.00001v2", "arxiv"), (" ", None, None, "title"), ("A  b", None, None, "title")]
    df = spark.createDataFrame(rows, "title string, doi string, arxiv string, kind string")
    got = [tuple(r.q) for r in df.select(resolve.online_query(*[F.col(c) for c in df.columns]).alias("q")).collect()]
    assert got == [("doi", "10.1234/ab", None), ("doi", None, "doi"), ("arxiv", "2101.00001v2", None), ("title", None, "title"), ("title", "A b", None)]


def test_the_bundled_library(spark):
    p, e, t = demo.library(spark)
    assert (p.count(), e.count(), t.count()) == (8, 9, 5)
    assert e.join(p.select(F.col("id").alias("source")), "source").count() == 9 and json.dumps(demo.TOPICS)



@pytest.mark.parametrize("strict", [True, False])
def test_merging_by_components_is_one_fold_over_all(spark, strict):
    import random

    import pandas as pd

    rng = random.Random(4)
    schema = "id string, title string, year int, doi string, notes string, tags array<string>, semanticScholarId string, arxivId string, authors array<string>"

    def row(k, side):
        title = rng.choice(["Editorial", "Lakes", "Rivers", "Trams"] + ([] if strict else [""]))
        return (f"{side}{k}", title, rng.choice([None, 2000, 2001]), rng.choice([None, "", "10.1/a", "10.1/b", f"10.2/{k}"]), None, None, rng.choice([None, None, "s1"]), rng.choice([None, None, "2101.00001"]), None)

    old, new = [row(k, "e") for k in range(25)], [row(k, "n") for k in range(40)]
    e = spark.createDataFrame(old, schema)
    i = spark.createDataFrame([(*r, k) for k, r in enumerate(new)], schema + ", ordinal int")
    got = {r.id: (r.record.title, r.record.year, r.record.doi, r.merged, sorted(r.incoming_ids)) for r in merge.merge_library(e, i, strict).collect()}
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [(False, 0, r[0], json.dumps(dict(zip(names, r)))) for r in old] + [(True, k, r[0], json.dumps(dict(zip(names, r)))) for k, r in enumerate(new)]
    whole = merge._fold(pd.DataFrame(rows, columns=["incoming", "ordinal", "id", "record"]))
    want = {r.id: ((x := json.loads(r.record)).get("title"), x.get("year"), x.get("doi"), r.merged, sorted(r.incoming_ids)) for r in whole.itertuples()}
    assert got == want
