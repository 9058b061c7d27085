import io
import json
import zipfile

import pytest

from folioplan.sources import archive, backup, bibtex, providers, sinks
from folioplan.streaming import streams

BIB = r"""
@article{key1, title={A {Nested} Title}, author={Lee, Ann and Bo Li}, year={2001x}, journal="A \"quoted\" Journal", keywords={a, b; c}, doi={https://doi.org/10.1/X}}
junk @inproceedings{key2,title = {No year}, booktitle={Conf}, broken, url={http://u}}
@misc{nokey}
@article{open, title={never ends
"""


def test_bibtex(spark):
    rows = bibtex.parse(spark.createDataFrame([(BIB,), (None,), ("",)], "value string")).orderBy("citationKey").collect()
    a, b = rows
    assert (a.id, a.title, a.authors, a.year, a.keywords, a.doi) == ("doi:10.1/x", "A Nested Title", ["Ann Lee", "Bo Li"], 2001, ["a", "b", "c"], "10.1/x")
    assert (b.id, b.venue, b.type, b.url) == ("bib:key2:unknown", "Conf", "inproceedings", "http://u")


def test_bibtex_export(spark):
    df = spark.createDataFrame([("i", None, "A Title", ["Ann Lee"], 2001, " ", "Conference Paper", None, None, "x {y}", ["k"], ["t"])], "id string, citationKey string, title string, authors array<string>, year int, venue string, type string, doi string, url string, abstract string, keywords array<string>, tags array<string>")
    text = bibtex.export(df).first().value
    assert text.startswith("@article{lee2001a-title,\n  title = {A Title},\n") and "venue" not in text and "x y" in text and "{k, t}" in text
    assert bibtex.parse(spark.createDataFrame([(text,)], "value string")).first().title == "A Title"


def test_backup(spark):
    text = json.dumps({"schemaVersion": 1, "papers": [{"id": "a", "title": "T", "year": 2000, "odd": {"k": 1}}], "edges": [{"id": "a->b", "source": "a", "target": "b"}], "topics": [], "meta": {"m": "1"}})
    t = backup.parse(spark.createDataFrame([(text,)], "value string"))
    p = t["papers"].first()
    assert (p.id, p.year, json.loads(p.extra)["odd"]) == ("a", 2000, '{"k":1}') and t["edges"].count() == 1 and t["meta"].first().value == "1"
    for bad in ('{"schemaVersion": 2, "papers": [], "edges": [], "topics": []}', '{"schemaVersion": 1, "papers": []}', "[1"):
        with pytest.raises(Exception, match="(?i)backup|version"):
            backup.parse(spark.createDataFrame([(bad,)], "value string"))["papers"].collect()


def test_single_papers(spark):
    one = lambda t: backup.parse_papers(spark.createDataFrame([(t,)], "value string")).collect()
    assert one('{"title": "T", "authors": ["A"]}')[0].title == one('{"schemaVersion": 1, "paper": {"title": "T"}}')[0].title == "T"
    for bad in ('{"papers": [], "title": "T"}', '{"paper": {"title": "T"}}', '{"title": " "}', '{"title": "T", "authors": "A"}', '{"schemaVersion": 3, "title": "T"}'):
        with pytest.raises(Exception):
            one(bad)


def test_archive_round_trip_and_checks(tmp_path):
    path = str(tmp_path / "a.zip")
    archive.write(path, [("k1", {"id": "a", "title": "T"}), ("k2", {"id": "b", "x": [1]})], [{"id": "a->b"}], [{"id": "t", "color": "red"}], {"m": 1}, {"a": b"%PDF-1"})
    got = archive.parse(open(path, "rb").read())
    assert got["papers"] == [("k1", {"id": "a", "title": "T"}), ("k2", {"id": "b", "x": [1]})] and got["topics"][0]["color"] == "red" and got["pdfs"] == {"a": b"%PDF-1"}

    def made(**files):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for n, c in files.items():
                z.writestr(n.replace("__", "."), c)
        return buf.getvalue()

    meta = lambda **k: json.dumps({"archiveVersion": 3, "papers": [], "edges": [], "topics": [], "meta": {}} | k)
    paper = {"id": "a"}
    for bad in (
        b"no zip", made(x__txt="1"), made(metadata__json=meta(archiveVersion=9)), made(metadata__json=meta(archiveVersion=2)), made(metadata__json=meta(papers=[{"key": ".bad", "paper": paper}])),
        made(metadata__json=meta(papers=[{"key": "K", "paper": paper}, {"key": "k", "paper": paper}])), made(metadata__json=meta(), other__pdf="%PDF"), made(metadata__json=meta(papers=[{"key": "k", "paper": paper}]), k__pdf="nope"),
        made(metadata__json=meta(papers=[{"key": "k", "paper": paper}]), library__bib="@a{z,title={T}}"),
    ):
        with pytest.raises(ValueError):
            archive.parse(bad)


def test_archive_keys(spark):
    rows = [("1", "Same Key", "t", ["A B"], 2000), ("2", "same-key", "t", ["A B"], 2000), ("3", "same-key-2", "t", ["A B"], 2000), ("4", None, "A Title of Words here", ["Ann Lee"], 2001), ("5", "", "漢字", None, None)]
    got = {r.id: r.key for r in archive.assigned_keys(spark.createDataFrame(rows, "id string, citationKey string, title string, authors array<string>, year int")).collect()}
    assert got["1"] == "Same-Key" and got["4"] == "Lee-2001-A-Title-of-Words" and len({k.lower() for k in got.values()}) == 5


def test_providers(spark, tmp_path):
    s2 = {"paperId": "p1", "title": "T", "externalIds": {"DOI": "10.1/X"}, "authors": [{"name": "A"}, {"name": None}], "year": 2001, "citationCount": None}
    oa = {"id": "https://openalex.org/W7", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "concepts": [{"display_name": "C", "score": 0.5}, {"display_name": "D", "score": 0.1}], "locations": [{"landing_page_url": "https://arxiv.org/abs/2101.00001"}]}
    cr = {"DOI": "10.2/Y", "title": ["T"], "author": [{"given": "Ann", "family": "Lee"}], "issued": {"date-parts": [[1999, 2]]}, "abstract": "<p>x</p>", "reference": [{"key": "r", "DOI": "10.3/Z"}, {"unstructured": "Text"}, {}]}
    df = lambda v: spark.createDataFrame([(json.dumps(v),)], "value string")
    a, b, c = providers.semantic_scholar(df(s2)).first(), providers.open_alex(df(oa)).first(), providers.crossref(df(cr)).first()
    assert (a.id, a.authors, a.citationCount) == ("doi:10.1/x", ["A"], None)
    assert (b.id, b.openAlexId, b.abstract, b.topicNames) == ("arxiv:2101.00001", "W7", "a b a", ["C"])
    assert (c.id, c.authors, c.year, c.abstract) == ("doi:10.2/y", ["Ann Lee"], 1999, "x")
    assert [(r.label, r.confidence) for r in providers.crossref_references(df(cr)).orderBy("index").collect()] == [("r", 0.98), ("2", 0.65)]
    (tmp_path / "p1.json").write_text(json.dumps({"data": [s2, s2, s2]}))
    (tmp_path / "p2.json").write_text(json.dumps([s2]))
    assert providers.saved_pages(spark, str(tmp_path), limit=2).count() == 3
    models = {"data": [{"id": "m-10"}, {"id": "m-9"}, {"name": "m-9"}]}
    assert [r.id for r in providers.model_ids(df(models)).collect()] == ["m-9", "m-10"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    assert {tuple(r) for r in sinks.upsert(old, new).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in sinks.insert_missing(old, new).collect()} == {("c", 4)}
    t = sinks.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    for _ in range(2):
        t.upsert(old)
        t.upsert(new)
    assert {tuple(r) for r in t.read().collect()} == {("a", 1), ("b", 3), ("c", 4)} and t.version() == 4


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("SELECT id % 3 AS user_id, timestamp_seconds(id) AS ts, IF(id % 5 = 0, 'error', 'view') AS event_type, CAST(id % 2 AS DOUBLE) AS value FROM range(400)").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    table = sinks.VersionedTable(spark, out)
    for k in range(2):  # a second run of the same input changes nothing
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).foreachBatch(streams.upserts(table, "user_id", "ts")).start()
        q.awaitTermination()
    assert {(r.user_id, r.ts.timestamp()) for r in table.read().collect()} == {(0, 399.0), (1, 397.0), (2, 398.0)}
    rows = []
    q = streams.activity_ring(stream, 50).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ring")).trigger(availableNow=True).foreachBatch(lambda b, _: rows.extend(b.collect())).start()
    q.awaitTermination()
    assert {r.n_kept for r in rows} == {50} and {r.newest for r in rows} == {397_000_000, 398_000_000, 399_000_000}
