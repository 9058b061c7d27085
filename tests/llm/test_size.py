"""What must hold of memory and disk where tables are large."""

import hashlib
import os

import pandas as pd

from folioplan import compat
from folioplan.llm import linkage as L
from folioplan.llm import scans as S


def folder(spark):
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")


def stored(spark):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder(spark)) for f in files)


def test_wide_rows_become_python_objects_by_slices(spark):
    compat.prepare(spark)
    df = spark.range(0, 2100, 1, 1).selectExpr("id", "array(cast(id AS string), null) AS c")

    def run(frames):
        for b in frames:
            yield pd.DataFrame({"n": [len(b)], "first": [b["c"].iloc[0][0]]})

    got = [(r.n, r["first"]) for r in compat.by_slices(df, run, "n int, first string").collect()]
    assert got == [(500, "0"), (500, "500"), (500, "1000"), (500, "1500"), (100, "2000")]


def test_kept_tables_go_when_dropped(spark):
    df = compat.kept(spark.range(1000))
    at = df._kept.removeprefix("file:")
    assert df.count() == 1000 and os.path.isdir(at)
    compat.dropped(df)
    assert not os.path.exists(at)


def test_pages_are_kept_once_and_compressed(spark):
    words = "Prior robust systems treat symbolic search and error propagation as separate stages of the work"
    pages = [("pdf:a", k, "\n".join(f"{words} {k} {j}" for j in range(40))) for k in range(400)]
    p = spark.createDataFrame(pages, "doc_id string, page int, text string")
    d = spark.createDataFrame([], "doc_id string, draft_no int, lines array<struct<page:int,text:string>>")
    c = spark.createDataFrame([("p", "A title", words, None, None, None, None, None)], "id string, title string, abstract string, venue string, publisher string, doi string, authors array<string>, keywords array<string>")
    compat.prepare(spark)
    before = stored(spark)
    found = S.noise(p, d, c)
    assert stored(spark) - before < sum(len(t) for _, _, t in pages)
    assert {r.kind for r in found.collect()} <= {"furniture", "broken", "misread"}


def test_links_leave_nothing_but_the_links_on_disk(spark):
    title = lambda k: " ".join(hashlib.md5(f"{k}{j}".encode()).hexdigest()[:9] for j in range(6))
    p = spark.createDataFrame([(f"p{k}", title(k), [f"Jorin Zu{k}krebadim", "Orla Mirtorji"], 2000, None) for k in range(600)], "id string, title string, authors array<string>, year int, doi string")
    w = spark.createDataFrame([(f"w{k}", title(k), [f"J. Zu{k}krebadim"], 2001, None) for k in range(0, 600, 20)], "record_id string, title string, authors array<string>, year int, doi string")
    compat.prepare(spark)
    before = stored(spark)
    found = L.link(p, w, least=L.MATCH)
    assert {(r.paper_id, r.record_id) for r in found.collect()} == {(f"p{k}", f"w{k}") for k in range(0, 600, 20)}
    assert stored(spark) - before < 30_000
