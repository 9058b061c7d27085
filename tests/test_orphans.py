import datetime as dt
import random

from folioplan.operators import orphans

T = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n) if n is not None else None


def tables(spark, papers, edges, topics=(), gone=()):
    p = spark.createDataFrame(papers, "id string, topics array<string>, importedAt timestamp, createdAt timestamp, key string")
    e = spark.createDataFrame(edges, "id string, source string, target string, createdAt timestamp, ns string")
    t = spark.createDataFrame(list(topics), "id string, createdAt timestamp")
    g = spark.createDataFrame(list(gone), "paper_id string, deleted_at timestamp")
    return p, e, t, g


def found(spark, papers, edges, topics=(), gone=(), **options):
    p, e, t, g = tables(spark, papers, edges, topics, gone)
    rows = orphans.orphan_references(orphans.references(e, p), orphans.parents(p, t, g), **options).collect()
    return {(r.ref_table, r.ref_id, r.ref_field, r.ref_key): r.reason for r in rows}


def test_cases(spark):
    papers = [("A", ["t1 ", "t9", None, ""], T(1), T(0), "x"), ("b", None, None, T(5), "x"), ("c", [], T(2), T(2), "x"), ("c", [], T(30), T(2), "x"), (None, None, None, None, "x"), (" ", [], None, None, "x")]
    edges = [
        ("a->b", " a", "B ", T(9), "x"), ("e1", "a", "zz", T(9), "x"), ("early", "b", "a", T(3), "x"), ("never early", "b", "a", None, "x"), ("a->gone", None, " ", T(9), "x"),
        ("relation:extends:a->c", "", None, T(9), "x"), ("twice", "b", "a", T(9), "x"), ("twice", "b", "a", T(4), "x"), ("blank", None, "", T(1), "x"),
    ]
    gone = [("b ", T(6)), ("C", T(10)), ("C", T(20)), ("nobody", T(1)), (None, T(1))]
    got = found(spark, papers, edges, [("T1", T(2)), (None, T(0))], gone)
    assert got == {
        ("edges", "a->b", "target", "B "): "deleted", ("edges", "e1", "target", "zz"): "missing", ("edges", "early", "source", "b"): "deleted", ("edges", "never early", "source", "b"): "deleted",
        ("edges", "a->gone", "target", "gone"): "missing", ("edges", "twice", "source", "b"): "deleted", ("papers", "A", "topics", "t1 "): "early", ("papers", "A", "topics", "t9"): "missing",
    }


def test_agrees_with_brute_force_whatever_the_ranges(spark):
    rng = random.Random(4)
    papers = [(f"p{rng.randint(0, 60)}", [f"t{rng.randint(0, 9)}"], rng.choice([None, T(rng.randint(0, 90))]), T(rng.randint(0, 90)), "x") for _ in range(120)]
    hot = "p7"
    edges = [(f"e{k}", rng.choice([hot, f"P{rng.randint(0, 90)}"]), f"p{rng.randint(0, 90)}", rng.choice([None, T(rng.randint(0, 90))]), "x") for k in range(600)]
    gone = [(f"p{rng.randint(0, 60)}", T(rng.randint(0, 90))) for _ in range(20)]
    topics = [(f"T{k}", T(k * 9)) for k in range(7)]
    first, last, dead = {}, {}, {}
    for i, _, m, c, _ in papers:
        at = m or c
        first[i], last[i] = min(first.get(i, at), at), max(last.get(i, at), at)
    for i, at in gone:
        dead[i] = max(dead.get(i, at), at)
    want = {}
    for i, s, t, at, _ in edges:
        for f, k in (("source", s), ("target", t)):
            key = k.lower()
            if key not in first:
                want["edges", i, f, k] = "missing"
            elif key in dead and dead[key] > last[key]:
                want["edges", i, f, k] = "deleted"
            elif at and first[key] > at:
                want["edges", i, f, k] = "early"
    by_topic = {t.lower(): at for t, at in topics}
    for i, ts, _, _, _ in papers:
        for t in ts:
            if t not in by_topic:
                want["papers", i, "topics", t] = "missing"
            elif by_topic[t] > first[i]:
                want["papers", i, "topics", t] = "early"
    assert found(spark, papers, edges, topics, gone) == found(spark, papers, edges, topics, gone, range_keys=5, batch_refs=40) == want


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    assert set(found(spark, [], [("a->b", "a", "b", None, "x")]).values()) == {"missing"}
    p, e, t, g = tables(spark, [], [("a->b", "a", "b", T(40), "x")])
    refs = orphans.references(e, p)
    rows = orphans.report(orphans.orphan_references(refs, orphans.parents(p, t, g)), refs).collect()
    assert {(r.ref_field, r.month, r.n_references, r.n_missing) for r in rows} == {("source", "2020-02", 1, 1), ("target", "2020-02", 1, 1)}
