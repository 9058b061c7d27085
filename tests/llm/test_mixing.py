import random

import pytest

from folioplan.llm import mixing
from folioplan.llm.queries import TOKENIZER


@pytest.mark.parametrize("seed", range(12))
def test_fit_is_exact_where_brute_force_is(seed):
    rng = random.Random(seed)
    have = {rng.randint(1, 9): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
    total = sum(k * n for k, n in have.items())
    budget = rng.randint(0, total + 3)
    sums = {0}
    for k, n in have.items():
        sums = {s + k * m for s in sums for m in range(n + 1)}
    take = mixing.fit_counts(have, budget)
    assert all(0 <= take.get(k, 0) <= n for k, n in have.items()) and set(take) <= set(have)
    # The proportional part may keep the best sum out of reach by less than the longest document.
    got = sum(k * n for k, n in take.items())
    best = max(s for s in sums if s <= budget)
    assert got <= budget and best - got <= max(have)


def test_plan_respects_caps_and_missing_sources():
    hist = {"a": {10: 100}, "b": {7: 3, 5: 2}, "odd": {3: 9}}
    picks, rows = mixing.plan(hist, [("a", 0.5, 1), ("b", 0.3, 2), ("gone", 0.2, 4)])
    by = {r["source"]: r for r in rows}
    assert by["gone"]["budget_tokens"] == 0 and by["a"]["budget_tokens"] <= 1000 and by["b"]["budget_tokens"] <= 62
    assert abs(by["a"]["budget_tokens"] / by["b"]["budget_tokens"] - 5 / 3) < 0.05
    assert all(s != "odd" for s, _, _ in picks)


def docs(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma ray", "delta"]) for _ in range(rng.randint(1, 40))), rng.choice(["A", "a ", "B", None, "other"])) for k in range(300)]
    rows += [(1000, None, "A"), (1001, "", "B")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def targets(spark, rows=(("a", 0.7, 1), ("b", 0.3, 3), ("none", 0.1, 2))):
    return spark.createDataFrame(list(rows), "source string, target_weight double, max_repeats int")


def test_shares_are_met_to_the_token(spark):
    mixture, report = mixing.mix(docs(spark), targets(spark), TOKENIZER)
    rows = {r.source: r for r in mixing.shares(mixture, report).collect()}
    for s in ("a", "b"):
        assert abs(rows[s].actual_tokens - rows[s].budget_tokens) <= 2
        assert rows[s].most_repeats <= rows[s].max_repeats
        assert abs(rows[s].actual_share - rows[s].fitted_weight) < 0.01
    assert rows["none"].actual_tokens == 0


def test_seed_decides_and_repeats(spark):
    one = {(r.doc_id, r.repeats) for r in mixing.mix(docs(spark), targets(spark), TOKENIZER, seed=1)[0].collect()}
    again = {(r.doc_id, r.repeats) for r in mixing.mix(docs(spark).repartition(7), targets(spark), TOKENIZER, seed=1)[0].collect()}
    other = {(r.doc_id, r.repeats) for r in mixing.mix(docs(spark), targets(spark), TOKENIZER, seed=2)[0].collect()}
    assert one == again != other


def test_all_documents_of_one_length(spark):
    d = spark.createDataFrame([(k, "same text", "a" if k % 3 else "b") for k in range(600)], "doc_id bigint, text string, source string")
    mixture, report = mixing.mix(d, targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)]), TOKENIZER)
    rows = {r.source: r for r in mixing.shares(mixture, report).collect()}
    assert rows["a"].actual_tokens == rows["b"].actual_tokens == 400


def test_empty_tables_and_extra_columns(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string, tokens string, bucket int")
    mixture, report = mixing.mix(none, targets(spark), TOKENIZER)
    assert mixture.count() == 0 and report.count() == 3
    assert mixing.mix(docs(spark), targets(spark, []), TOKENIZER)[1].count() == 0


def test_one_very_long_document_among_many_lengths():
    have = {k: 3 for k in range(100, 3000, 7)} | {1_000_003: 2}
    budget = sum(k * n for k, n in have.items()) // 2 + 1
    take = mixing.fit_counts(have, budget)
    assert sum(k * n for k, n in take.items()) == budget and all(n <= have[k] for k, n in take.items())
