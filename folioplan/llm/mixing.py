"""A mixture of sources near target weights, sized in tokens and within repeat caps.

Plan
----
1. Token lengths come from one Arrow pass with a public tokenizer and are checkpointed: (doc_id, source, tokens).
2. Documents are counted by source and exact length; only that histogram (bounded by the distinct lengths of the
   sources of the target table) reaches the driver.
3. The total is the largest at which every source with documents can hold its weight within its cap.  Each source's
   budget is whole passes over the source, then a proportional part of every length, then a bounded-knapsack program
   over what is left of each length that fits the rest of the budget, to the token where the lengths allow it.
4. How many documents of each length to take is joined back; seeded hashes choose which.  A length with any number of
   documents is split by hash bucket, so that ranking never sees more than one bucket of it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioplan.compat import cut, js_trim

#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HASH_BUCKETS = 4096


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, source (lower case, trimmed), tokens; null and empty texts have no tokens, blank sources are null."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(t.encode_ordinary(x)) if x else 0 for x in b["text"]]})

    plain = F.lower(js_trim(F.col("source")))
    rows = documents.select("doc_id", F.when(plain != "", plain).alias("source"), "text")
    return rows.mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def fit_counts(available: dict[int, int], budget: int, slack: int = 16) -> dict[int, int]:
    """How many documents of each token length to take so that the tokens come as near under ``budget`` as possible.

    A proportional part of every length first (the mixture keeps the source's lengths), then lengths round robin until
    at most ``slack`` times the longest is missing, then an exact bounded-knapsack program over the rest.
    """
    have = {k: n for k, n in sorted(available.items()) if k > 0 and n > 0}
    total = sum(k * n for k, n in have.items())
    if budget >= total:
        return have
    if budget <= 0:
        return {}
    take = {k: n * budget // total for k, n in have.items()}
    rest = budget - sum(k * n for k, n in take.items())
    longest = max(have)
    for k in sorted(have, reverse=True):
        while rest > slack * longest and take[k] < have[k] and k <= rest:
            more = min(have[k] - take[k], max(1, (rest - slack * longest) // k))
            take[k] += more
            rest -= more * k
    # Reachable sums as bits of an integer, a step per binary part of each bounded count; of each sum only the first
    # part that reached it is kept, so memory is in proportion to the rest alone.
    parts = []
    for k, n in have.items():
        left, size = min(n - take[k], rest // k), 1
        while left > 0:
            size = min(size, left)
            parts.append((k, size))
            left -= size
            size *= 2
    mask = (1 << (rest + 1)) - 1
    reached, first = 1, np.full(rest + 1, -1, "int32")
    for j, (k, size) in enumerate(parts):
        new = reached << k * size & mask & ~reached
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), "uint8"), bitorder="little", count=rest + 1)
            first[np.flatnonzero(bits)] = j
            reached |= new
        if reached >> rest & 1:
            break
    at = reached.bit_length() - 1
    while at:
        k, size = parts[first[at]]
        take[k] += size
        at -= k * size
    return {k: n for k, n in take.items() if n}


def plan(histogram: dict[str, dict[int, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> tuple[list[tuple[str, int, int]], list[dict]]:
    """(source, length, documents to take beyond whole passes) and one report row per target source.

    Weights of sources without documents are shared out among the others in proportion.  With ``total`` given, a
    source that cannot reach its weight within its cap is used up to the cap and the report shows the shortfall.
    """
    size = {s: sum(k * n for k, n in histogram.get(s, {}).items()) for s, _, _ in targets}
    alive = [(s, w, r) for s, w, r in targets if size[s] > 0 and w > 0 and r > 0]
    weight = sum(w for _, w, _ in alive)
    if total is None:
        total = int(min((size[s] * r * weight / w for s, w, r in alive), default=0))
    picks, rows = [], []
    for s, w, r in targets:
        share = w / weight if weight and size[s] > 0 and w > 0 and r > 0 else 0.0
        budget = min(int(total * share + 0.5), size[s] * r)
        passes = budget // size[s] if size[s] else 0
        extra = fit_counts(histogram.get(s, {}), budget - passes * size[s]) if passes < r else {}
        picks += [(s, k, n) for k, n in extra.items()]
        rows.append({"source": s, "target_weight": w, "fitted_weight": share, "max_repeats": r, "available_tokens": size[s], "budget_tokens": budget, "passes": passes})
    return picks, rows


def mix(documents: DataFrame, targets: DataFrame, path: str, total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, repeats) of the mixture, and its report per target source.

    ``path``: the vocabulary file of the tokenizer, under the same path on every node.
    Documents without tokens or of sources without a target take no part.  ``targets`` is a small table (checked: at
    most 10 000 sources); a source listed twice counts once, at its smallest weight and cap.
    """
    spark = documents.sparkSession
    name = F.lower(js_trim(F.col("source")))
    wanted = targets.where("source IS NOT NULL").groupBy(name.alias("source")).agg(F.min("target_weight").alias("w"), F.min("max_repeats").alias("r"))
    rows = wanted.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10 000 target sources")
    aims = sorted((x.source, float(x.w or 0), int(x.r or 0)) for x in rows)
    schema = "source string, target_weight double, fitted_weight double, max_repeats int, available_tokens bigint, budget_tokens bigint, passes bigint"
    named = spark.createDataFrame([(a,) for a, _, _ in aims], "source string")
    lengths = cut(token_lengths(documents.join(F.broadcast(named.select(F.col("source").alias("_aim"))), F.lower(js_trim(F.col("source"))) == F.col("_aim"), "left_semi"), path).where("tokens > 0"))
    histogram: dict[str, dict[int, int]] = {}
    for x in lengths.groupBy("source", "tokens").count().collect():
        histogram.setdefault(x.source, {})[x.tokens] = x["count"]
    picks, report = plan(histogram, aims, total)
    passes = F.broadcast(spark.createDataFrame([(x["source"], x["passes"]) for x in report], "source string, passes bigint"))
    chosen = spark.createDataFrame(picks, "source string, tokens bigint, take bigint")
    keyed = lengths.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.lit(HASH_BUCKETS)))
    by_bucket = keyed.groupBy("source", "tokens", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.join(chosen, ["source", "tokens"]).withColumn("left", F.col("take") - F.coalesce(F.sum("n").over(before), F.lit(0))).where("left > 0")
    rank = Window.partitionBy("source", "tokens", "bucket").orderBy("h", "doc_id")
    taken = keyed.join(by_bucket.select("source", "tokens", "bucket", "n", "left"), ["source", "tokens", "bucket"])
    whole = taken.where(F.col("n") <= F.col("left")).select("doc_id", "source", "tokens")
    part = taken.where(F.col("n") > F.col("left")).withColumn("k", F.row_number().over(rank)).where("k <= left").select("doc_id", "source", "tokens")
    extra = whole.unionByName(part).withColumn("repeats", F.lit(1).cast("bigint"))
    full = lengths.join(passes, "source").where("passes > 0").select("doc_id", "source", "tokens", F.col("passes").alias("repeats"))
    mixture = full.unionByName(extra).groupBy("doc_id", "source", "tokens").agg(F.sum("repeats").alias("repeats"))
    return mixture, spark.createDataFrame([tuple(x.values()) for x in report], schema)


def shares(mixture: DataFrame, report: DataFrame) -> DataFrame:
    """The report with what the mixture actually holds of each source."""
    per = mixture.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"), F.max("repeats").alias("most_repeats"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_documents", "actual_tokens", "most_repeats")]
    rows = report.join(per, "source", "left").select(*report.columns, *zero)
    return rows.withColumn("actual_share", F.round(F.col("actual_tokens") / F.greatest(F.sum("actual_tokens").over(Window.partitionBy()), F.lit(1)), 8))
