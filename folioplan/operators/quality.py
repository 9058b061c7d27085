"""How good an extraction is against what was expected: grams, greedy matching, author order, the weighted rubric."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioplan.compat import cut
from folioplan.functions.folding import nfkd_no_marks
from folioplan.functions.normalize import text

#: The rubric's weights and thresholds.
WEIGHTS = {"title": 20, "authors": 25, "year": 10, "doi": 10, "references": 35}
MATCH, COMPLETE = 0.70, 0.90


def normalized(c: Column) -> Column:
    """Letters and digits of a text, without marks, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(nfkd_no_marks(text(c))), r"[^\p{L}\p{N}]+", " "))


def _compact(c: Column) -> Column:
    return F.replace(normalized(F.regexp_replace(text(c), r"^\s*(?:\[\d+\]|\d+\.)\s*", "")), F.lit(" "), F.lit(""))


def _shingles(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, gram, n of a column ``t``."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 4), lambda k: F.substring(F.col("t"), k, F.lit(5)))).alias("gram")
    return cells.where("length(t) >= 5").select(*keys, gram).groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def grams(refs: DataFrame, key: str, c: str) -> DataFrame:
    """key, gram, n: multiset of 5-character shingles without spaces and the leading number."""
    return _shingles(refs.select(key, _compact(F.col(c)).alias("t")), key)


def gram_similarity(expected: DataFrame, actual: DataFrame, least: float = MATCH) -> DataFrame:
    """eid, aid, precision, recall, similarity of entries of one document that reach ``least``.

    expected: doc_id, eid, text; actual: doc_id, aid, text.  Only entries of one document meet.
    """
    # The number of an entry's grams follows from its length and travels with them.
    e, a = (cut(df.select("doc_id", k, _compact(F.col("text")).alias("t")).withColumn("total", F.length("t") - 4)) for df, k in ((expected, "eid"), (actual, "aid")))
    mine = _shingles(e, "doc_id", "eid", "total").withColumnRenamed("total", "te")
    theirs = _shingles(a, "doc_id", "aid", "total").withColumnRenamed("total", "ta").withColumnRenamed("n", "m")
    j = mine.join(theirs, ["doc_id", "gram"]).groupBy("doc_id", "eid", "te", "aid", "ta").agg(F.sum(F.least("n", "m")).alias("c")).withColumn("precision", F.col("c") / F.col("ta")).withColumn("recall", F.col("c") / F.col("te"))
    return j.withColumn("similarity", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).where(F.col("similarity") >= least).select("doc_id", "eid", "aid", "precision", "recall", "similarity")


def greedy(pairs: DataFrame) -> DataFrame:
    """The pairs kept by best-first one-to-one assignment in each document.

    pairs: doc_id, eid, aid, similarity, page_match and anything else; ties prefer a page match, then the smaller ids.
    """
    schema = pairs.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["similarity", "page_match", "eid", "aid"], ascending=[False, False, True, True])
        e, a, keep = set(), set(), []
        for k, x, y in zip(order.index, order["eid"], order["aid"]):
            if x not in e and y not in a:
                e.add(x)
                a.add(y)
                keep.append(k)
        return order.loc[keep]

    return pairs.groupBy("doc_id").applyInPandas(run, schema)


def longest_increasing(values: list[int]) -> int:
    import bisect

    tails: list[int] = []
    for v in values:
        k = bisect.bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def author_scores(rows: DataFrame) -> DataFrame:
    """id, precision, recall, f1, order_coverage, score of author lists (X17, W12); rows: id, actual, expected (normalised)."""
    schema = "id string, precision double, recall double, f1 double, order_coverage double, score double"

    def run(batches):
        for b in batches:
            out = []
            for i, actual, expected in zip(b["id"], b["actual"], b["expected"]):
                actual, expected = [] if actual is None else list(actual), [] if expected is None else list(expected)
                free, matched = list(range(len(expected))), []
                for name in actual:
                    k = next((x for x in free if expected[x] == name), None)
                    if k is not None:
                        free.remove(k)
                        matched.append(k)
                p = len(matched) / len(actual) if actual else 0.0
                r = len(matched) / len(expected) if expected else 0.0
                f = 2 * p * r / (p + r) if p + r else 0.0
                o = longest_increasing(matched) / len(expected) if expected else 0.0
                out.append((i, p, r, f, o, 0.8 * f + 0.2 * o))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


def reference_scores(expected: DataFrame, actual: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, expected_count, actual_count, matched, f1, page_coverage, complete, score per document."""
    e, a = expected.groupBy("doc_id").agg(F.count("*").alias("expected_count")), actual.groupBy("doc_id").agg(F.count("*").alias("actual_count"))
    whole = (F.least("precision", "recall") >= COMPLETE) & F.col("page_match")
    m = matches.groupBy("doc_id").agg(F.count("*").alias("matched"), F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.count_if("page_match").alias("pm"), F.count_if(whole).alias("whole"))
    j = e.join(a, "doc_id", "left").join(m, "doc_id", "left").fillna(0)
    p, r = F.try_divide("sp", "actual_count"), F.try_divide("sr", "expected_count")
    j = j.withColumn("p", F.coalesce(p, F.lit(0.0))).withColumn("r", F.coalesce(r, F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    complete = (F.col("matched") == F.col("expected_count")) & (F.col("matched") == F.col("actual_count")) & (F.col("whole") == F.col("matched"))
    j = j.withColumn("f1", f1).withColumn("page_coverage", F.col("pm") / F.col("expected_count")).withColumn("complete", complete)
    return j.select("doc_id", "expected_count", F.col("actual_count").cast("bigint").alias("actual_count"), F.col("matched").cast("bigint").alias("matched"), "f1", "page_coverage", "complete", (0.9 * F.col("f1") + 0.1 * F.col("page_coverage")).alias("score"))


def rubric(parts: DataFrame) -> DataFrame:
    """id, score: the weighted sum in percent; an unknown DOI is no part of the total, an error scores 0.

    parts: id, ok, title, authors, year, doi (NULL where none is expected), references: scores in [0, 1].
    """
    earned = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    possible = sum((F.when(F.col(k).isNull() & F.lit(k == "doi"), 0).otherwise(w) for k, w in WEIGHTS.items()), F.lit(0))
    return parts.select("id", F.when(F.col("ok"), F.round(100 * earned / possible, 2)).otherwise(0.0).alias("score"))


def corpus_score(scores: DataFrame) -> DataFrame:
    """The mean score, to one digit."""
    return scores.agg(F.count("*").alias("files"), F.round(F.avg("score"), 1).alias("score"))


