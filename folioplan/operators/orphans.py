"""Orphan references: keys that point at rows which are missing, deleted or not there yet.

Plan
----
Both sides are mapped to a 64-bit hash of ``namespace + normalised key``, whose top bits cut the key space into ranges
of about ``range_keys`` parents each, however many there are.  Ranges that more than ``batch_refs`` references fall
into (one hot key may hold a third of all) are probed in several salted batches.  Each range holds its parents once per
batch as arrays sorted by hash, and a batch of references is resolved by one vectorised binary search.  Neither a range
of parents nor a batch of references grows with the input.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioplan.compat import cut

FOUND = "ref_table string, ref_id string, ref_field string, ref_key string, ref_us bigint, reason string"


def normal_key(c: Column) -> Column:
    """Keys match without regard to case and outer blanks; NULL and blank are no key."""
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(t != "", t)


def parents(papers: DataFrame, topics: DataFrame, tombstones: DataFrame) -> DataFrame:
    """ns, key, first_us, last_us, deleted_us: arrivals and the latest deletion of each key, in microseconds."""

    def side(df: DataFrame, ns: str, key: str, arrival: Column) -> DataFrame:
        return (
            df.select(F.lit(ns).alias("ns"), normal_key(F.col(key)).alias("key"), F.unix_micros(arrival).alias("at"))
            .where("key IS NOT NULL")
            .groupBy("ns", "key")
            .agg(F.min("at").alias("first_us"), F.max("at").alias("last_us"))
        )

    p = side(papers, "papers", "id", F.coalesce("importedAt", "createdAt"))
    t = side(topics, "topics", "id", F.col("createdAt")).withColumn("deleted_us", F.lit(None).cast("long"))
    gone = (
        tombstones.select(normal_key(F.col("paper_id")).alias("key"), F.unix_micros("deleted_at").alias("at"))
        .where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.max("at").alias("deleted_us"))
    )
    return p.join(gone, "key", "left").select("ns", "key", "first_us", "last_us", "deleted_us").unionByName(t)


def edge_references(edges: DataFrame) -> DataFrame:
    """Both ends of every edge; a blank end is read from the edge id (``[relation:<type>:]<source>-><target>``)."""
    bare = F.regexp_replace("id", r"^relation:[^:]*:", "")
    ends = [
        F.struct(
            F.lit(f).alias("ref_field"),
            F.coalesce(F.when(normal_key(F.col(f)).isNotNull(), F.col(f)), F.when(bare.contains("->"), F.regexp_extract(bare, p, 1))).alias("ref_key"),
        )
        for f, p in (("source", r"(?s)^(.*?)->"), ("target", r"(?s)^.*?->(.*)$"))
    ]
    return edges.select(
        F.lit("edges").alias("ref_table"), F.col("id").alias("ref_id"), F.explode(F.array(*ends)).alias("e"), F.unix_micros("createdAt").alias("at"), F.lit("papers").alias("ns")
    ).select("ref_table", "ref_id", "e.ref_field", "e.ref_key", "at", "ns")


def topic_references(papers: DataFrame) -> DataFrame:
    return papers.select(
        F.lit("papers").alias("ref_table"),
        F.col("id").alias("ref_id"),
        F.lit("topics").alias("ref_field"),
        F.explode("topics").alias("ref_key"),
        F.unix_micros(F.coalesce("importedAt", "createdAt")).alias("at"),
        F.lit("topics").alias("ns"),
    )


def _ranged(df: DataFrame, bits: int) -> DataFrame:
    """Adds the hash and the range, its top bits."""
    h = df.withColumn("h", F.xxhash64("ns", "key"))
    return h.withColumn("range", F.shiftrightunsigned("h", 64 - bits) if bits else F.pmod("h", F.lit(1)))  # not a literal, on which joins would fold


def _probe(refs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    out = refs[["ref_table", "ref_id", "ref_field", "ref_key"]].copy()
    out["ref_us"] = refs["at"].astype("Int64")  # microseconds, whose nulls came as NaN; the JVM makes it a time again
    n = len(refs)
    found = np.full(n, -1, dtype=np.int64)
    order = np.argsort(held["h"].to_numpy(), kind="stable")
    hashes = held["h"].to_numpy()[order]
    names = (held["ns"] + "\x00" + held["key"]).to_numpy(dtype=object)[order]
    wanted = (refs["ns"] + "\x00" + refs["key"]).to_numpy(dtype=object)
    lo = np.searchsorted(hashes, refs["h"].to_numpy(), side="left")
    hi = np.searchsorted(hashes, refs["h"].to_numpy(), side="right")
    open_ = np.flatnonzero(lo < hi)
    while len(open_):  # one round unless two keys share all 64 bits
        same = names[lo[open_]] == wanted[open_]
        found[open_[same]] = lo[open_[same]]
        open_ = open_[~same]
        lo[open_] += 1
        open_ = open_[lo[open_] < hi[open_]]
    hit = found >= 0
    pick = order[found[hit]]

    def col(name: str) -> np.ndarray:
        v = np.full(n, np.nan)
        if hit.any():
            v[hit] = held[name].to_numpy(dtype=float, na_value=np.nan)[pick]
        return v

    # Microseconds since 1970 fit a double exactly until the year 2255.
    at = refs["at"].to_numpy(dtype=float, na_value=np.nan)
    first, last, gone = col("first_us"), col("last_us"), col("deleted_us")
    with np.errstate(invalid="ignore"):
        out["reason"] = np.select([~hit, gone > last, first > at], ["missing", "deleted", "early"], default="")
    return out[out["reason"] != ""]


def _once(references: DataFrame) -> DataFrame:
    """Each reference once, at the earliest time of any row of its id: one exchange, to which every task sends an id once."""
    key = normal_key(F.col("ref_key"))
    named = references.where(key.isNotNull()).groupBy("ref_table", "ref_id").agg(F.min("at").alias("at"), F.collect_set(F.struct("ref_field", "ref_key", "ns")).alias("r"))
    return named.select("ref_table", "ref_id", "at", F.explode("r").alias("r")).select("ref_table", "ref_id", "r.ref_field", "r.ref_key", "r.ns", "at").withColumn("key", key)


def orphan_references(references: DataFrame, parent_rows: DataFrame, range_keys: int = 50_000, batch_refs: int = 100_000) -> DataFrame:
    """Every reference whose key is missing, deleted or arrives later, with the reason and the reference's time.

    ``references``: ref_table, ref_id, ref_field, ref_key, at (microseconds), ns.  ``parent_rows``: see ``parents``.
    Repeated rows of a reference count once and at their earliest time.  A null or blank key names nothing and is no
    reference; a reference without a time is never early; a key without any arrival is never deleted or late.
    """
    parent_rows = cut(parent_rows)  # counted first, then probed
    n = parent_rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / range_keys))) if n > range_keys else 0
    refs = _ranged(_once(references), bits)
    # At most one row per ``batch_refs`` references, so this table may be broadcast whatever the input.
    hot = refs.groupBy("range").agg(F.ceil(F.count("*") / batch_refs).cast("int").alias("batches")).where("batches > 1")
    refs = refs.join(F.broadcast(hot), "range", "left").withColumn("batches", F.coalesce("batches", F.lit(1)))
    refs = refs.withColumn("salt", F.pmod(F.xxhash64("ref_table", "ref_id", "ref_field"), F.col("batches")).cast("int")).drop("batches")
    held = _ranged(parent_rows, bits).join(F.broadcast(hot), "range", "left")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("batches", F.lit(1)) - 1))).drop("batches")
    found = refs.groupBy("range", "salt").cogroup(held.groupBy("range", "salt")).applyInPandas(_probe, FOUND)
    return found.select("ref_table", "ref_id", "ref_field", "ref_key", F.timestamp_micros("ref_us").alias("ref_time"), "reason")


def report(found: DataFrame, references: DataFrame) -> DataFrame:
    """Per table, field and month of the reference: references, and misses by reason."""
    month = F.date_format("ref_time", "yyyy-MM")
    misses = found.groupBy("ref_table", "ref_field", F.coalesce(month, F.lit("unknown")).alias("month")).agg(
        *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "deleted", "early")], F.count("*").alias("n_orphans")
    )
    totals = (
        _once(references)
        .groupBy("ref_table", "ref_field", F.coalesce(F.date_format(F.timestamp_micros("at"), "yyyy-MM"), F.lit("unknown")).alias("month"))
        .agg(F.count("*").alias("n_references"))
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_missing", "n_deleted", "n_early", "n_orphans")]
    return totals.join(misses, ["ref_table", "ref_field", "month"], "left").select("ref_table", "ref_field", "month", F.col("n_references").cast("long"), *zero)


def references(edges: DataFrame, papers: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [edge_references(edges), topic_references(papers)])
