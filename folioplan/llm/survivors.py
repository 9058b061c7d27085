"""One surviving value per field for each group of records of one work.

Plan
----
1. Groups are connected components over identifiers written in one way.  Only identifiers that two ids share take
   part; labels spread id -> identifier -> id with pointer jumping, each round two aggregations (an identifier of a
   third of all rows costs a partial aggregate, not a task) and a reliable checkpoint.
2. Values are reduced to distinct ones per group before anything else, with the records' trust as weights.
3. Consensus: values of a group are aligned progressively in blocks of bounded size, tokens vote per column, and the
   consensus texts of the blocks are aligned again until one is left.  A copy that is cut short abstains beyond its
   end; an abbreviation votes for what it abbreviates.
4. The survivor is the existing usable value closest to the consensus; counts and sources are one-token values whose
   vote the latest or the most trusted record decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioplan.compat import cut, js_trim
from folioplan.operators.components import components

#: Ways of writing that a value is missing.
PLACEHOLDERS = (
    "n/a", "na", "none", "null", "nil", "unknown", "unknown venue", "unknown journal", "not available", "not known", "tba", "tbd", "-", "--", "–", "—", "?", ".", "...", "…", "missing",
    "untitled", "no abstract", "no abstract available", "abstract not available", "abstract missing", "abstract unavailable", "untitled abstract", "no venue", "venue unknown", "not specified", "unspecified",
)
#: States of publication that stand where a venue should.
STATUSES = ("preprint", "in press", "in preparation", "submitted", "under review", "in review", "accepted", "accepted manuscript", "forthcoming", "to appear", "ahead of print", "online first", "early access", "published", "unpublished", "working paper", "manuscript", "draft")
#: Phrases of web pages around an abstract, not of abstracts.
WEB_PHRASES = ("skip to main content", "this page uses cookies", "uses cookies", "accept cookies", "sign in through", "sign in to", "log in to", "create an account", "access options", "add to cart", "buy this article", "enable javascript", "rights and permissions", "terms of use", "privacy policy", "subscribe to", "all rights reserved", "download pdf", "view full text")
_CUT = r"(\.\.\.|…|[-‐]|\[(truncated|cut|more|…|\.\.\.)\])\s*$"
_ENDED = r"""[.!?。！？．][\s"'”’»)\]]*$"""
#: Records without a known source weigh this much less than the least trusted one.
_UNTRUSTED = 100


def _plain(c: Column) -> Column:
    return F.lower(js_trim(c))


def _placeholder(c: Column) -> Column:
    bare = js_trim(F.regexp_replace(_plain(c), r"^[\[(<]+|[\])>.!]+$", ""))
    return c.isNull() | (_plain(c) == "") | bare.isin(*PLACEHOLDERS) | (bare == "")


IDENTIFIERS = ("doi", "semanticScholarId", "openAlexId", "arxivId")


def identifiers(papers: DataFrame) -> DataFrame:
    """paper_id, key: the identifiers of each paper in one way of writing; blanks and placeholders give none."""
    raw = papers.where("id IS NOT NULL").select(F.col("id").alias("paper_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in IDENTIFIERS])).alias("x"))
    v = _plain(F.col("x.v"))
    v = F.regexp_replace(v, r"^(https?://)?((dx|www)\.)?(doi\.org|arxiv\.org/(abs|pdf)|openalex\.org|api\.openalex\.org/works|(www\.)?semanticscholar\.org/paper)/", "")
    v = F.regexp_replace(v, r"^(doi|arxiv|openalex|s2|corpusid)\s*:?\s+|^(doi|arxiv|openalex|s2)\s*:\s*", "")
    v = F.regexp_replace(v, r"[\s.,;]+$", "")
    v = F.when(F.col("x.kind") == "arxivId", F.regexp_replace(v, r"(\.pdf)?$|v\d+(\.pdf)?$", "")).otherwise(v)
    named = raw.where("x.v IS NOT NULL").select("paper_id", F.col("x.kind").alias("kind"), v.alias("v")).distinct()
    return named.where(~_placeholder(F.col("v"))).select("paper_id", F.concat("kind", F.lit(":"), "v").alias("key"))


def groups(papers: DataFrame) -> DataFrame:
    """group_id, paper_id: ids joined directly or through others by an equal identifier, two or more to a group."""
    pairs = identifiers(papers)
    shared = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    linked = components(pairs.join(shared, "key", "left_semi").select(F.col("paper_id").alias("item"), "key"))
    return linked.select(F.col("component").alias("group_id"), F.col("item").alias("paper_id"))


# ---- consensus ----------------------------------------------------------------------------------------------------


def _same(a: str, b: str) -> bool:
    """Tokens that say the same: equal, or one abbreviates the other ("Comput." and "Computational")."""
    if a == b:
        return True
    x, y = a.lower(), b.lower()
    if x == y:
        return True
    if x.endswith(".") and len(x) > 1 and y.startswith(x[:-1]):
        return True
    return y.endswith(".") and len(y) > 1 and x.startswith(y[:-1])


def align(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Columns of a global alignment (match 2, mismatch -1, gap -1); common ends are aligned at once."""
    lo = 0
    while lo < len(a) and lo < len(b) and _same(a[lo], b[lo]):
        lo += 1
    za, zb = len(a), len(b)
    while za > lo and zb > lo and _same(a[za - 1], b[zb - 1]):
        za, zb = za - 1, zb - 1
    head = [(k, k) for k in range(lo)]
    tail = [(za + k, zb + k) for k in range(len(a) - za)]
    x, y = a[lo:za], b[lo:zb]
    if not x or not y:
        return head + [(lo + k, None) for k in range(len(x))] + [(None, lo + k) for k in range(len(y))] + tail
    return head + _best_path(x, y, lo, lo) + tail


CELLS = 1 << 24  # of a table of steps; wider alignments are halved where their best path crosses the middle


def _best_path(x: list[str], y: list[str], ox: int, oy: int) -> list[tuple[int | None, int | None]]:
    """The best alignment of any two texts, in time in proportion to the product of their lengths and bounded memory."""
    if not x or not y:
        return [(ox + k, None) for k in range(len(x))] + [(None, oy + k) for k in range(len(y))]
    if len(x) * len(y) <= 1024:
        return _small(x, y, ox, oy)
    if len(x) * len(y) <= CELLS or len(x) == 1:
        return _table(x, y, ox, oy)
    mid = len(x) // 2
    before, after = _last_row(x[:mid], y), _last_row(x[mid:][::-1], y[::-1])[::-1]
    j = int(np.argmax(before + after))
    return _best_path(x[:mid], y[:j], ox, oy) + _best_path(x[mid:], y[j:], ox + mid, oy + j)


def _small(x: list[str], y: list[str], ox: int, oy: int) -> list[tuple[int | None, int | None]]:
    n, m = len(x), len(y)
    score = [-k for k in range(m + 1)]
    back = []
    for i in range(1, n + 1):
        row, trace = [-i], bytearray(m + 1)
        left = -i
        for j in range(1, m + 1):
            d = score[j - 1] + (2 if _same(x[i - 1], y[j - 1]) else -1)
            u = score[j] - 1
            if d >= u and d >= left - 1:
                left = d
            elif u >= left - 1:
                left, trace[j] = u, 1
            else:
                left, trace[j] = left - 1, 2
            row.append(left)
        score = row
        back.append(trace)
    return _walk(back, n, m, ox, oy)


def _walk(back, i: int, j: int, ox: int, oy: int) -> list[tuple[int | None, int | None]]:
    out = []
    while i or j:
        if i and j and back[i - 1][j] == 0:
            i, j = i - 1, j - 1
            out.append((ox + i, oy + j))
        elif i and (not j or back[i - 1][j] == 1):
            i -= 1
            out.append((ox + i, None))
        else:
            j -= 1
            out.append((None, oy + j))
    return out[::-1]


def _gains(x: list[str], y: list[str]) -> Iterator[np.ndarray]:
    """Per token of x, what it gains beside each token of y; which distinct tokens say the same is found once."""
    words = sorted({t.lower() for t in y})
    at = {w: k for k, w in enumerate(words)}
    ids = np.array([at[t.lower()] for t in y])
    known: dict[str, np.ndarray] = {}
    stems = {k for w, k in at.items() if w.endswith(".") and len(w) > 1}
    for t in x:
        t = t.lower()
        row = known.get(t)
        if row is None:
            same = np.zeros(len(words), bool)
            if t in at:
                same[at[t]] = True
            if t.endswith(".") and len(t) > 1:
                a = bisect_left(words, t[:-1])
                while a < len(words) and words[a].startswith(t[:-1]):
                    same[a] = True
                    a += 1
            for k in range(2, len(t) + 1):
                w = at.get(t[: k - 1] + ".")
                if w in stems:
                    same[w] = True
            if t + "." in at:
                same[at[t + "."]] = True
            row = known[t] = np.where(same[ids], 2, -1)
        yield row


def _rows(x: list[str], y: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per token of x the scores so far, and what a match and a gap in y would have given."""
    j = np.arange(len(y) + 1)
    score = -j
    for i, gain in enumerate(_gains(x, y), 1):
        d, u = score[:-1] + gain, score[1:] - 1
        # A gap in x costs one: the best of all cells to the left, each less its distance.
        score = np.maximum.accumulate(np.concatenate(([-i], np.maximum(d, u))) + j) - j
        yield score, d, u


def _last_row(x: list[str], y: list[str]) -> np.ndarray:
    score = -np.arange(len(y) + 1)
    for score, _, _ in _rows(x, y):
        pass
    return score


def _table(x: list[str], y: list[str], ox: int, oy: int) -> list[tuple[int | None, int | None]]:
    back = np.zeros((len(x), len(y) + 1), "uint8")
    for i, (score, d, u) in enumerate(_rows(x, y)):
        left = score[:-1] - 1
        back[i, 1:] = np.where((d >= u) & (d >= left), 0, np.where(u >= left, 1, 2))
    return _walk(back, len(x), len(y), ox, oy)


def consensus(profiles: list[tuple[list[str], list[float], float, bool]]) -> tuple[list[str], list[float], float, bool]:
    """Progressive alignment of (tokens, votes per token, weight, cut short), longest first, and the voted text.

    A column stays if its tokens outweigh those that have nothing there; what is cut short does not vote beyond its
    end.  Tokens that say the same pool their votes under the longest of them.
    """
    order = sorted(profiles, key=lambda p: (-len(p[0]), p[0]))
    columns: list[dict[str, float]] = [{t: v} for t, v in zip(order[0][0], order[0][1])]
    missing = [0.0] * len(columns)
    weight = order[0][2]
    for tokens, votes, w, short in order[1:]:
        guide = [max(c, key=lambda t: (c[t], len(t), t)) for c in columns]
        path = align(guide, tokens)
        last = max((k for k, (_, j) in enumerate(path) if j is not None), default=-1)
        new_columns, new_missing = [], []
        for k, (i, j) in enumerate(path):
            column = dict(columns[i]) if i is not None else {}
            gone = missing[i] if i is not None else weight
            if j is not None:
                alike = next((t for t in column if _same(t, tokens[j])), None)
                if alike is None:
                    column[tokens[j]] = votes[j]
                else:
                    total = column.pop(alike) + votes[j]
                    column[max(alike, tokens[j], key=lambda t: (not t.endswith("."), len(t), t))] = total
            elif not (short and k > last):
                gone += w
            new_columns.append(column)
            new_missing.append(gone)
        columns, missing, weight = new_columns, new_missing, weight + w
    kept = [(max(c, key=lambda t: (c[t], len(t), t)), sum(c.values())) for c, gone in zip(columns, missing) if sum(c.values()) >= gone]
    return [t for t, _ in kept], [v for _, v in kept], weight, all(p[3] for p in profiles)


def distance(tokens: list[str], target: list[str]) -> float:
    """Columns that differ between a value and the consensus; an abbreviation differs by half."""
    total = 0.0
    for i, j in align(tokens, target):
        if i is None or j is None:
            total += 1
        elif tokens[i] != target[j]:
            total += 0.5 if _same(tokens[i], target[j]) else 1
    return total


_PROFILE = "group_id string, field string, tokens array<string>, votes array<double>, weight double, short boolean"


def _consensus_of(values: DataFrame, block: int) -> DataFrame:
    """group_id, field, consensus (tokens); values: group_id, field, value, weight, short (distinct values)."""

    def profile(value: str, weight: float, short: bool) -> tuple[list[str], list[float], float, bool]:
        tokens = re.sub(r"\s*(\.\.\.|…|[-‐]|\[\w+\])\s*$", "", value).split() if short else value.split()
        tokens = tokens[:-1] if short and len(tokens) > 1 else tokens  # the last token of a cut text is half a word
        return tokens, [weight] * len(tokens), weight, short

    def merged(batches: Iterator[pd.DataFrame], read) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g, f, *consensus([read(x) for x in c])) for g, f, c in zip(b["group_id"], b["field"], b["c"])]
            yield pd.DataFrame(rows, columns=["group_id", "field", "tokens", "votes", "weight", "short"])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return merged(batches, lambda x: profile(x["value"], x["weight"], x["short"]))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return merged(batches, lambda x: (list(x["tokens"]), list(x["votes"]), x["weight"], x["short"]))

    # A group of many distinct values goes over several tasks: a block of it each, then their consensus.
    sizes = values.groupBy("group_id", "field").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    salt = F.pmod(F.xxhash64("value"), F.col("blocks"))
    salted = values.join(sizes, ["group_id", "field"]) if most > 1 else values.withColumn("blocks", F.lit(1))
    parts = salted.withColumn("salt", salt).groupBy("group_id", "field", "salt").agg(F.sort_array(F.collect_list(F.struct("value", "weight", "short"))).alias("c"))
    profiles = parts.select("group_id", "field", "c").mapInPandas(first, _PROFILE)
    while most > 1:
        profiles = cut(profiles)
        sizes = profiles.groupBy("group_id", "field").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        parts = profiles.join(sizes, ["group_id", "field"]).withColumn("salt", F.pmod(F.xxhash64("tokens"), F.col("blocks")))
        parts = parts.groupBy("group_id", "field", "salt").agg(F.sort_array(F.collect_list(F.struct("tokens", "votes", "weight", "short"))).alias("c"))
        profiles = parts.select("group_id", "field", "c").mapInPandas(again, _PROFILE)
        most = -(-most // block)
    return profiles.select("group_id", "field", F.col("tokens").alias("consensus"))


def _full_abstract(c: Column) -> Column:
    return ~_placeholder(c) & ~_web(c) & ~_short_abstract(c)


def _web(c: Column) -> Column:
    low = F.lower(c)
    return sum((low.contains(p).cast("int") for p in WEB_PHRASES), F.lit(0)) >= 2


def _short_abstract(c: Column) -> Column:
    return c.rlike(_CUT) | ~c.rlike(_ENDED)


def _venue_noise(c: Column) -> Column:
    return _placeholder(c) | _plain(c).isin(*STATUSES)


def _short_venue(c: Column) -> Column:
    t = js_trim(c)
    # Abbreviated words, or one word of capitals.
    return t.rlike(r"\p{L}\.(\s|$)") | t.rlike(r"^[\p{Lu}\d&]{2,8}$")


def survivors(papers: DataFrame, trust: DataFrame, block: int = 64, strangers: int = 3) -> DataFrame:
    """group_id, field, paper_id, value: for each group and field the record whose value survives.

    Fields abstract, venue, citationCount and source; no row where no record of the group has a usable value.  A text
    that groups of ``strangers`` or more differently beginning titles share is no group's own abstract, however large
    the corpus; copies of one work that no identifier joins have one title.  Repeated rows count once; ties fall to the
    more trusted, then the more recent record, then the smaller id.  Null ids belong to no group.
    """
    member = groups(papers)
    rank = trust.where("source IS NOT NULL").groupBy(_plain(F.col("source")).alias("source_key")).agg(F.min("trust_rank").alias("trust_rank"))
    rows = (
        papers.select(
            F.col("id").alias("paper_id"), F.substring(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", ""), 1, 20).alias("title"), "abstract", "venue", "citationCount", "source", F.coalesce("updatedAt", "importedAt").alias("seen"), _plain(F.col("source")).alias("source_key")
        )
        .join(member, "paper_id")
        .join(rank, "source_key", "left")
        .withColumn("worth", F.coalesce("trust_rank", F.lit(_UNTRUSTED)))
    )
    rows = cut(rows)
    return _texts(rows, block, strangers).unionByName(_scalars(rows))


def _scalars(rows: DataFrame) -> DataFrame:
    """One-token values: the vote of the latest record decides counts, that of the most trusted one sources."""
    counts = rows.where("citationCount >= 0")
    # Of equally good records the smallest id: aggregate those that reach the best order again.
    top = counts.groupBy("group_id").agg(F.max("seen").alias("top"))
    latest = counts.join(top, "group_id").where(F.col("seen").eqNullSafe(F.col("top")))
    keep = F.min(F.struct("worth", "paper_id", F.col("citationCount").cast("string").alias("value"))).alias("s")
    c = latest.groupBy("group_id").agg(keep).select("group_id", F.lit("citationCount").alias("field"), "s.paper_id", "s.value")
    trusted = rows.where("trust_rank IS NOT NULL").groupBy("group_id").agg(
        F.min(F.struct("worth", (-F.unix_micros("seen")).alias("age"), "paper_id", F.col("source").alias("value"))).alias("s")
    )
    return c.unionByName(trusted.select("group_id", F.lit("source").alias("field"), "s.paper_id", "s.value"))


def _texts(rows: DataFrame, block: int, strangers: int) -> DataFrame:
    abstract = rows.where(~_placeholder(F.col("abstract")) & ~_web(F.col("abstract"))).select("group_id", F.lit("abstract").alias("field"), F.col("abstract").alias("value"), _short_abstract(F.col("abstract")).alias("short"), "paper_id", "worth", "seen", "title")
    venue = rows.where(~_venue_noise(F.col("venue"))).select("group_id", F.lit("venue").alias("field"), F.col("venue").alias("value"), _short_venue(F.col("venue")).alias("short"), "paper_id", "worth", "seen", "title")
    cells = abstract.unionByName(venue)
    # One row per distinct value: its pooled weight, and its best record.
    best = F.min(F.struct("worth", (-F.unix_micros("seen")).alias("age"), "paper_id")).alias("best")
    values = cells.groupBy("group_id", "field", "value", "short").agg(F.sum(1.0 + 1.0 / F.col("worth")).alias("weight"), best, F.min("title").alias("title"))
    common = values.where("field = 'abstract'").groupBy("field", "value").agg(F.count_distinct("title").alias("n")).where(F.col("n") >= strangers).select("field", "value")
    values = cut(values.join(common, ["field", "value"], "left_anti"))
    # A venue of initials names no words that could be aligned; it has no vote.
    voters = values.where(~((F.col("field") == "venue") & js_trim(F.col("value")).rlike(r"^[\p{Lu}\d&]{2,8}$")))
    agreed = _consensus_of(voters.select("group_id", "field", "value", "weight", (F.col("short") & (F.col("field") == "abstract")).alias("short")), block)

    @F.pandas_udf("double")
    def far(value: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([distance(v.split(), list(t)) for v, t in zip(value, target)], dtype="float64")

    judged = values.where("NOT short").join(agreed, ["group_id", "field"]).withColumn("distance", far("value", "consensus"))
    pick = F.min(F.struct("distance", (-F.col("weight")).alias("w"), "best", "value")).alias("s")
    return judged.groupBy("group_id", "field").agg(pick).select("group_id", "field", F.col("s.best.paper_id").alias("paper_id"), F.col("s.value").alias("value"))
