"""Evaluation texts inside a training corpus.

Plan
----
The held-out items (a small table, checked, and scanned in blocks if it is not) become one Aho-Corasick automaton over
their normalised word n-grams.  Every document is normalised once, with the offset of each word in the original kept,
and scanned once.  Items whose n-grams cover enough of them are aligned with the document by a sparse local alignment
that tolerates a few changed, lost or added words; an item leaks if one or two passages in its order carry at least a
third of its words.  Documents are independent of each other: no shuffle, no group, no skew.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(r"<[^<>]{0,200}>|&(?:[a-z]{2,8}|#\d{1,6});|\\[a-zA-Z]{2,12}(?=\W)")
#: A word hyphenated over a line break is one word; zero-width characters and soft hyphens are nothing.
JOINED = re.compile(r"[­​-‍⁠﻿]|(?<=[^\W\d_])[-‐]\s*\n\s*(?=[a-zß-ÿ])")
WORD = re.compile(r"[^\W_]+")

FOUND = "doc_id bigint, item_id bigint, share double, passages array<struct<start:int,stop:int,words:int>>"


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Normalised words with the offsets of their first and one past their last character in ``text``."""
    # Markup and invisible characters are blanked or skipped without moving the offsets of what remains.
    dull = MARKUP.sub(lambda m: " " * len(m[0]), text)
    joined = [m.span() for m in JOINED.finditer(dull)]
    words, starts, stops = [], [], []
    if not joined:
        for m in WORD.finditer(dull):
            words.append(unicodedata.normalize("NFKC", m[0]).lower())
            starts.append(m.start())
            stops.append(m.end())
        return words, starts, stops
    kept, at, origin = [], 0, []
    for a, b in joined:
        kept.append(dull[at:a])
        origin.extend(range(at, a))
        at = b
    kept.append(dull[at:])
    origin.extend(range(at, len(dull)))
    for m in WORD.finditer("".join(kept)):
        words.append(unicodedata.normalize("NFKC", m[0]).lower())
        starts.append(origin[m.start()])
        stops.append(origin[m.end() - 1] + 1)
    return words, starts, stops


def passage(item: dict[str, list[int]], doc: list[str], d_lo: int, d_hi: int, i_lo: int, i_hi: int, gap: int, cost: float) -> tuple[int, int, int, int, int] | None:
    """Best local alignment of document words [d_lo, d_hi) with item words [i_lo, i_hi).

    Returns (matched words, first and one past last document word, the same of the item).  A run of more than ``gap``
    words without a match ends a passage; each such word costs ``cost`` matches.
    """
    best, recent = None, []
    for d in range(d_lo, d_hi):
        fresh = []
        for i in item.get(doc[d], ()):
            if not i_lo <= i < i_hi:
                continue
            score, n, d0, i0 = 1.0, 1, d, i
            for e, j, s, m, e0, j0 in recent:
                if j < i and i - j <= gap + 1:
                    s2 = s + 1.0 - cost * max(d - e - 1, i - j - 1)
                    if s2 > score:
                        score, n, d0, i0 = s2, m + 1, e0, j0
            fresh.append((d, i, score, n, d0, i0))
            if best is None or score > best[0]:
                best = (score, n, d0, d + 1, i0, i + 1)
        if fresh or recent:
            recent = [r for r in recent if d - r[0] <= gap] + fresh
    return best[1:] if best else None


class Scanner:
    """The automaton over a block of items, and the alignment of what it hits."""

    def __init__(self, items: list[tuple[int, str]], n: int = 3, least: float = 1 / 3, seed: float = 0.2, gap: int = 4, cost: float = 1.5, second: int = 5):
        import ahocorasick

        self.least, self.seed, self.gap, self.cost, self.second, self.n = least, seed, gap, cost, second, n
        self.items, self.length, grams = {}, {}, {}
        for item_id, text in items:
            words = words_of(text)[0]
            if not words:
                continue
            places: dict[str, list[int]] = {}
            for k, w in enumerate(words):
                places.setdefault(w, []).append(k)
            self.items[item_id], self.length[item_id] = places, len(words)
            size = min(n, len(words))
            for k in range(len(words) - size + 1):
                grams.setdefault(" " + " ".join(words[k : k + size]) + " ", []).append((item_id, k, size))
        self.automaton = ahocorasick.Automaton()
        for g, at in grams.items():
            self.automaton.add_word(g, at)
        if grams:
            self.automaton.make_automaton()
        self.empty = not grams

    def scan(self, text: str | None) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        if not text or self.empty:
            return []
        words, starts, stops = words_of(text)
        if not words:
            return []
        line = " " + " ".join(words) + " "
        offsets, at = [], 1
        for w in words:
            offsets.append(at)
            at += len(w) + 1
        hits: dict[int, tuple[set, list]] = {}
        for end, found in self.automaton.iter(line):
            last = bisect_right(offsets, end - 1) - 1  # the word before the closing space
            for item_id, k, size in found:
                covered, seen = hits.setdefault(item_id, (set(), []))
                covered.update(range(k, k + size))
                seen.append(last)
        out = []
        for item_id, (covered, seen) in hits.items():
            n = self.length[item_id]
            if len(covered) < self.seed * n:
                continue
            lo, hi = max(0, min(seen) - n), min(len(words), max(seen) + n)
            places = self.items[item_id]
            top = passage(places, words, lo, hi, 0, n, self.gap, self.cost)
            if top is None:
                continue
            m, d0, d1, i0, i1 = top
            parts = [(m, d0, d1)]
            if m < self.least * n:
                sides = [passage(places, words, lo, d0, 0, i0, self.gap, self.cost), passage(places, words, d1, hi, i1, n, self.gap, self.cost)]
                # A few scattered words are no passage.
                other = max((s for s in sides if s), default=None)
                if other and other[0] >= self.second:
                    parts.append(other[:3])
            total = sum(p[0] for p in parts)
            if total >= self.least * n:
                spans = sorted((starts[a], stops[b - 1], k) for k, a, b in parts)
                out.append((item_id, total / n, spans))
        return out


_BUILT: dict[str, Scanner] = {}


def _scanner(key: str, rows: list[tuple[int, str]], options: dict) -> Scanner:
    """The scanner of a block, built once in each Python worker and used by all its tasks."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Scanner(rows, **options)
    return _BUILT[key]


def leaked(documents: DataFrame, items: DataFrame, block: int = 20_000, **options) -> DataFrame:
    """doc_id, item_id, share of the item's words, and the leaked passages as character offsets in the original text.

    ``items`` beyond ``block`` rows are scanned in several blocks, each with its own automaton, so that what every
    Python worker holds has a bound.  Null or empty texts and items match nothing; repeated item ids count once (the
    smallest text); repeated documents are reported as often as they occur.
    """
    held = items.where("text IS NOT NULL AND item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    n = held.count()
    blocks = max(1, -(-n // block))
    out = None
    for b in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = documents.sparkSession.sparkContext.broadcast(sorted((r.item_id, r.text) for r in part.collect()))

        def scan(batches: Iterator[pd.DataFrame], rows=rows, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            scanner = _scanner(key, rows.value, options)
            for batch in batches:
                found = [
                    (doc_id, item_id, share, [{"start": a, "stop": z, "words": k} for a, z, k in spans])
                    for doc_id, text in zip(batch["doc_id"], batch["text"])
                    for item_id, share, spans in scanner.scan(text)
                ]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "share", "passages"])

        one = documents.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(scan, FOUND)
        out = one if out is None else out.unionByName(one)
    return out


def report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item that leaked: documents that carry it and the largest share."""
    held = items.groupBy("item_id").agg(F.min("task").alias("task"), F.min("split").alias("split"))
    per = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("share").alias("max_share"))
    return held.join(per, "item_id", "left").select("item_id", "task", "split", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("max_share", F.lit(0.0)).alias("max_share"))
