"""Text decoded with the wrong character encoding: finding it and, where possible, restoring it.

Plan
----
1. The corpus is reduced to its vocabulary (tokens with their counts; partial aggregation on the map side, so a token
   in every document costs nothing more).  Everything that follows until the last scan works on distinct tokens.
2. A smoothed character trigram model is trained on the clean tokens.  Structure alone excludes most garbled tokens
   (replacement characters, C1 controls, anything that decodes strictly as UTF-8 once re-encoded); two rounds of
   training and scoring exclude the rest.  N-grams are hashed into an array of fixed size (20 MB), whatever the data:
   that is all that reaches the driver and the workers.
3. Every candidate chain of encode-decode steps is scored on clean tokens held out of training; the margins are such
   that false acceptances stay below a rate (see ``fit``).
4. One scan over the documents with characters beyond ASCII takes, per chain, the run of tokens whose summed gain is
   largest, and accepts the likeliest chain beyond its margin.  Characters whose bytes are lost (U+FFFD, C1 controls)
   are a last candidate, in which they are left out: where that is likelier beyond the margin, the text is lost there.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioplan.compat import cut

BINS = 1 << 20  # hashed n-grams per order: the model never exceeds this
CELLS = 5 * BINS + 1  # of trigrams, bigrams, characters, contexts and their second letters, and the number of all at the end
_SPACE = re.compile(r"([ \t\n\r]+)")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_LOST = re.compile(r"�|[\x80-\x9f]")
#: A word mostly of accented Latin letters, or Cyrillic with capitals inside: never training material.
_STRANGE = re.compile(r"^\W*(?:[À-ÿ]\W*){3,}$|[а-яё][А-ЯЁ]")


def _sloppy(codec: str) -> dict[str, int]:
    """Characters of a single-byte code page, with undefined bytes passing through as C1 controls."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    return table


_PAGES = {p: _sloppy(p) for p in ("cp1252", "cp1251", "cp1250", "iso8859_2", "iso8859_15", "mac_roman", "cp437", "cp850", "cp866", "koi8_r")}


def _step(text: str, read_as: str, meant: str) -> str | None:
    """Undoes "bytes of ``meant`` were read as ``read_as``"; None where the text cannot have come about that way."""
    page = _PAGES[read_as]
    try:
        raw = bytes([page[c] for c in text])
        out = raw.decode(meant)
    except (KeyError, UnicodeDecodeError):
        return None
    return out if out != text else None


_SINGLE = [("cp1252", m) for m in ("cp1251", "koi8_r", "cp1250", "iso8859_2", "mac_roman", "cp437", "cp850", "cp866")]
_SINGLE += [("cp1251", m) for m in ("koi8_r", "cp1252", "cp866", "cp1250")] + [("koi8_r", m) for m in ("cp1251", "cp866", "cp1252")]
_SINGLE += [(r, m) for r in ("mac_roman", "cp437", "cp850", "cp1250", "iso8859_2") for m in ("cp1252", "cp1251", "cp1250") if r != m] + [("cp866", "cp1251")]
#: Every chain of steps that is tried, each a tuple of (read as, meant).
CHAINS = [((r, "utf-8"),) for r in _PAGES] + [((a, "utf-8"), (b, "utf-8")) for a in _PAGES for b in _PAGES] + [((r, m),) for r, m in _SINGLE]

#: Chains below this number decode as UTF-8, which other text hardly ever does by chance; the rest swap code pages,
#: which any bytes survive, so that their readings must consist of attested character pairs.
STRICT = len(CHAINS) - len(_SINGLE)


def candidates(token: str) -> dict[str, int]:
    """What the token may have been, with the first chain that gives it."""
    out: dict[str, int] = {}
    for k, chain in enumerate(CHAINS):
        s: str | None = token
        for read_as, meant in chain:
            s = _step(s, read_as, meant)
            if s is None:
                break
        if s and not _CONTROL.search(s):
            out.setdefault(s, k)
    return out


@lru_cache(maxsize=1 << 16)
def _key(order: int, gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BINS + (order - 1) * BINS


@lru_cache(maxsize=1 << 16)
def _cells_of(tri: str) -> tuple[int, int, int, int, int]:
    """The cells of a trigram's last character, last two, all three, first two, and of the middle one."""
    return _key(1, tri[2]), _key(2, tri[1:]), _key(3, tri), _key(4, tri[:2]), _key(5, tri[1])


def _cells(token: str) -> Iterator[tuple[int, int, int, int, int]]:
    s = f"\x02\x02{token}\x03"
    return map(_cells_of, map("".join, zip(s, s[1:], s[2:])))


def gram_weights(token: str, n: int) -> Counter:
    """Hashed trigrams, bigrams, characters and their contexts, weighted by the damped count of the token."""
    c: Counter = Counter()
    w = 1 + math.log(n)
    for cells in _cells(token):
        for k in cells:
            c[k] += w
        c[CELLS - 1] += w
    return c


class Model:
    """Interpolated character trigrams; ``own`` is what a token itself added and is left out when it is scored."""

    def __init__(self, weights: bytes, smoothing: float = 2.0):
        self.w, self.a = array("f"), smoothing
        self.w.frombytes(weights)

    def score(self, token: str, own: Counter | None = None) -> float:
        w, a, total, log = self.w, self.a, 0.0, math.log
        if own is None:
            n = w[CELLS - 1] + 2000
            for one, bi, tri, ctx, head in _cells(token):
                total += log((w[tri] + a * (w[bi] + a * (w[one] + 0.02) / n) / (w[head] + a)) / (w[ctx] + a))
            return total

        def of(k: int) -> float:
            return max(0.0, w[k] - own.get(k, 0.0))

        n = of(CELLS - 1) + 2000
        for one, bi, tri, ctx, head in _cells(token):
            total += log((of(tri) + a * (of(bi) + a * (of(one) + 0.02) / n) / (of(head) + a)) / (of(ctx) + a))
        return total

    def gains(self, token: str, n: int = 0) -> dict[int, tuple[float, str]]:
        """Per chain, the log-likelihood that its reading of the token gains, and the reading."""
        found = candidates(token)
        if not found:
            return {}
        base = self.score(token, gram_weights(token, n) if n else None)
        return {k: (self.score(s) - base, s) for s, k in found.items() if k < STRICT or self._attested(token, s)}

    def _attested(self, token: str, reading: str) -> bool:
        """Every new pair of characters of the reading occurs in clean text."""
        pairs = lambda t: set(zip(f"\x02{t}", f"{t}\x03"))
        return all(self.w[_key(2, a + b)] > 0 for a, b in pairs(reading) - pairs(token))


def vocabulary(documents: DataFrame) -> DataFrame:
    """token, n: white-space tokens of all texts."""
    tokens = documents.select(F.explode(F.split("text", r"[ \t\n\r]+")).alias("token"))
    return tokens.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def _structurally_garbled(token: str) -> bool:
    return bool(_LOST.search(token) or _STRANGE.search(token)) or any(_step(token, r, "utf-8") is not None for r in _PAGES)


def _single_readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(t, n, s) for t, n in zip(b["token"], b["n"]) if len(t) > 1 for s, k in candidates(t).items() if k >= STRICT]
        yield pd.DataFrame(rows, columns=["token", "n", "reading"])


def _train(clean: DataFrame) -> bytes:
    """The cells of the model as 32-bit floats; what comes to the driver is bounded by their fixed number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(CELLS)
        for b in batches:
            total: Counter = Counter()
            for token, n in zip(b["token"], b["n"]):
                total.update(gram_weights(token, n))
            cells[np.fromiter(total.keys(), "int64", len(total))] += np.fromiter(total.values(), "float64", len(total))
        k = np.flatnonzero(cells)
        yield pd.DataFrame({"k": k.astype("int32"), "w": cells[k]})

    rows = clean.mapInPandas(count, "k int, w double").groupBy("k").agg(F.sum("w").cast("float").alias("w")).toPandas()
    cells = np.zeros(CELLS, "float32")
    cells[rows["k"].to_numpy("int64")] = rows["w"].to_numpy("float32")
    return cells.tobytes()


PIECE = 200  # characters of which a very long token is counted and judged at a time


def fit(documents: DataFrame, rounds: int = 2, exclude: float = 3.0, dominance: int = 3, false_rate: float = 1e-3, held_out: int = 10) -> tuple[bytes, float, float]:
    """The model of clean text and the two validated margins: for chains that swap code pages, and those by UTF-8.

    Under clean text, the likelihood ratio of one reading reaches c with a probability of at most 1 / c; over all
    chains of a kind, a gain of log(chains / ``false_rate``) therefore keeps false acceptances below that rate.  The
    margin of code pages is this, or the gain that no more than ``false_rate`` of the clean tokens kept from training
    (every ``held_out``-th, by hash) reach, if that is more.  That a token decodes as UTF-8 is evidence itself: how
    seldom tokens held out do so without a likelier reading is counted, and the margin is less by its logarithm.
    """
    spark = documents.sparkSession

    def structure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(garbled=[not t.isascii() and _structurally_garbled(t) for t in b["token"]])

    # Very long tokens (text without spaces) are judged whole and counted in pieces.
    whole = vocabulary(documents).mapInPandas(structure, "token string, n long, garbled boolean")
    pieces = F.when(F.length("token") > PIECE, F.regexp_extract_all("token", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array("token"))
    vocab = cut(whole.select(F.explode(pieces).alias("token"), "n", "garbled").withColumn("held", F.pmod(F.xxhash64("token"), F.lit(held_out)) == 0))
    clean = vocab.where("NOT garbled")
    strange = clean.where(F.col("token").rlike(r"[^\x00-\x7f]"))
    # A reading that is itself a word of the corpus, and a far more frequent one, convicts a token by counts alone.
    readings = strange.select("token", "n").mapInPandas(_single_readings, "token string, n long, reading string")
    rivals = vocab.select(F.col("token").alias("reading"), F.col("n").alias("rival"))
    convicted = cut(readings.join(rivals, "reading").where(F.col("rival") >= dominance * F.col("n")).select("token").distinct())
    clean = clean.join(convicted, "token", "left_anti")
    for _ in range(rounds):
        weights = spark.sparkContext.broadcast(_train(clean.select("token", "n")))

        def mark(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            m = Model(weights.value)
            for b in batches:
                best = [max((g for g, _ in m.gains(t).values()), default=-math.inf) for t in b["token"]]
                yield pd.DataFrame({"token": b["token"], "gain": best})

        scored = strange.join(convicted, "token", "left_anti").select("token").mapInPandas(mark, "token string, gain double")
        convicted = cut(convicted.unionByName(scored.where(F.col("gain") > exclude).select("token")))
        weights.unpersist()
        clean = vocab.where("NOT garbled").join(convicted, "token", "left_anti")
    weights = spark.sparkContext.broadcast(_train(clean.where("NOT held").select("token", "n")))

    def negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(weights.value)
        for b in batches:
            gains = [m.gains(t) for t in b["token"]]
            swap = [max((g for k, (g, _) in x.items() if k >= STRICT), default=-math.inf) for x in gains]
            utf8 = [max((g for k, (g, _) in x.items() if k < STRICT), default=-math.inf) for x in gains]
            yield pd.DataFrame({"swap": swap, "chance": [int(-math.inf < g <= 0) for g in utf8]})

    beyond = F.col("token").rlike(r"[^\x00-\x7f]")
    kept = clean.where("held").where(beyond).select("token")
    limit = kept.mapInPandas(negatives, "swap double, chance int").agg(F.percentile_approx("swap", 1 - false_rate, 10_000).alias("m")).first().m
    seen = vocab.where("held").where(beyond).select("token").mapInPandas(negatives, "swap double, chance int").agg(F.count("*").alias("n"), F.coalesce(F.sum("chance"), F.lit(0)).alias("chance")).first()
    weights.unpersist()
    least = math.log((len(CHAINS) - STRICT) / false_rate)
    strict = max(0.0, math.log(STRICT / false_rate) + math.log((seen.chance + 1) / (seen.n + 1)))
    return _train(clean.select("token", "n")), max(least, limit if limit is not None else least), strict


#: Characters of no code page, but for the mark of a lost one.
_FOREIGN = re.compile(f"([^�{re.escape(''.join(sorted({c for page in _PAGES.values() for c in page})))}]+)")


class Restorer:
    """Finds and undoes garbled runs of one text; token gains are remembered, for tokens repeat."""

    def __init__(self, model: Model, margin: float, strict: float, remembered: int = 200_000):
        self.model, self.margin, self.remembered, self.strict = model, margin, remembered, strict
        self.cache: dict[str, dict[int, tuple[float, str]]] = {}

    def _gains(self, token: str) -> dict[int, tuple[float, str]]:
        if len(token) > PIECE:
            return self.model.gains(token)
        g = self.cache.get(token)
        if g is None:
            if len(self.cache) >= self.remembered:
                self.cache.clear()
            g = self.cache[token] = self.model.gains(token)
        return g

    def _gone(self, token: str) -> bool:
        """The token is likelier without its characters whose bytes are lost, beyond the margin."""
        return bool(_LOST.search(token)) and self.model.score(_LOST.sub("", token)) - self.model.score(token) > self.strict

    def restore(self, text: str) -> tuple[str, float, list[int], bool]:
        """The restored text, the summed gain, the chains used, and whether something stays lost.

        Tokens end at spaces and at characters of no code page (Chinese, say), which no wrong decoding leaves behind.
        Nothing depends on their length: work grows with it in proportion.
        """
        parts = []
        for k, part in enumerate(_SPACE.split(text)):
            # Tokens stand at even places, what parts them at odd ones.
            parts += [part] if k % 2 or part.isascii() else _FOREIGN.split(part)
        at = [k for k in range(0, len(parts), 2) if not parts[k].isascii()]
        total, used = 0.0, []
        gains = {k: self._gains(parts[k]) for k in at}
        while True:
            best: tuple[float, int, int, int] | None = None
            for chain in {c for g in gains.values() for c in g}:
                run, start = 0.0, 0
                for j, k in enumerate(at):
                    g = gains[k].get(chain)
                    # A token that the chain cannot have produced is foreign to the run.
                    v = g[0] if g else -6.0
                    if run <= 0:
                        run, start = 0.0, j
                    run += v
                    if run > (self.margin if chain >= STRICT else self.strict) and (best is None or run > best[0]):
                        best = (run, chain, start, j)
            if best is None:
                return "".join(parts), total, used, any(self._gone(parts[k]) for k in range(len(parts)))
            gain, chain, a, z = best
            for k in at[a : z + 1]:
                if chain in gains[k]:
                    parts[k] = gains[k][chain][1]
                gains[k] = {}
            total += gain
            used.append(chain)


FOUND = "doc_id bigint, restored string, gain double, chains array<string>, lost boolean"


def garbled(documents: DataFrame, fitted: tuple[bytes, float, float] | None = None) -> DataFrame:
    """doc_id, restored, gain, chains, lost: documents with a stretch that a wrong encoding garbled.

    ``lost``: the text is likelier without replacement characters or C1 controls that no accepted chain explains; it is
    reported even though that stretch cannot be restored.  Null and empty texts and plain ASCII are never garbled.  Repeated
    documents are each reported.
    """
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    weights, margin, strict = fitted or fit(texts)
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(Model(shared.value), margin, strict)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                restored, gain, used, lost = r.restore(text)
                if used or lost:
                    names = sorted({" > ".join(f"{m} read as {p}" for p, m in reversed(CHAINS[c])) for c in used})
                    out.append((doc_id, restored, gain, names, lost))
            yield pd.DataFrame(out, columns=["doc_id", "restored", "gain", "chains", "lost"])

    return texts.where(F.col("text").rlike(r"[^\x00-\x7f]")).mapInPandas(scan, FOUND)
