"""One plain form for text that looks equal but is written with different characters.

Plan
----
1. A string can only change if it holds a character that the tables below touch, or letters of two scripts.  One
   regular expression decides that exactly, so unremarkable strings never leave the scan.
2. Distinct strings of the others are cut into words (each carries the script it is mostly written in), the words exploded to positioned
   code points, and every code point meets its decomposition and its look-alike in broadcast joins.  Both tables are
   derived from Unicode and have a fixed size.
3. Combining marks are ordered by class within their base, recomposed canonically, and the strings rebuilt.
   All steps after the first hash exchange keep its partitioning: code points are never shuffled.
"""

from __future__ import annotations


import sys
import unicodedata as ud
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Letters drawn alike.  Per script, each letter of the first string looks like the Latin letter below it.
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҮԌԛԝаеѕіјорсухүԁһӏ", "ABESIJKMHOPCTYXYGqwaesijopcyxydhl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυι", "ABEZHIKMNOPTYXovpui"),
    "Armenian": ("ՍՏՕհոսցօ", "USOhnugo"),
}
#: Invisible characters besides those of category Cf: fillers and variation selectors.
_INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
#: Cf characters that are visible or carry meaning in their script (Arabic number signs and the like).
_VISIBLE_CF = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2, 0x890, 0x891, 0x110BD, 0x110CD}
#: Compatibility decompositions that only change how an ordinary letter or digit is drawn.
_DRAWN = {"<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
_HANGUL = range(0xAC00, 0xD7A4)


@lru_cache(maxsize=1)
def tables() -> dict:
    """Decomposition of each touched character, combining classes, composition pairs, and the joining second halves."""
    decomposed, classes, pairs = {}, {}, {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or cp in _HANGUL:
            continue
        c = chr(cp)
        cat = ud.category(c)
        if cat == "Cn" or cat == "Co":
            continue
        if ud.combining(c):
            classes[c] = ud.combining(c)
        if cat == "Cf" and cp not in _VISIBLE_CF or c in _INVISIBLE:
            decomposed[c] = ""
        elif cat == "Zs":
            decomposed[c] = " "
        elif d := ud.decomposition(c):
            kind = d.split()[0]
            if kind[0] != "<":
                decomposed[c] = ud.normalize("NFD", c)
                if ud.normalize("NFC", decomposed[c]) == c and len(two := d.split()) == 2:
                    pairs["".join(chr(int(x, 16)) for x in two)] = c
            elif kind in _DRAWN and (cat[0] == "L" or cat == "Nd"):
                decomposed[c] = ud.normalize("NFKD", c)
            elif kind in {"<wide>", "<narrow>"} and cat[0] in "PSZ":
                decomposed[c] = ud.normalize("NFKD", c)
    for cp in [*range(1, 32), 127]:
        if chr(cp) not in "\t\n\v\f\r":
            decomposed[chr(cp)] = ""
    joiners = {p[1] for p in pairs if p[1] not in classes} | {chr(x) for x in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    return {"decomposed": decomposed, "classes": classes, "pairs": pairs, "joiners": joiners}


def _ranges(chars) -> str:
    """A regular-expression class of the characters."""
    out, cps = [], sorted(map(ord, chars))
    k = 0
    while k < len(cps):
        j = k
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\x{{{cps[k]:x}}}" + (f"-\\x{{{cps[j]:x}}}" if j > k else ""))
        k = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def _suspect_pattern() -> str:
    """Matches every string that the operator could change, and few others."""
    t = tables()
    composed = {c for c, d in t["decomposed"].items() if ud.normalize("NFC", d) == c}
    touched = (set(t["decomposed"]) - composed) | set(t["classes"]) | t["joiners"]
    foreign = "".join(f"\\p{{Is{s}}}" for s in LOOK_ALIKES)
    return f"[{_ranges(touched)}]|\\p{{IsLatin}}[\\p{{L}}\\p{{M}}\\p{{N}}]*[{foreign}]|[{foreign}][\\p{{L}}\\p{{M}}\\p{{N}}]*\\p{{IsLatin}}|" + "|".join(
        f"\\p{{Is{a}}}[\\p{{L}}\\p{{M}}\\p{{N}}]*\\p{{Is{b}}}" for a in LOOK_ALIKES for b in LOOK_ALIKES if a != b
    )


def _suspect(c: Column) -> Column:
    """Whether the string could change; printable ASCII alone never does, and is quick to test for."""
    return c.rlike(r"[^\x20-\x7e]") & c.rlike(_suspect_pattern())


def _count(c: Column, cls: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{cls}]", ""))


def _word_script(word: Column) -> Column:
    """The script of a word: where letters no other script could imitate are, else where most letters are."""
    scripts = ["Latin", *LOOK_ALIKES]
    shared = {s: _ranges(a) for s, (a, _) in LOOK_ALIKES.items()} | {"Latin": _ranges({x for _, b in LOOK_ALIKES.values() for x in b})}
    # Math and full-width letters are Latin to a reader; full-width ones are in the Latin script already.
    cls = {s: f"\\p{{Is{s}}}" + ("\\x{1d400}-\\x{1d6a5}" if s == "Latin" else "") for s in scripts}
    ranked = F.array(*[F.struct((_count(word, f"{cls[s]}&&[^{shared[s]}]")).alias("own"), _count(word, cls[s]).alias("all"), F.lit(-k).alias("k"), F.lit(s).alias("script")) for k, s in enumerate(scripts)])
    mixed = sum((F.when(_count(word, cls[s]) > 0, 1).otherwise(0) for s in scripts), F.lit(0)) > 1
    # Scripts that imitate Latin and nothing of their own: what they imitate is meant.
    best = F.array_max(ranked)
    present = sum((F.when(_count(word, cls[s]) > 0, 1).otherwise(0) for s in LOOK_ALIKES), F.lit(0))
    return F.when(mixed, F.when((best["own"] == 0) & (present > 1), "Latin").otherwise(best["script"]))


def _compose(cells: Column) -> Column:
    """Canonical composition of one base and its marks, which are in canonical order: array<struct<ch, ccc>>."""
    t = tables()
    by_second: dict[str, list] = {}
    for p, c in t["pairs"].items():
        by_second.setdefault(p[1], []).append((p[0], c))
    pair_map = F.create_map(*[x for m, xs in sorted(by_second.items()) for x in (F.lit(m), F.create_map(*[F.lit(y) for ac in xs for y in ac]))])

    def step(acc: Column, cell: Column) -> Column:
        base, ch = acc["base"], cell["ch"]
        known = F.try_element_at(F.try_element_at(pair_map, ch), base)
        lead, vowel, tail = F.ascii(base) - 0x1100, F.ascii(ch) - 0x1161, F.ascii(ch) - 0x11A7
        syllable = F.when(lead.between(0, 18) & vowel.between(0, 20), 0xAC00 + (lead * 21 + vowel) * 28).when(
            (F.ascii(base).between(0xAC00, 0xD7A3)) & ((F.ascii(base) - 0xAC00) % 28 == 0) & tail.between(1, 27), F.ascii(base) + tail
        )
        hangul = F.when(syllable.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(syllable), 4, "0")), "UTF-16BE"))
        new = F.when((acc["rest"] == "") | (acc["ccc"] < cell["ccc"]), F.coalesce(known, hangul))
        return F.when(
            new.isNotNull(), F.struct(new.alias("base"), acc["rest"].alias("rest"), acc["ccc"].alias("ccc"))
        ).otherwise(F.struct(base.alias("base"), F.concat(acc["rest"], ch).alias("rest"), cell["ccc"].alias("ccc")))

    start = F.struct(cells[0]["ch"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("ccc"))
    return F.when(F.size(cells) == 1, cells[0]["ch"]).otherwise(F.aggregate(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), start, step, lambda a: F.concat(a["base"], a["rest"])))


def _decompositions(spark: SparkSession) -> DataFrame:
    t = tables()
    rows = []
    for c in {*t["decomposed"], *t["classes"], *t["joiners"]}:
        parts = [(x, t["classes"].get(x, 0), x in t["classes"] or x in t["joiners"]) for x in t["decomposed"].get(c, c)]
        rows.append((c, parts))
    return spark.createDataFrame(rows, "ch string, parts array<struct<ch:string,ccc:int,joins:boolean>>")


def _look_alikes(spark: SparkSession) -> DataFrame:
    rows = []
    for s, (a, b) in LOOK_ALIKES.items():
        rows += [(x, "Latin", y) for x, y in zip(a, b)]
        rows += [(y, s, x) for x, y in zip(a, b)]  # of two letters drawn alike the first, ordinary one
    # Between two scripts that both look like Latin.
    for s, (a, b) in LOOK_ALIKES.items():
        for r, (c, d) in LOOK_ALIKES.items():
            if r != s:
                back = dict(reversed(list(zip(d, c))))
                rows += [(x, r, back[y]) for x, y in zip(a, b) if y in back]
    once = {(x, s): y for x, s, y in reversed(rows)}
    return spark.createDataFrame([(x, s, y) for (x, s), y in once.items()], "base string, script string, alike string")


def plain_form(df: DataFrame, column: str, out: str = "plain") -> DataFrame:
    """Adds ``out``: ``column`` in its plain form (composed accents, ordinary letters, plain spaces, nothing invisible).

    Null stays null, an empty string empty; case, dashes, quotes and symbols stay.  Any other columns pass through,
    whatever their names; rows and repeated rows are kept one to one.  Texts of any length are rebuilt whole.
    """
    return _with_unchanged(df, column, out)


def _with_unchanged(df: DataFrame, column: str, out: str) -> DataFrame:
    suspect = F.coalesce(_suspect(F.col(f"`{column}`")), F.lit(False))
    rest = df.where(~suspect).withColumn(out, F.col(column))
    return rest.unionByName(changed_form(df.where(suspect), column, out))


def changed_form(df: DataFrame, column: str, out: str) -> DataFrame:
    """``plain_form`` of rows that may change (see ``_suspect_pattern``); any non-null strings are allowed."""
    spark = df.sparkSession
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.sha2(F.col(f"`{column}`"), 256).alias("h"), F.col(f"`{column}`").alias("s"))
    # Distinct strings only, each keyed by its own digest: later groupings on (h, ...) need no other exchange than this
    # one, and a string in any number of rows is rebuilt once.
    keyed = held.groupBy("h").agg(F.min("s").alias("s"))
    words = keyed.select("h", F.posexplode(F.regexp_extract_all("s", F.lit(r"(?s)[\p{L}\p{M}\p{N}\p{Cf}]+|[^\p{L}\p{M}\p{N}\p{Cf}]+"), F.lit(0))).alias("w", "word"))
    # The script of a word is settled before the word is exploded, once and not per code point.
    words = words.withColumn("script", _word_script(F.col("word")))
    cells = words.select("h", "w", "script", F.posexplode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("p", "ch"))
    cells = cells.join(F.broadcast(_decompositions(spark)), "ch", "left")
    itself = F.array(F.struct(F.col("ch").alias("ch"), F.lit(0).alias("ccc"), F.lit(False).alias("joins")))
    cells = cells.select("h", "w", "p", "script", F.posexplode(F.coalesce("parts", itself)).alias("q", "part"))
    cells = cells.select("h", "w", "p", "q", "script", F.col("part.ch").alias("base"), F.col("part.ccc").alias("ccc"), F.col("part.joins").alias("joins"))
    cells = cells.join(F.broadcast(_look_alikes(spark)), ["base", "script"], "left").withColumn("ch", F.coalesce("alike", "base"))
    order = Window.partitionBy("h").orderBy("w", "p", "q")
    cells = cells.withColumn("seq", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    rank = F.struct("ccc", "w", "p", "q")  # canonical order: stable by class; a base has class 0
    pieces = cells.groupBy("h", "seq").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "ch", "ccc"))).alias("cells"))
    pieces = pieces.select("h", "seq", _compose(F.transform("cells", lambda c: F.struct(c["ch"].alias("ch"), c["ccc"].alias("ccc")))).alias("piece"))
    texts = pieces.groupBy("h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("plain"))
    # left: a string of invisible characters alone leaves no code point behind
    done = held.select("row", "h").join(texts, "h", "left")
    return done.select("row.*", F.coalesce("plain", F.lit("")).alias(out))


def paper_strings(papers: DataFrame) -> DataFrame:
    """paper_id, field, pos, value: every title and author name."""
    titles = papers.select(F.col("id").alias("paper_id"), F.lit("title").alias("field"), F.lit(0).alias("pos"), F.col("title").alias("value"))
    names = papers.select(F.col("id").alias("paper_id"), F.lit("authors").alias("field"), F.posexplode("authors").alias("pos", "value"))
    return titles.unionByName(names).where(F.col("value").isNotNull())


def changed(papers: DataFrame) -> DataFrame:
    """paper_id, field, pos, value, plain of each value that is not in its plain form; repeated rows count once."""
    rows = paper_strings(papers)
    suspects = rows.where(_suspect(F.col("value"))).distinct()
    return changed_form(suspects, "value", "plain").where("plain <> value")


