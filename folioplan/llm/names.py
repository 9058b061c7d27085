"""Variant spellings of people's and organisations' names.

Plan (merge and rematch)
------------------------
1. Distinct name strings are parsed once into surname, given name, middle initials (or the words of an organisation).
   What is equal after folding starts as one entity.
2. What a form asks for and answers to is computed once: formal names of a nickname, all prefixes of a given name (an
   initial is a prefix of length one), words typed almost so (met by deletion neighbours) by hardly anyone else, or few
   beside those of the other word.
3. Each round, entities ask with the keys of their members and of their united profile: every given name they own with
   the surname and the middle initials of all members, spelled or not.  Keys are aggregated to (number of entities, one
   entity) before the join, so a question meets one row per key and no pairs within a block are ever formed.  A
   question that names exactly one other entity merges into it.
4. Merged entities re-enter with their richer profiles until no merge occurs.  Then initials that several bearers share
   are decided by co-authors, where those point to one of them, and the rounds go on from there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioplan.compat import cut, release
from folioplan.llm.visual import LOOK_ALIKES

_ALIKE = str.maketrans({x: y for a, b in LOOK_ALIKES.values() for x, y in zip(a, b)})
_LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ı": "i", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D"})

#: Short and familiar forms of given names.
NICKNAMES = """
abigail abby gail; alexander alex sandy sasha xander; alexandra alex sandra sasha; andrew andy drew; anthony tony; barbara barb babs; benjamin ben benny; catherine cathy cate kate;
charlotte lottie charlie; christopher chris kit topher; cornelius neil con; daniel dan danny; deborah deb debbie; dmitri dima mitya; dorothy dot dolly; edward ed eddie ted ned teddy; ekaterina katya;
elizabeth liz beth betty eliza lizzie libby bess; felipe pipe; francisco paco pancho curro; frederick fred freddie rick; friedrich fritz; gabriella gabi gabby ella; giuseppe beppe peppe; gregory greg;
guadalupe lupe; gwendolyn gwen wendy; henry harry hank; ignacio nacho; james jim jimmy jamie; jennifer jen jenny; joaquin quino; johannes hannes jan; john jack johnny; jonathan jon jonny nathan; jose pepe;
joseph joe joey; katherine kathy kate katie kit kay; leonardo leo nardo; lorenzo renzo; magdalena magda lena; margaret maggie peggy meg marge greta; mathilde tilda tilly; matthew matt; michael mike mick mickey;
mikhail misha; natalia natasha nata talia; nicholas nick nico nicky; patricia pat patty tricia trish; rafael rafa rafi; rebecca becky; reinhard hardy; richard rick dick rich richie; robert bob rob bobby bert robbie;
rosalind roz rosie linda; samuel sam sammy; sebastian bastian seb basti; stephen steve steph; susan sue susie suzy; svetlana sveta lana; tadeusz tadek; thaddeus thad tad; theodore ted theo teddy; thomas tom tommy;
timothy tim timmy; ulrich uli; ursula ursel uschi; valentina valya tina val; vasilisa vasya; victoria vicky tori vicki; vladimir volodya vova vlad; wilhelmina mina willa billie minnie; william bill will billy liam;
winifred winnie freda; xavier xavi javi; yevgenia zhenya; zachary zach zack zak; zbigniew zbyszek
"""
#: Words that make a name an organisation's.
ORGANISATIONS = ("academy", "agency", "alliance", "association", "authority", "bureau", "centre", "center", "collaboration", "college", "committee", "company", "consortium", "corporation", "council", "department", "faculty", "foundation", "group", "hospital", "initiative", "institut", "institute", "institution", "laboratories", "laboratory", "library", "ministry", "museum", "network", "observatory", "office", "organisation", "organization", "partnership", "programme", "program", "project", "school", "service", "society", "survey", "team", "trust", "union", "university", "workshop")
_ORG_STEMS = tuple(sorted({w[:4] for w in ORGANISATIONS}))


def _familiar() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in NICKNAMES.replace("\n", " ").split(";"):
        formal, *short = line.split()
        for s in short:
            out.setdefault(s, []).append(formal)
    return out


FAMILIAR = _familiar()


def fold_case(text: str) -> str:
    """Without accents, invisible characters and look-alikes, but with its capitals."""
    t = unicodedata.normalize("NFKD", text)
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", t.translate(_ALIKE).translate(_LETTERS).replace("’", "'")).strip()


def _organisation_word(word: str) -> bool:
    w = word.lower().rstrip(".")
    return w in ORGANISATIONS or word.endswith(".") and len(w) >= 4 and any(o.startswith(w) for o in ORGANISATIONS) or len(w) > 6 and any(_near(w, o) for o in ORGANISATIONS if abs(len(o) - len(w)) < 2)


def _near(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] or (len(a) == len(b) and a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def parse(name: str) -> tuple[str, str, str, str, bool]:
    """(kind, surname, given, middle initials, whether the order is certain); kind 'p' person, 'o' organisation, '' none.

    Of an organisation, surname holds its words without articles, in alphabetical order.
    """
    t = fold_case(name)
    t = re.sub(r"^(?:dr|prof|professor|mr|mrs|ms|sir)\.?\s+", "", t, flags=re.I)
    t = re.sub(r",?\s+(?:jr|sr|phd|md)\.?$", "", t, flags=re.I)
    if not re.search(r"[^\W\d_]", t) or re.fullmatch(r"\W*et\.?\s*al\.?\W*|(?:n/?a|none|null|unknown|anonymous|others?)\W*", t, re.I):
        return "", "", "", "", False
    words = [w for w in re.findall(r"[^\s,;/()]+", t) if re.search(r"\w", w)]
    if len(words) >= 2 and any(_organisation_word(w) for w in words):
        kept = sorted(re.sub(r"[^\w.]", "", w).lower() for w in words if w.lower() not in ("the", "of", "and", "for", "&"))
        return "o", " ".join(kept), "", "", True
    left, comma, right = t.partition(",")
    if comma and right.strip() and left.strip():
        surname = re.sub(r"[\W_]", "", left).lower()
        given, middle = _given(right.split())
        return "p", surname, given, middle, True
    parts = t.replace(",", " ").split()
    if len(parts) == 1:
        return "p", re.sub(r"[\W_]", "", parts[0]).lower(), "", "", True
    if _initials(parts[-1], parts[0]) and not _initials(parts[0], parts[-1]):
        given, middle = _given([c for c in re.sub(r"\W", "", parts[-1])])
        return "p", re.sub(r"[\W_]", "", "".join(parts[:-1])).lower(), given, middle, True
    given, middle = _given(parts[:-1])
    sure = len(re.sub(r"\W", "", given)) <= 1 or parts[0].endswith(".")
    if parts[0].isupper() and len(re.sub(r"\W", "", parts[0])) > 3 and not parts[-1].isupper():  # LAST First
        given, middle = _given(parts[1:])
        return "p", re.sub(r"[\W_]", "", parts[0]).lower(), given, middle, True
    return "p", re.sub(r"[\W_]", "", parts[-1]).lower(), given, middle, sure


def _initials(word: str, other: str) -> bool:
    bare = re.sub(r"\W", "", word)
    return 0 < len(bare) <= 3 and bare.isupper() and (len(bare) == 1 or not other.isupper())


def _given(words: list[str]) -> tuple[str, str]:
    """Given name (with a trailing "." where abbreviated) and middle initials."""
    pieces = [w for w in words if re.search(r"\w", w)]
    if not pieces:
        return "", ""
    first, rest = pieces[0], pieces[1:]
    letters = re.sub(r"\W", "", first).lower()
    if re.fullmatch(r"[A-Z]\.?-[A-Z]\.?", first):  # "J.-L." abbreviates one double name
        return letters[0], "".join(re.sub(r"\W", "", w)[:1].lower() for w in rest)
    if re.fullmatch(r"(?:[A-Z]\.){2,}|[A-Z]{2,3}", first) and not rest:  # "J.L.", "YA"
        return letters[0], letters[1:]
    while rest and not rest[0].endswith(".") and re.search(r"[^\W\d_].*[^\W\d_]", rest[0]) and not rest[0].isupper() and len(re.sub(r"\W", "", first)) > 1:
        first, rest = first + rest[0], rest[1:]  # "Mei Ling"
    bare = re.sub(r"[\W_]", "", first).lower()
    if first.endswith(".") and len(bare) > 1:
        bare += "."
    middle = "".join(re.sub(r"\W", "", w)[:1].lower() for w in rest)
    return bare, middle


def half_of(name: str) -> str:
    """First half of a double given name ("Hans" of "Hans-Peter", "Mei" of "Mei Ling"); "" where there is none."""
    t = fold_case(name)
    m = re.search(r"(?:^|,\s*|\s)([^\W\d_]{2,})-[^\W\d_]{2,}", t)
    kind, surname, given, _, _ = parse(name)
    half = m[1].lower() if m else ""
    if not half:
        half = next((w.lower() for w in re.findall(r"[^\W\d_]{2,}", t) if given.startswith(w.lower()) and w.lower() != given), "")
    return half if kind == "p" and half and given.startswith(half) and given != half else ""


_PARSED = "name string, n long, kind string, surname string, given string, middle string, sure boolean, half string"


def spellings(papers: DataFrame) -> DataFrame:
    """Distinct author strings with the papers that hold them, parsed; an author named twice in a paper counts once."""
    names = papers.select("id", F.explode(F.array_distinct("authors")).alias("name")).where("name IS NOT NULL AND trim(name) <> ''").distinct()
    counted = names.groupBy("name").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(a, n, *parse(a), half_of(a)) for a, n in zip(b["name"], b["n"])]
            yield pd.DataFrame(rows, columns=["name", "n", "kind", "surname", "given", "middle", "sure", "half"])

    return counted.mapInPandas(run, _PARSED).where("kind <> '' AND surname <> ''")


def _oriented(parsed: DataFrame) -> DataFrame:
    """Swaps "Last First" written without a comma, by how often each word is a given name elsewhere."""
    full = parsed.where("kind = 'p' AND length(given) > 1 AND NOT endswith(given, '.')")
    uses = full.select("given", F.explode(F.array(F.struct(F.col("given").alias("w"), F.lit(1.0).alias("g"), F.lit(0.0).alias("s")), F.struct(F.col("surname").alias("w"), F.lit(0.0).alias("g"), F.lit(1.0).alias("s")))).alias("x"), "sure")
    weight = F.when(F.col("sure"), 3.0).otherwise(1.0)
    stats = uses.groupBy("x.w").agg((F.sum(F.col("x.g") * weight) + 0.5).alias("g"), (F.sum(F.col("x.s") * weight) + 0.5).alias("s")).select("w", F.log(F.col("g") / F.col("s")).alias("odds"))
    one = stats.select(F.col("w").alias("given"), F.col("odds").alias("og"))
    two = stats.select(F.col("w").alias("surname"), F.col("odds").alias("os"))
    j = parsed.join(one, "given", "left").join(two, "surname", "left")
    swap = (F.col("kind") == "p") & ~F.col("sure") & (F.length("given") > 1) & (F.col("middle") == "") & (F.coalesce("os", F.lit(0.0)) - F.coalesce("og", F.lit(0.0)) > 0.7)
    return j.select("name", "n", "kind", F.when(swap, F.col("given")).otherwise(F.col("surname")).alias("surname"), F.when(swap, F.col("surname")).otherwise(F.col("given")).alias("given"), "middle", "half")


def _deletions(c: Column) -> Column:
    """The word and each of its forms with one character left out."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.concat(F.substring(c, F.lit(1), k - 1), F.substring(c, k + 1, F.length(c))))))


def _typo(a: Column, b: Column) -> Column:
    d = F.levenshtein(a, b)
    swapped = (d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.greatest(F.length(a), F.length(b)) >= 4) & ((d == 1) | swapped)


#: A word is rare beside another if that one goes with at least so many times as many names.
SHARE = 10


def _uses(facts: DataFrame) -> DataFrame:
    """role, word, use, n, odd: given names (role g) and surnames (s), how many names of the other role each goes with.

    A word typed wrong goes with hardly any.  Odd are those that go with at most 2, or with a small share of the names
    of a word typed almost so; the more names there are, the more of them share one mistyping.
    """
    roles = F.array(
        F.when(F.col("full"), F.struct(F.lit("g").alias("role"), F.col("given").alias("word"), F.col("surname").alias("beside"))),
        F.when(F.col("kind") == "p", F.struct(F.lit("s").alias("role"), F.col("surname").alias("word"), F.when(F.col("full"), F.col("given")).alias("beside"))),
    )
    rows = facts.select("n", F.explode(F.array_compact(roles)).alias("r")).select("n", "r.*")
    uses = cut(rows.groupBy("role", "word").agg(F.count_distinct("beside").alias("use"), F.sum("n").alias("n")))
    cells = uses.select("role", "word", "use", F.explode(_deletions(F.col("word"))).alias("key"))
    often = cells.where(F.col("use") > 2 * SHARE).select("role", "key", F.col("word").alias("word2"), F.col("use").alias("use2"))
    beside = cells.where("use > 2").join(often, ["role", "key"]).where((F.col("use") * SHARE <= F.col("use2")) & _typo(F.col("word"), F.col("word2")))
    few = beside.select("role", "word", F.lit(True).alias("few")).distinct()
    return cut(uses.join(few, ["role", "word"], "left").select("role", "word", "use", "n", ((F.col("use") <= 2) | F.coalesce("few", F.lit(False))).alias("odd")))


def _prefixes(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.substring(c, F.lit(1), k))


def _facts(named: DataFrame, nicknames: dict[str, list[str]]) -> DataFrame:
    """One row per form: its parts, and the formal names of a familiar one."""
    forms = named.groupBy("form").agg(*[F.first(c).alias(c) for c in ("kind", "surname", "given", "middle")], F.max("half").alias("half"), F.sum("n").alias("n"))
    forms = forms.withColumn("full", (F.col("kind") == "p") & (F.length("given") > 1) & ~F.col("given").endswith("."))
    familiar = F.broadcast(named.sparkSession.createDataFrame(list(nicknames.items()), "given string, formals array<string>"))
    return forms.join(familiar, "given", "left")


def _key(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.lit(x) if isinstance(x, str) else x for x in parts])


def _asks() -> Column:
    """The keys that a name asks for."""
    none = F.array().cast("array<string>")
    full, cut_off = F.col("full"), (F.col("kind") == "p") & ~F.col("full") & (F.col("given") != "")
    surname, given, p, initial, has_middle = F.col("surname"), F.col("given"), F.regexp_replace("given", r"\.", ""), F.substring("middle", 1, 1), F.col("middle") != ""
    familiar = full & F.col("formals").isNotNull()
    return F.concat(
        F.when(full & ~has_middle, F.array(_key("e", surname, given))).otherwise(none),  # the same name with a middle initial
        F.when(familiar, F.transform("formals", lambda w: _key("f", surname, w))).otherwise(none),  # the formal name of a familiar one,
        F.when(familiar, F.transform("formals", lambda w: _key("F", surname, w))).otherwise(none),  # or another familiar one of it
        F.when(cut_off & has_middle, F.array(_key("m", surname, p, initial))).otherwise(none),  # initials and abbreviations, with
        F.when(cut_off, F.array(_key("i", surname, p))).otherwise(none),  # and without middle
        F.when(full, F.array(_key("h", surname, given))).otherwise(none),  # a double name of which only the first half is written
    )


def _answers() -> Column:
    """The keys that a name answers to."""
    none = F.array().cast("array<string>")
    full, surname, given, initial, has_middle = F.col("full"), F.col("surname"), F.col("given"), F.substring("middle", 1, 1), F.col("middle") != ""
    familiar = full & F.col("formals").isNotNull()
    # An initial stands for the formal name: "T." is Theodore, not Tony.
    short_of = F.when(~familiar, _prefixes(given)).when(F.size("formals") == 1, _prefixes(F.get("formals", F.lit(0)))).otherwise(none)
    return F.concat(
        F.when(full & has_middle, F.array(_key("e", surname, given))).otherwise(none),
        F.when(full, F.array(_key("f", surname, given), _key("w", surname, given), _key("t", F.substring(given, 1, 1), surname))).otherwise(none),
        F.when(familiar & (F.size("formals") == 1), F.transform("formals", lambda w: _key("F", surname, w))).otherwise(none),
        F.when(full & has_middle, F.transform(short_of, lambda w: _key("m", surname, w, initial))).otherwise(none),
        F.when(full, F.transform(short_of, lambda w: _key("i", surname, w))).otherwise(none),
        F.when(full & (F.col("half") != ""), F.array(_key("h", surname, F.col("half")))).otherwise(none),
    )


def _words(facts: DataFrame) -> DataFrame:
    """form, n, tag, fixed, word, role, asks, answers: the words of a name that may be typed wrong, beside what is fixed.

    Tags: g a given name beside its surname, s a surname beside its given name, t a surname beside an initial, o a word
    of an organisation beside its other words.
    """
    parts, full = F.split("surname", " "), F.col("full")

    def word(tag: str, fixed: Column, w: Column, role: str, asks: Column, answers: Column) -> Column:
        return F.struct(F.lit(tag).alias("tag"), fixed.alias("fixed"), w.alias("word"), F.lit(role).alias("role"), asks.alias("asks"), answers.alias("answers"))

    def body(k: Column) -> Column:
        rest = F.regexp_replace(F.array_join(F.concat(F.slice(parts, F.lit(1), k - 1), F.slice(parts, k + 1, F.size(parts))), " "), r"\.", "")
        return word("o", rest, F.element_at(parts, k), "o", F.lit(True), F.lit(True))

    persons = F.array(
        word("g", F.col("surname"), F.col("given"), "g", full, full),
        word("s", F.col("given"), F.col("surname"), "s", full, full),
        word("t", F.substring("given", 1, 1), F.col("surname"), "s", (F.col("kind") == "p") & (F.length("given") == 1), full),
    )
    bodies = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts)), body))
    cells = facts.select("form", F.col("n").cast("long").alias("n"), F.explode(F.when(F.col("kind") == "o", bodies).otherwise(persons)).alias("c"))
    return cells.select("form", "n", "c.*").where(F.col("asks") | F.col("answers"))


def _slips(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(form, tag, key) and (form, key) of words typed almost so, and of abbreviated words of organisations.

    Words meet in what is left when a letter goes, beside the same fixed part; nothing here depends on who is merged.
    """
    words = cut(_words(facts))
    uses = _uses(facts).select("role", "word", "use", F.col("n").alias("bearers"), "odd")
    per = words.groupBy("tag", "fixed", "word", "role").agg(F.sum("n").alias("n"), F.max("asks").alias("asks"), F.max("answers").alias("answers")).join(uses, ["role", "word"], "left")
    # Surnames are told apart by all their bearers, not only those beside one given name.
    n = F.when(F.col("role") == "s", F.col("bearers")).otherwise(F.col("n"))
    per = per.select("tag", "fixed", "word", F.coalesce("use", F.lit(0)).alias("use"), n.alias("n"), (F.col("asks") & F.coalesce("odd", F.lit(True))).alias("asks"), "answers")
    cells = cut(per.where("asks OR answers").withColumn("less", F.explode(_deletions(F.col("word")))))
    right = cells.where("answers").select("tag", "fixed", "less", F.col("word").alias("word2"), F.col("use").alias("use2"), F.col("n").alias("n2"))
    j = cells.where("asks").join(right, ["tag", "fixed", "less"]).where(F.col("word") != F.col("word2"))
    x, y = F.regexp_replace("word", r"\.", ""), F.regexp_replace("word2", r"\.", "")
    rare = (F.col("use") <= 2) | (F.col("use") * SHARE <= F.col("use2"))
    person = (F.col("tag") != "o") & rare & _typo(F.col("word"), F.col("word2")) & ((F.col("use2") > 2) | (F.col("n2") > F.col("n")))
    organisation = (F.col("tag") == "o") & _typo(x, y) & ((F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("word") > F.col("word2"))))
    met = j.where(person | organisation).select("tag", "fixed", "word", "word2").distinct()
    wanted = words.where("asks").join(met, ["tag", "fixed", "word"])
    key = F.when(F.col("tag") == "g", _key("w", F.col("fixed"), F.col("word2"))).when(F.col("tag") == "s", _key("w", F.col("word2"), F.col("fixed"))).when(F.col("tag") == "t", _key("t", F.col("fixed"), F.col("word2"))).otherwise(_key("o", F.col("fixed"), F.col("word2")))
    bodies = words.where("tag = 'o'")
    short = bodies.where("word LIKE '%_.'").select("form", F.lit("p").alias("tag"), _key("p", F.col("fixed"), F.regexp_replace("word", r"\.", "")).alias("key"))
    asks = wanted.select("form", "tag", key.alias("key")).unionByName(short)
    spelled = bodies.where("NOT endswith(word, '.') AND length(word) > 1")
    stems = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: _key("p", F.col("fixed"), F.substring(F.col("word"), F.lit(1), k)))
    answers = bodies.select("form", _key("o", F.col("fixed"), F.col("word")).alias("key")).unionByName(spelled.select("form", F.explode(stems).alias("key")))
    return asks, answers


def _keys(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What every form asks for and answers to, once for all rounds; answers nobody asks for are left out."""
    slip_asks, slip_answers = _slips(facts)
    own = facts.select("form", F.explode(_asks()).alias("key"))
    asks = cut(own.select("form", F.substring("key", 1, 1).alias("tag"), "key").unionByName(slip_asks).distinct())
    answers = facts.select("form", F.explode(_answers()).alias("key")).unionByName(slip_answers)
    # United profiles are spelled out and never ask for initials or prefixes, so those keys can be left out here.
    asked = asks.where("tag IN ('m', 'i', 't', 'o', 'p')").select("key").distinct()
    fixed = F.substring("key", 1, 1).isin("m", "i", "t", "o", "p")
    answers = answers.where(~fixed).unionByName(answers.where(fixed).join(asked, "key", "left_semi").select("form", "key"))
    return asks, cut(answers.distinct())


def _profiles(state: DataFrame) -> DataFrame:
    """Per entity what its members unite to: how many, the surname most often written, the longest middle initials."""
    weight = F.struct("n", "surname")
    longest = F.struct(F.length("middle"), "middle")
    return state.groupBy("entity").agg(F.count("*").alias("size"), F.max(F.when(F.col("kind") == "p", weight))["surname"].alias("united"), F.max(longest)["middle"].alias("middles"), F.max("full").alias("settled"))


def _united(state: DataFrame, profiles: DataFrame) -> DataFrame:
    """Names that no member writes but the merged entity has: each given name with the surname and initials of all."""
    merged = profiles.where("size > 1 AND settled")
    rows = state.where("full").drop("surname", "middle").join(merged, "entity")
    return rows.select("entity", "kind", F.col("united").alias("surname"), "given", F.col("middles").alias("middle"), "half", "formals", "full").distinct()


def _named(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(entity, target): entities whose keys of one tag name exactly one other entity of ``held``."""
    one = held.groupBy("key").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"), F.count("*").alias("owners"))
    hit = asked.join(one, "key")
    # Who owns a key itself has its name already and is not drawn to the other owner, but for two familiar forms of
    # one name, neither of which is the formal one.
    own = (F.col("lo") == F.col("entity")) | (F.col("hi") == F.col("entity"))
    other = F.when(F.col("owners") == 1, F.col("lo")).when((F.col("owners") == 2) & own & (F.col("tag") == "F"), F.when(F.col("lo") == F.col("entity"), F.col("hi")).otherwise(F.col("lo")))
    other = F.when(other != F.col("entity"), other)
    ambiguous = ((F.col("owners") > 2) | (F.col("owners") == 2) & ~own).cast("int")
    found = hit.select("entity", "tag", other.alias("target"), ambiguous.alias("amb")).groupBy("entity", "tag").agg(F.min("target").alias("target"), F.max("target").alias("last"), F.max("amb").alias("amb"))
    return found.where("amb = 0 AND target = last").select("entity", "target")


def _consistent(merges: DataFrame, profiles: DataFrame) -> DataFrame:
    """One target per entity, none whose middle initials are others."""
    one = merges.where("entity <> target").groupBy("entity").agg(F.min("target").alias("target"))
    a = profiles.where("middles <> ''").select("entity", F.col("middles").alias("ma"))
    b = profiles.where("middles <> ''").select(F.col("entity").alias("target"), F.col("middles").alias("mb"))
    fits = F.col("ma").startswith(F.col("mb")) | F.col("mb").startswith(F.col("ma"))
    return one.join(a, "entity", "left").join(b, "target", "left").where(F.coalesce(fits, F.lit(True))).select("entity", "target")


def _follow(state: DataFrame, merges: DataFrame) -> DataFrame:
    """The state after merges: every entity takes the smallest label beside it and the label of that one.

    Longer chains are followed by the next rounds, in which what is left of them asks again; each call that is given
    a merge leaves fewer entities.
    """
    pairs = merges.select(F.col("entity").alias("a"), F.col("target").alias("b"))
    root = pairs.unionByName(merges.select(F.col("target").alias("a"), F.col("entity").alias("b"))).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    label = root.join(root.select(F.col("a").alias("root"), F.col("root").alias("further")), "root").select(F.col("a").alias("entity"), "further")
    return cut(state.join(label, "entity", "left").withColumn("entity", F.coalesce("further", "entity")).drop("further"))


def resolve(papers: DataFrame, nicknames: dict[str, list[str]] = FAMILIAR) -> DataFrame:
    """name, entity: every non-blank author string that can be read as a name, with the entity it belongs to.

    Null and blank names name nobody.  Case, order, accents, invisible characters and look-alikes never separate
    spellings.  Different middle initials keep people apart.  An initial or short form that fits several people stays
    alone unless co-authors decide.  Copies of rows add no weight beyond the distinct papers.  ``nicknames``: the
    formal names of familiar ones.  The loop ends when neither keys nor co-authors merge anything more; it always
    does, for a merge leaves fewer entities.
    """
    bare = F.when(F.col("kind") == "o", F.concat(F.lit("o "), F.regexp_replace("surname", r"\.", ""))).otherwise(F.concat_ws("|", F.lit("p"), "surname", "given", "middle"))
    named = cut(_oriented(cut(spellings(papers))).withColumn("form", bare))
    facts = cut(_facts(named, nicknames))
    asks, answers = _keys(facts)
    release(papers.sparkSession)
    state = facts.select("form", F.col("form").alias("entity"), "kind", "surname", "given", "middle", "half", "formals", "full", "n")
    by_coauthors = merged = False
    while True:
        profiles = _profiles(state)
        if by_coauthors:
            merges = _by_coauthors(papers, named, state, profiles)
        else:
            member = state.select("form", "entity")
            asked, held = asks.join(member, "form").select("entity", "tag", "key"), answers.join(member, "form").select("entity", "key")
            if merged:
                united = _united(state, profiles)
                asked = asked.unionByName(united.select("entity", F.explode(_asks()).alias("key")).select("entity", F.substring("key", 1, 1).alias("tag"), "key"))
                held = held.unionByName(united.select("entity", F.explode(_answers()).alias("key")))
            merges = _named(asked, held.distinct())
        merges = cut(_consistent(merges, profiles))
        release(papers.sparkSession)
        if not merges.isEmpty():
            state, by_coauthors, merged = _follow(state, merges), False, True  # richer profiles ask again
        elif by_coauthors:
            return named.select("name", "form").join(state.select("form", "entity"), "form").select("name", "entity")
        else:
            by_coauthors = True


def _by_coauthors(papers: DataFrame, named: DataFrame, state: DataFrame, profiles: DataFrame) -> DataFrame:
    """(entity, target): lone initials and short forms that fit several people, by the co-authors shared with one of them."""
    settled = profiles.where("settled").select("entity")
    cut_off = state.where("kind = 'p' AND NOT full AND given <> ''").select("entity", "surname", F.regexp_replace("given", r"\.", "").alias("p")).distinct()
    lone = cut_off.join(settled, "entity", "left_anti")
    full = state.where("full").select(F.col("entity").alias("target"), "surname", F.explode(_prefixes(F.col("given"))).alias("p")).distinct()
    rival = cut(lone.join(full, ["surname", "p"]).select("entity", "target").distinct())
    if rival.isEmpty():
        return rival
    wanted = rival.select("entity").unionByName(rival.select(F.col("target").alias("entity"))).distinct()
    entity_of = named.select("name", "form").join(state.select("form", "entity"), "form").select("name", "entity")
    held = cut(papers.select("id", F.explode(F.array_distinct("authors")).alias("name")).where("name IS NOT NULL").join(entity_of, "name").select("id", "entity").distinct())
    co = cut(held.join(wanted, "entity").join(held.withColumnRenamed("entity", "other"), "id").where("entity <> other").select("entity", "other").distinct())
    fame = co.groupBy("other").agg(F.count("*").alias("f"))
    shared = rival.join(co, "entity").join(co.select(F.col("entity").alias("target"), "other"), ["target", "other"]).join(fame, "other")
    votes = shared.groupBy("entity", "target").agg(F.sum(1.0 / F.col("f")).alias("v"))
    order = Window.partitionBy("entity").orderBy(F.desc("v"), "target")
    ranked = votes.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("v").over(order))
    return ranked.where("k = 1 AND (next IS NULL OR v > 1.5 * next)").select("entity", "target")


def pairs(resolved: DataFrame) -> DataFrame:
    """name_a < name_b of one entity: one row per pair of different spellings, however often each occurs."""
    a = resolved.select("entity", F.col("name").alias("name_a"))
    b = resolved.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
