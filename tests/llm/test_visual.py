import random
import unicodedata

import pytest

from folioplan.llm import visual


def plain(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, value string")
    return [r.plain for r in visual.plain_form(df, "value").orderBy("k").collect()]


CASES = {
    "Ｆｕｌｌ　Ｗｉｄｔｈ： ｘ": "Full Width: x",
    "caf" + "é": "café",
    "́leading": "́leading",
    "ạ̇ ḅ̇": unicodedata.normalize("NFC", "ạ̇ ḅ̇"),
    "zero​width﻿­x": "zerowidthx",
    "no break thin": "no break thin",
    "Pаris": "Paris",  # one Cyrillic letter
    "Москва": "Москва",
    "М" + "o" + "сква": "Москва",  # one Latin letter in a Cyrillic word
    "Москва": "Москва",
    "β-Mixing": "β-Mixing",
    "λCalibrated": "λCalibrated",
    "“quotes” – dashes…": "“quotes” – dashes…",
    "ﬁne": "fine",
    "x² + ½": "x² + ½",
    "한국": "한국",
    "가각": "가각",
    "": "",
    "​": "",
    None: None,
    "plain ascii": "plain ascii",
    "Нο": "Ho",  # Cyrillic and Greek that both imitate Latin
}


def test_plain_form_of_known_cases(spark):
    got = plain(spark, list(CASES))
    assert dict(zip(CASES, got)) == CASES


def test_extra_columns_and_repeated_rows_pass_through(spark):
    df = spark.createDataFrame([(1, "é", "x"), (1, "é", "x"), (2, "a", None)], "h int, s string, seq string")
    rows = sorted(map(tuple, visual.plain_form(df, "s").collect()), key=str)
    assert rows == [(1, "é", "x", "é"), (1, "é", "x", "é"), (2, "a", None, "a")]


def test_empty_table_and_very_long_text(spark):
    assert plain(spark, []) == []
    long = "é" * 20_000 + " ​" + "Ｘ" * 5_000
    assert plain(spark, [long])[0] == "é" * 20_000 + " " + "X" * 5_000


def test_idempotent(spark):
    rng = random.Random(5)
    letters = "abcrXYZ éüåščñ аеорсхМТН ＡｂＣ１２  ​﻿́̌-'1"
    values = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    once = plain(spark, values)
    assert plain(spark, once) == once


def test_canonical_composition_agrees_with_unicode(spark):
    marks = ["́", "̣", "̇", "̈", "̨", "ͅ"]
    values = [b + "".join(marks[(k * j) % 6] for j in range(1, 4)) for k, b in enumerate("aeiouAEIOUwyzсеα")]
    assert plain(spark, values) == [unicodedata.normalize("NFC", v) for v in values]


def test_changed_reports_each_place_once(spark):
    rows = [("p1", "Tіtle", ["A", "B​", None]), ("p1", "Tіtle", ["A", "B​", None]), ("p2", None, None), (None, "x", [])]
    df = spark.createDataFrame(rows, "id string, title string, authors array<string>")
    got = {(r.paper_id, r.field, r.pos) for r in visual.changed(df).collect()}
    assert got == {("p1", "title", 0), ("p1", "authors", 1)}


@pytest.mark.parametrize("bad", ["", None])
def test_no_author_is_no_case(spark, bad):
    df = spark.createDataFrame([("p", bad, [bad])], "id string, title string, authors array<string>")
    assert visual.changed(df).count() == 0


def test_partitioning_and_repeated_strings_change_nothing(spark):
    values = ["caf" + "e\u0301", "\uff38 \u200b", "P\u0430ris", "\u200b"] * 50 + [f"\uff21{k}e\u0301" for k in range(40)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, value string")
    whole = {r.k: r.plain for r in visual.plain_form(df, "value").collect()}
    assert all(whole[k] == {"caf" + "e\u0301": "caf\u00e9", "\uff38 \u200b": "X ", "P\u0430ris": "Paris", "\u200b": ""}.get(v, f"A{k - 200}\u00e9") for k, v in enumerate(values))
    for n in (1, 7, 13):
        assert {r.k: r.plain for r in visual.plain_form(df.repartition(n, "value").repartition(n + 1), "value").collect()} == whole


def _brute(s):
    """The plain form, word by word in Python, composed by the standard library."""
    import regex

    t, out = visual.tables(), []
    latin = {x for _, b in visual.LOOK_ALIKES.values() for x in b}
    shared = {"Latin": latin} | {k: set(a) for k, (a, _) in visual.LOOK_ALIKES.items()}
    for word in regex.findall(r"[\p{L}\p{M}\p{N}\p{Cf}]+|[^\p{L}\p{M}\p{N}\p{Cf}]+", s):
        letters = {k: regex.findall(rf"\p{{Script={k}}}" + ("|[\U0001d400-\U0001d6a5]" if k == "Latin" else ""), word) for k in shared}
        present = [k for k in shared if letters[k]]
        script = None
        if len(present) > 1:
            own = {k: sum(c not in shared[k] for c in letters[k]) for k in shared}
            script = max(shared, key=lambda k: (own[k], len(letters[k]), -list(shared).index(k)))
            if own[script] == 0 and len(set(present) - {"Latin"}) > 1:
                script = "Latin"
        table = {}
        for k, (a, b) in visual.LOOK_ALIKES.items():
            if script == "Latin":
                table |= dict(zip(a, b))
            elif script == k:
                table |= dict(reversed(list(zip(b, a))))
        for k, (a, b) in visual.LOOK_ALIKES.items():
            if script not in (None, "Latin", k):
                back = dict(reversed(list(zip(visual.LOOK_ALIKES[script][1], visual.LOOK_ALIKES[script][0]))))
                table |= {x: back[y] for x, y in zip(a, b) if y in back and x not in table}
        out.append("".join(table.get(c, c) for x in word for c in t["decomposed"].get(x, x)))
    return unicodedata.normalize("NFC", "".join(out))


def test_plain_form_agrees_with_brute_force(spark):
    rng = random.Random(11)
    letters = "abceopxyABHTeé́üåñ аеорсхдМТНЖ αβονρλΑΒΗΟ ստհո ＡｂＣ１２　 ​﻿­-'1ﬁ²한글"
    values = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    got = plain(spark, values)
    wrong = [(v, g, _brute(v)) for v, g in zip(values, got) if g != _brute(v)]
    assert not wrong, wrong[:5]
