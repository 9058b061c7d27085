import pytest

from folioplan.llm import encoding

CLEAN = [
    "Der Prüfung größerer Überschüsse für ältere Höhenprofile folgt die Auflösung von Verweisen.",
    "Les résultats présentés à la fin confirment l’intérêt de la méthode générale près de l’océan.",
    "Результаты показывают, что старые каталоги часто повторяются без ручной проверки.",
    "Metoda przyspiesza wykrywanie błędów bez żadnych poprawek, źródłowe przypisy są niepełne.",
    "A coleção contém 57 referências. SÃO apresentadas as limitações; a IRMÃ ÂNGELA também.",
    "Volumes are given in m³ and slopes as ½ or ¼ of the nominal value, at 37 °C ± 0.2.",
    "El método mejoró la clasificación automática según la evaluación de los años recientes.",
]


def garble(text, chain):
    for meant, read_as in chain:
        text = text.encode(meant).decode(read_as)
    return text


CHAINS = [
    (("utf-8", "latin-1"),),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "mac_roman"),),
    (("utf-8", "cp437"),),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows, k = [], 0
    for n in range(40):
        for t in CLEAN:
            rows.append((k, t))
            k += 1
    bad = {}
    for chain in CHAINS:
        for t in (CLEAN[0], CLEAN[1], CLEAN[2], CLEAN[6]):
            bad[k] = t
            rows.append((k, garble(t, chain)))
            k += 1
    swaps = [(CLEAN[2], ("cp1251", "cp1252")), (CLEAN[3], ("cp1250", "cp1252")), (CLEAN[2], ("koi8_r", "cp1251"))]
    for t, (a, b) in swaps:
        bad[k] = t
        rows.append((k, t.encode(a, "ignore").decode(b, "ignore")))
        k += 1
    rows += [(k, "lost � here"), (k + 1, None), (k + 2, ""), (k + 3, "plain ascii only")]
    found = {r.doc_id: r for r in encoding.garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    return found, bad, k


def test_every_garbled_record_and_no_clean_one(corpus):
    found, bad, lost = corpus
    assert set(found) == set(bad) | {lost}


def test_originals_come_back(corpus):
    found, bad, _ = corpus
    same = [k for k, t in bad.items() if found[k].restored == t]
    assert len(same) >= 0.9 * len(bad)


def test_lost_text_is_reported_as_lost(corpus):
    found, _, lost = corpus
    assert found[lost].lost and not found[lost].chains


def test_steps_undo_their_garbling():
    for t in CLEAN:
        for read_as in ("latin-1", "mac_roman", "cp437"):
            page = {"latin-1": "cp1252"}.get(read_as, read_as)
            assert encoding._step(garble(t, (("utf-8", read_as),)), page, "utf-8") == t


def test_empty_table_extra_columns_and_long_tokens(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert encoding.garbled(none).count() == 0
    odd = spark.createDataFrame([(1, "é" * 5_000, "x"), (1, "é" * 5_000, "x")], "doc_id bigint, text string, gain string")
    assert encoding.garbled(odd).count() == 0


def test_length_of_a_token_changes_nothing(spark):
    rows = [(k, t) for k, t in enumerate(CLEAN * 40)]
    word = CLEAN[2].replace(" ", "")
    for k, n in ((9000, 1), (9001, 40)):
        rows.append((k, garble(word * n, CHAINS[0])))
    rows += [(9002, "汉字文本没有空格" * 300 + garble("Überschüsse", CHAINS[0]) + "汉字" * 10), (9003, "汉字文本没有空格" * 300)]
    found = {r.doc_id: r for r in encoding.garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[9000].restored == word and found[9001].restored == word * 40
    assert "Überschüsse汉" in found[9002].restored and 9003 not in found


def test_margins_follow_from_the_rate_of_false_acceptances(spark):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(CLEAN * 40)], "doc_id bigint, text string")
    weights, swap, utf8 = encoding.fit(texts)
    assert len(weights) == 4 * encoding.CELLS and swap > 10 and 0 <= utf8 < 12
    # The more tokens held out decode as UTF-8 without being likelier for it, the less evidence decoding is.
    assert encoding.fit(texts, false_rate=1e-2)[2] < utf8
