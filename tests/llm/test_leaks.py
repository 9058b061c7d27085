import random

from folioplan.llm import leaks

ITEM = "Why would a sparse lighthouse need topic clustering once the rampart postpones legal deposit catalogues because orchard counts reach a desert observatory through a chimney"
WORDS = ITEM.split()


def scan(spark, docs, items=((1, ITEM),), **options):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id bigint, text string")
    i = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in leaks.leaked(d, i, **options).collect()}


def test_whole_part_and_shorter_quotes(spark):
    docs = [f"Before. {ITEM} After.", " ".join(WORDS[:12]) + " and nothing else", " ".join(WORDS[:6]), None, "", "unrelated words only"]
    got = scan(spark, docs)
    assert set(got) == {(0, 1), (1, 1)}
    assert got[0, 1].share == 1.0


def test_changed_words_case_markup_and_line_breaks(spark):
    changed = list(WORDS)
    changed[4], changed[11] = "other", "given"
    docs = [" ".join(changed), ITEM.upper().replace(" ", "\n"), ITEM.replace("sparse", "<b>sparse</b>").replace("topic", "> topic"), ITEM.replace("lighthouse", "light-\nhouse")]
    assert set(scan(spark, docs)) == {(k, 1) for k in range(4)}


def test_two_passages_in_order(spark):
    n = len(WORDS)
    a, b = " ".join(WORDS[:7]), " ".join(WORDS[n - 7 :])
    filler = " quite different words stand here for a while and then some more of them "
    assert set(scan(spark, [a + filler + b])) == {(0, 1)}


def test_offsets_point_into_the_original(spark):
    doc = "Intro &amp; more.\n​" + ITEM + " End"
    p = scan(spark, [doc])[0, 1].passages[0]
    assert doc[p.start : p.stop].startswith("Why") and doc[p.start : p.stop].endswith("chimney")


def test_blocks_of_items_change_nothing(spark):
    items = [(k, f"item {k} " + " ".join(random.Random(k).sample(WORDS, 15))) for k in range(9)]
    docs = [t for _, t in items]
    assert set(scan(spark, docs, items)) == set(scan(spark, docs, items, block=2)) >= {(k, k) for k in range(9)}


def test_brute_force_agreement(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(30))) for k in range(6)]
    docs = []
    for _ in range(40):
        words = [rng.choice(vocab) for _ in range(60)]
        for _, t in rng.sample(items, rng.randint(0, 2)):
            n = rng.choice((5, 12, 30))
            at = rng.randint(0, 30 - n)
            words[20:20] = t.split()[at : at + n]
        docs.append(" ".join(words))
    want = set()
    for d, text in enumerate(docs):
        w = text.split()
        for i, t in items:
            x = t.split()
            longest = max((n for n in range(31) for a in range(31 - n) if n and " ".join(x[a : a + n]) in text), default=0)
            if longest >= 10 and len(w):
                want.add((d, i))
    assert set(scan(spark, docs, items)) == want


def test_empty_tables_extra_columns_and_repeats(spark):
    assert scan(spark, [], items=((1, ITEM),)) == {}
    d = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x")], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(5, ITEM, 1.0), (5, ITEM, 1.0), (6, None, 0.0), (None, ITEM, 0.0)], "item_id bigint, text string, share double")
    assert [(r.doc_id, r.item_id) for r in leaks.leaked(d, i).collect()] == [(1, 5), (1, 5)]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.leaked(d, none).count() == 0


def test_very_long_text(spark):
    long = "filler word " * 200_000 + ITEM
    assert set(scan(spark, [long])) == {(0, 1)}
