from folioplan.llm import names as N

GROUPS = [
    ["Theodore Stobotri", "Theo Stobotri", "Stobotri, Theodore", "STOBOTRI, Theodore", "T. Stobotri", "Stobotri T", "Theodroe Stobotri", "Theodore Stobotir"],
    ["Anthony Stobotri", "Tony Stobotri", "Ant. Stobotri"],
    ["Eamon L. Kibredi", "Eamon Kibredi", "E. L. Kibredi", "Kibredi EL", "Кibredi, Eamon", "Kibrеdi,​Eamon L."],
    ["Jin-Ho K. Jideza", "Jin Ho Jideza", "J.-H. K. Jideza", "Jin Jideza", "Jideza Jin-Ho"],
    ["Zuri Gútrigo", "Zuri Gutrigo", "Gútrigo Zuri"],
    ["Senlese Genomics Collaboration", "The Senlese Genomics Collaboration", "SENLESE GENOMICS COLLABORATION", "Senlese Genomics Coll.", "Collaboration, Senlese Genomics", "Selese Genomics Collaboration"],
    ["Senlese Imaging Collaboration"],
    ["Sakura Vadupu"], ["Seraphina Vadupu"],
    ["John A. Venuka"], ["John B. Venuka"],
]


def papers(spark, extra=()):
    rows, k = [], 0
    for g in GROUPS:
        for j, n in enumerate(g):
            for _ in range(3 if j == 0 else 1):
                rows.append((f"p{k}", [n]))
                k += 1
    for s in ("Fatoro", "Lestamu", "Negadi"):  # given names that several people bear
        for g in ("Theodore", "Anthony", "Eamon", "Jin-Ho", "Zuri", "Sakura", "Seraphina", "John"):
            rows.append((f"p{k}", [f"{g} {s}"]))
            k += 1
    for g in ("Orla", "Elif", "Noor"):
        for s in ("Stobotri", "Kibredi", "Jideza"):
            rows.append((f"p{k}", [f"{g} {s}"]))
            k += 1
    return spark.createDataFrame(rows + list(extra), "id string, authors array<string>")


def test_variants_are_linked_and_people_kept_apart(spark):
    got = {(r.name_a, r.name_b) for r in N.pairs(N.resolve(papers(spark))).collect()}
    want = {(a, b) for g in GROUPS for a in g for b in g if a < b}
    assert got == want


def test_shared_initials_stay_alone_unless_coauthors_decide(spark):
    lone = {(r.name_a, r.name_b) for r in N.pairs(N.resolve(papers(spark, [("x1", ["S. Vadupu"])]))).collect()}
    assert not any("S. Vadupu" in p for p in lone)
    extra = [("x1", ["S. Vadupu", "Wanda Rare"]), ("x2", ["Seraphina Vadupu", "Wanda Rare"])]
    got = {(r.name_a, r.name_b) for r in N.pairs(N.resolve(papers(spark, extra))).collect()}
    assert ("S. Vadupu", "Seraphina Vadupu") in got and ("S. Vadupu", "Sakura Vadupu") not in got


def test_parse():
    assert N.parse("Kibredi, Eamon L.")[:4] == ("p", "kibredi", "eamon", "l")
    assert N.parse("Natigegi YA")[:4] == ("p", "natigegi", "y", "a")
    assert N.parse("Joh. Kúlveli")[:3] == ("p", "kulveli", "joh.")
    assert N.parse("The Kafusa Climate Laboratory")[0] == "o"
    for none in ("", "  ", "et al.", "n/a", "...", "42"):
        assert N.parse(none)[0] == ""


def test_nulls_blanks_repeats_and_empty_tables(spark):
    extra = [("a", None), ("b", [None, "", " "]), ("p0", ["Theodore Stobotri"]), (None, ["Solo Person"])]
    got = {(r.name_a, r.name_b) for r in N.pairs(N.resolve(papers(spark, extra))).collect()}
    assert got == {(a, b) for g in GROUPS for a in g for b in g if a < b}
    none = spark.createDataFrame([], "id string, authors array<string>, name string, entity string")
    assert N.pairs(N.resolve(none)).count() == 0


def test_one_mistyping_of_a_common_name_may_go_with_many_surnames(spark):
    surnames = [f"{a}{b}{c}" for a in ("Bra", "Klo", "Mi", "Stu", "Vo") for b in ("denz", "fath", "gurm", "lopt", "wisk") for c in ("ari", "ombe", "une")]
    rows = [(f"p{k}", [f"Theodore {s}"]) for k, s in enumerate(surnames)] + [(f"q{k}", [f"Theodroe {s}"]) for k, s in enumerate(surnames[::25])]
    got = {(r.name_a, r.name_b) for r in N.pairs(N.resolve(spark.createDataFrame(rows, "id string, authors array<string>"))).collect()}
    assert got == {(f"Theodore {s}", f"Theodroe {s}") for s in surnames[::25]}


def test_united_profiles_ask_again(spark):
    # "J. Q. Vastem" is "John Vastem" once he is "John Quentin Vastem", which only the typed-wrong spelling says.
    rows = [("a", ["Jonathan Vastem"]), ("b", ["J. Q. Vastem"]), ("c", ["Jonathan Q. Vastme"])] + [(f"v{k}", [f"{g} Vastem"]) for k, g in enumerate(("Orla", "Elif", "Noor", "Zuri"))]
    got = {(r.name_a, r.name_b) for r in N.pairs(N.resolve(spark.createDataFrame(rows, "id string, authors array<string>"))).collect()}
    names = ["J. Q. Vastem", "Jonathan Q. Vastme", "Jonathan Vastem"]
    assert got == {(a, b) for a in names for b in names if a < b}


def test_chains_longer_than_a_round_are_followed(spark):
    state = spark.createDataFrame([(f"f{k:02}", f"f{k:02}") for k in range(40)], "form string, entity string")
    while True:
        label = {r.form: r.entity for r in state.collect()}
        merges = {(label[f"f{k:02}"], label[f"f{k - 1:02}"]) for k in range(1, 40)}
        merges = dict(sorted((a, b) for a, b in merges if a != b))
        if not merges:
            break
        state = N._follow(state, spark.createDataFrame(list(merges.items()), "entity string, target string"))
    assert set(label.values()) == {"f00"}
