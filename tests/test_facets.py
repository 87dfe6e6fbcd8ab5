from cardloom.functions import columns as C
from cardloom.operators import facets, roles
from pyspark.sql import functions as F

CARDS = [
    ("a", "Zed 100%", "Creature", "W", 2),
    ("b", "alpha_one", "Instant", "", 1),
    ("c", "Éclair", "Legendary Creature", "WU", 1),
    ("d", "beta", "Land", "G", 0),
    ("e", "Alphabet", "Basic Land", "", 0),
    ("f", "odd", "creature token", "X", 3),
    ("g", "nothing known", "Artifact", None, 3),
]


def names(df):
    return [r["name"] for r in df.collect()]


def test_blank_filter_keeps_all_blank_search_finds_none(make_cards):
    cards = make_cards(CARDS)
    assert facets.filter_cards(cards, "  ", [], "").count() == len(CARDS)
    assert facets.search_cards(cards, "   ").count() == 0


def test_wildcards_are_literal(make_cards):
    cards = make_cards(CARDS)
    assert names(facets.filter_cards(cards, "%")) == ["Zed 100%"]
    assert names(facets.filter_cards(cards, "_")) == ["alpha_one"]
    assert names(facets.search_cards(cards, "100%")) == ["Zed 100%"]


def test_type_filter_minds_case_search_does_not(make_cards):
    cards = make_cards(CARDS)
    assert sorted(names(facets.filter_cards(cards, type_="Creature"))) == ["Zed 100%", "Éclair"]
    assert names(facets.search_cards(cards, "CREATURE")) == ["Zed 100%", "Éclair", "odd"]


def test_color_facet_overlaps_and_colorless(make_cards):
    cards = make_cards(CARDS)
    assert sorted(names(facets.filter_cards(cards, colors=["U", "G"]))) == ["beta", "Éclair"]
    assert sorted(names(facets.filter_cards(cards, colors=["C"]))) == ["Alphabet", "alpha_one", "nothing known"]
    assert sorted(names(facets.filter_cards(cards, colors=["W", "C"]))) == [
        "Alphabet", "Zed 100%", "alpha_one", "nothing known", "Éclair",
    ]


def test_sorts(make_cards):
    cards = make_cards(CARDS)
    assert names(facets.browse(cards)) == ["alpha_one", "Alphabet", "beta", "Éclair", "nothing known", "odd", "Zed 100%"]
    by_value = names(facets.browse(cards, sort="manaValue"))
    assert by_value[:4] == ["Alphabet", "beta", "alpha_one", "Éclair"]
    # unknown color before W, multicolor, colorless, lands last
    assert names(facets.browse(cards, sort="color")) == [
        "odd", "Zed 100%", "Éclair", "alpha_one", "nothing known", "Alphabet", "beta",
    ]


def test_facet_counts(make_cards, rows_of):
    counts = rows_of(facets.facet_counts(make_cards(CARDS)), "facet", "n_cards")
    assert counts == [("C", 3), ("G", 1), ("U", 1), ("W", 2)]


def test_batch_search_equals_single_search(spark, make_cards):
    cards = make_cards(CARDS + [(f"x{i}", f"repeat {i}", "Artifact", "") for i in range(30)])
    texts = ["re", "alpha", " Creature ", "", "%", "é", "repeat 1", "zzz", "land", "a", "repeat"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    want = [[r["id"] for r in facets.search_cards(cards, text).collect()] for text in texts]
    for room in (0, facets.BROADCAST_CHARS):
        got = {}
        for r in facets.search_batch(cards, queries, broadcast_chars=room).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["card_id"])
        assert [got.get(i, []) for i in range(len(texts))] == want
    assert facets.search_batch(cards, queries.where("query = ''")).count() == 0


def test_roles_table_fallbacks_and_order(make_cards, rows_of):
    cards = make_cards(
        [
            ("1", "Sol Ring", "Artifact", ""),
            ("2", "Doubling Season", "Enchantment", "G"),
            ("3", "Somewhere", "Land", ""),
            ("4", "Nobody", "Creature", "W"),
            ("5", "Fable of the Mirror-Breaker // Reflection", "Enchantment", "R"),
        ]
    )
    assert rows_of(roles.assign_roles(cards), "id", "primary_role") == [
        ("1", "Ramp"), ("2", "Counters"), ("3", "Land"), ("4", "Utility"), ("5", "Utility"),
    ]
    assert ("5", "Tokens") in rows_of(roles.assign_roles(cards, front_face=True), "id", "primary_role")


def test_role_order(spark):
    listed = ["Land", "Zany", "Ramp", "Utility", "Counters", "Brew"]
    df = spark.createDataFrame([(r,) for r in listed], "role string")
    ordered = [r["role"] for r in df.orderBy(C.role_order_key("role"), "role").collect()]
    assert ordered == ["Counters", "Ramp", "Utility", "Brew", "Zany", "Land"]


def test_column_functions(spark):
    df = spark.createDataFrame(
        [("\t {2}{W/U} ", "{W/U/P}{2}{G}"), (None, None), ("", "plain")], "text string, cost string"
    )
    got = df.select(
        C.trim_all("text").alias("t"),
        F.transform(C.mana_symbols("cost"), C.symbol_label).alias("s"),
        C.saved_deck_name("text").alias("n"),
    ).collect()
    assert [r["t"] for r in got] == ["{2}{W/U}", None, ""]
    assert [r["s"] for r in got] == [["WU/P", "2", "G"], [], []]
    assert [r["n"] for r in got] == ["{2}{W/U}", None, None]
    one = spark.range(1).select(
        C.saved_deck_name(F.lit("x" * 100)).alias("long"),
        C.default_deck_name(F.lit(None).cast("string")).alias("untitled"),
        C.display_date(F.lit("2024-03-05 10:00:00").cast("timestamp")).alias("date"),
        C.clamp_copies(F.lit(0)).alias("low"),
        C.clamp_copies(F.lit(500)).alias("high"),
    ).first()
    assert (one["long"], one["untitled"], one["date"], one["low"], one["high"]) == (None, "Untitled deck", "Mar 5, 2024", 1, 99)
