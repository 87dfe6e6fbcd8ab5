import random

import pytest

from cardloom.operators import collection as coll
from cardloom.operators import deck_log, decks, edits, running, stats, validate
from pyspark.sql import functions as F

CARDS = [
    ("lead", "Lead", "Legendary Creature", "WU"),
    ("plain", "Plain", "Creature", "W"),
    ("red", "Red", "Instant", "R"),
    ("isle", "Isle", "Basic Land", "U"),
]


def decks_df(spark, rows):
    return spark.createDataFrame(rows, "id string, user_id string, commander_id string")


def test_all_errors_at_once_and_corners(spark, make_cards, rows_of):
    cards = make_cards(CARDS)
    decks_ = decks_df(spark, [("ok", "u", "lead"), ("bad", "u", "plain"), ("none", "u", None), ("empty", "u", "lead"), ("lost", "u", "??")])
    deck_cards = spark.createDataFrame(
        [("ok", "isle", 99), ("bad", "red", 2), ("bad", "isle", 3), ("none", "isle", 100), ("lost", "zzz", 99)],
        "deck_id string, card_id string, quantity int",
    )
    got = {r["deck_id"]: r for r in validate.validate_decks(decks_, deck_cards, cards).collect()}
    assert got["ok"]["is_valid"] and got["ok"]["errors"] == ""
    assert got["bad"]["errors"] == (
        "expected 100 cards, found 6; commander is not a legendary creature; "
        "cards outside the commander's color identity; 1 cards exceed 1 copy"
    )
    assert got["none"]["errors"] == "no commander; color identity cannot be checked"
    assert got["empty"]["deck_size"] == 1 and got["empty"]["errors"] == "expected 100 cards, found 1"
    assert got["lost"]["errors"] == "commander is not in the catalogue; color identity cannot be checked; 1 unknown cards"
    offenders = rows_of(validate.identity_violations(decks_, deck_cards, cards), "deck_id", "card_id")
    assert offenders == [("bad", "isle"), ("bad", "red")]


def test_copies_count_per_oracle_id(spark, make_cards):
    cards = make_cards(CARDS + [("plain2", "Plain", "Creature", "W")])
    cards = cards.withColumn("oracle_id", F.regexp_replace("oracle_id", "2$", ""))
    deck_cards = spark.createDataFrame([("d", "plain", 1), ("d", "plain2", 1)], "deck_id string, card_id string, quantity int")
    row = validate.validate_decks(decks_df(spark, [("d", "u", "lead")]), deck_cards, cards).first()
    assert "1 cards exceed 1 copy" in row["errors"]


def test_collection_rules(spark, make_cards, rows_of):
    cards = make_cards(CARDS)
    owned = spark.createDataFrame([("u", "lead", 0), ("u", "red", 2), ("u", "gone", 4)], "user_id string, card_id string, quantity bigint")
    assert rows_of(coll.library(cards, owned), "id", "quantity") == [("red", 2)]
    adds = spark.createDataFrame(
        [("u", "red", 500), ("u", "plain", -3), ("v", "red", 1), ("v", "gone", 1)], "user_id string, card_id string, quantity bigint"
    )
    merged, rejected = coll.add_copies(owned, adds, cards)
    assert rows_of(merged, "user_id", "card_id", "quantity") == [
        ("u", "gone", 4), ("u", "lead", 0), ("u", "plain", 1), ("u", "red", 101), ("v", "red", 1),
    ]
    assert rows_of(rejected, "user_id", "card_id") == [("v", "gone")]
    names = spark.createDataFrame([("Red", 3), ("Lead", 0), ("Nope", 1)], "name string, quantity int")
    assert rows_of(coll.seed(cards, names, F.lit("me")), "user_id", "card_id", "quantity") == [("me", "red", 3)]


def test_deck_views(spark, make_cards, rows_of):
    cards = make_cards(CARDS)
    decks_ = spark.createDataFrame(
        [("a", "u", "lead", "2024-01-02"), ("b", "u", None, "2024-02-03"), ("c", "v", "??", "2024-01-05")],
        "id string, user_id string, commander_id string, updated_at string",
    ).withColumn("updated_at", F.to_timestamp("updated_at"))
    deck_cards = spark.createDataFrame([("a", "isle", 99), ("c", "red", 200)], "deck_id string, card_id string, quantity bigint")
    assert rows_of(decks.deck_sizes(decks_, deck_cards), "deck_id", "deck_size", "status") == [
        ("a", 100, "complete"), ("b", 0, "under"), ("c", 201, "over"),
    ]
    assert rows_of(decks.decks_per_user(decks_, 2), "user_id", "n_decks", "at_cap") == [("u", 2, True), ("v", 1, False)]
    assert [r["id"] for r in decks.newest_first(decks_).collect()] == ["b", "c", "a"]
    labels = rows_of(decks.with_commanders(decks_, cards), "id", "default_name", "updated_label")
    assert labels == [("a", "Lead deck", "Jan 2, 2024"), ("b", "Untitled deck", "Feb 3, 2024"), ("c", "Untitled deck", "Jan 5, 2024")]
    owned = spark.createDataFrame([("u", "isle", 40)], "user_id string, card_id string, quantity bigint")
    split = rows_of(decks.ownership_split(deck_cards, decks_, owned), "deck_id", "missing_quantity", "owned", "proxy")
    assert split == [("a", 59, True, False), ("c", 200, False, True)]
    asked = spark.createDataFrame([("a", "l"), ("b", "l")], "deck_id string, query string")
    found = rows_of(decks.addable_results(asked, decks_, deck_cards, cards), "deck_id", "card_id", "in_deck", "addable")
    assert ("a", "isle", True, True) in found and ("a", "lead", True, False) in found and ("b", "lead", False, True) in found


def naive_edits(log, basics):
    state = {}
    for deck, _, op, card, quantity in sorted(log, key=lambda r: r[1]):
        leader, cards = state.setdefault(deck, [None, {}])
        if op == "add" and not (cards.get(card, 0) > 0 and card not in basics):
            cards[card] = cards.get(card, 0) + 1
        elif op == "remove":
            if cards.get(card, 0) <= 1:
                cards.pop(card, None)
            else:
                cards[card] -= 1
        elif op == "set_commander":
            cards.pop(card, None)
            if leader and leader != card:
                cards[leader] = cards.get(leader, 1)
            state[deck][0] = card
        elif op == "remove_commander":
            state[deck][0] = None
        elif op in ("clear", "open"):
            state[deck] = [None, {}]
        elif op == "put":
            cards[card] = quantity
        elif op == "seat":
            state[deck][0] = card
    return state


def random_edits(seed, n, decks_n=4):
    rng = random.Random(seed)
    log, seq = [], 0
    while seq < n:
        deck = f"d{rng.choice([0, 0, 0, rng.randrange(decks_n)])}"
        op = rng.choice(["add"] * 6 + ["remove"] * 4 + ["set_commander"] * 3 + ["remove_commander", "clear", "open"][: rng.choice([1, 1, 3])])
        log.append((deck, seq, op, rng.choice(["x", "y", "isle", "lead"]) if op in ("add", "remove", "set_commander") else None, None))
        seq += 1
        if op == "open":
            log += [(deck, seq, "put", "isle", 7), (deck, seq + 1, "put", "x", 1), (deck, seq + 2, "seat", "y", None)]
            seq += 3
    return log


EDIT_SCHEMA = "deck_id string, seq bigint, op string, card_id string, quantity bigint"


@pytest.mark.parametrize("seed,n,chunk", [(1, 30, 5), (2, 200, 7), (3, 400, 1), (4, 400, 1000)])
def test_edit_replay_equals_fold(spark, make_cards, seed, n, chunk):
    cards = make_cards(CARDS)
    log = random_edits(seed, n)
    df = spark.createDataFrame(log, EDIT_SCHEMA)
    want = naive_edits(log, {"isle"})
    got = {d: {} for d in want}
    for r in edits.replay_cards(df, cards, chunk).collect():
        got[r["deck_id"]][r["card_id"]] = r["quantity"]
    assert got == {d: c for d, (_, c) in want.items()}
    leaders = {r["deck_id"]: r["commander_id"] for r in edits.replay_commanders(df).collect()}
    assert leaders == {d: leader for d, (leader, _) in want.items()}


def test_edit_replay_in_two_stretches(spark, make_cards):
    cards = make_cards(CARDS)
    log = random_edits(9, 300)
    half = [spark.createDataFrame(part, EDIT_SCHEMA) for part in (log[:150], log[150:])]
    deck_cards, leaders = edits.replay_cards(half[0], cards), edits.replay_commanders(half[0])
    deck_cards, leaders = edits.advance(deck_cards, leaders, half[1], cards)
    want = naive_edits(log, {"isle"})
    assert {(r["deck_id"], r["card_id"], r["quantity"]) for r in deck_cards.collect()} == {
        (d, c, q) for d, (_, cs) in want.items() for c, q in cs.items()
    }
    assert {r["deck_id"]: r["commander_id"] for r in leaders.collect()} == {d: leader for d, (leader, _) in want.items()}


@pytest.mark.parametrize("seed,cap,chunk", [(1, 3, 4), (2, 5, 1), (3, 2, 1000), (4, 8, 6)])
def test_deck_log_equals_fold(spark, seed, cap, chunk):
    rng = random.Random(seed)
    base = [(f"k{i}", f"u{rng.choice([0, 0, 1, 2])}") for i in range(12)]
    owner = dict(base)
    ops = []
    for seq in range(150):
        op = rng.choice(["save", "save", "delete"])
        deck = rng.choice([None, *owner, "unknown"]) if op == "save" else rng.choice([*owner, "unknown"])
        ops.append((owner.get(deck, f"u{rng.randrange(4)}"), seq, op, deck, f"n{seq}", None, seq))
    state = {k: [u, "old", 0] for k, u in base}
    refused = set()
    for user, seq, op, deck, name, _, ts in ops:
        if op == "delete":
            state.pop(deck, None)
        elif deck in state:
            state[deck][1] = name
        elif sum(1 for v in state.values() if v[0] == user) >= cap:
            refused.add((user, seq))
        else:
            state[f"new {user} {seq}"] = [user, name, ts]
    as_ts = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    base_df = spark.createDataFrame(
        [(k, u, "old", None, 0, 0) for k, u in base],
        "id string, user_id string, name string, commander_id string, created_at bigint, updated_at bigint",
    )
    base_df = as_ts(as_ts(base_df, "created_at"), "updated_at")
    ops_df = as_ts(
        spark.createDataFrame(ops, "user_id string, seq bigint, op string, deck_id string, name string, commander_id string, ts bigint"),
        "ts",
    )
    after, rejected = deck_log.apply_ops(base_df, ops_df, cap, chunk)
    assert {(r["user_id"], r["seq"]) for r in rejected.collect()} == refused
    got = sorted((r["user_id"], r["name"]) for r in after.collect())
    assert got == sorted((u, n) for u, n, _ in state.values())
    kept = {r["id"] for r in after.collect() if not r["id"].startswith("deck-")}
    assert kept == {k for k in state if not k.startswith("new")}


def test_running_helpers_on_one_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else f"k{i % 3}", i, rng.randrange(-5, 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint")
    out = running.with_running(df, ["k"], "seq", {"s": F.col("v")}, {"m": F.col("v")}, chunk_rows=16)
    out = running.with_previous(out, ["k"], "seq", "v", "p", chunk_rows=16)
    sums, highs, before = {}, {}, {}
    got = {r["seq"]: (r["s"], r["m"], r["p"]) for r in out.collect()}
    for k, seq, v in rows:
        sums[k] = sums.get(k, 0) + v
        highs[k] = max(highs.get(k, v), v)
        assert got[seq] == (sums[k], highs[k], before.get(k))
        before[k] = v


def test_inclusion_and_synergy(spark, make_cards, rows_of):
    cards = make_cards(CARDS + [("mono", "Mono", "Legendary Creature", "W")])
    decks_ = decks_df(spark, [("1", "u", "lead"), ("2", "u", "lead"), ("3", "u", "mono"), ("4", "u", None)])
    deck_cards = spark.createDataFrame(
        [("1", "isle", 9), ("2", "plain", 1), ("3", "plain", 1), ("4", "plain", 1)], "deck_id string, card_id string, quantity int"
    )
    assert rows_of(stats.card_inclusion(decks_, deck_cards), "card_id", "n_decks", "share") == [("isle", 1, 0.25), ("plain", 3, 0.75)]
    got = rows_of(
        stats.commander_cooccurrence(decks_, deck_cards, cards).select(
            "commander_id", "card_id", "share", F.round("synergy", 6).alias("synergy")
        )
    )
    assert got == [("lead", "isle", 0.5, 0.0), ("lead", "plain", 0.5, -0.166667), ("mono", "plain", 1.0, 0.333333)]


def test_saves_replace_cards_and_need_a_name(spark, rows_of):
    base = spark.createDataFrame([("1", "u", "a", None, None, None), ("2", "u", "b", None, None, None), ("3", "u", "c", None, None, None)],
        "id string, user_id string, name string, commander_id string, created_at timestamp, updated_at timestamp")
    cards = spark.createDataFrame([("1", "x", 2), ("2", "y", 1), ("3", "z", 4)], "deck_id string, card_id string, quantity int")
    ops = spark.createDataFrame(
        [
            ("u", 1, "save", "1", " Elves ", [("p", 1), ("q", 3)]),
            ("u", 2, "save", "1", "Goblins", [("r", 5)]),
            ("u", 3, "delete", "2", None, None),
            ("u", 4, "save", "3", "  \t ", [("lost", 1)]),
            ("u", 5, "save", "9", "New", [("n", 7)]),
            ("u", 6, "save", "3", "x" * 500, [("lost", 1)]),
        ],
        "user_id string, seq bigint, op string, deck_id string, name string, cards array<struct<card_id:string,quantity:int>>",
    ).withColumns({"commander_id": F.lit(None).cast("string"), "ts": F.lit(None).cast("timestamp")})
    good, refused = deck_log.clean_names(ops)
    assert rows_of(refused, "seq") == [(4,), (6,)]
    assert good.where("seq = 1").first()["name"] == "Elves"
    got = rows_of(deck_log.cards_after(cards, base, good), "card_id", "quantity")
    assert got == [("n", 7), ("r", 5), ("z", 4)]


def test_commands_classified_once_serve_decks_and_cards(spark, rows_of):
    """The tables of one judgement give what each operator finds for itself."""
    base = spark.createDataFrame([("a", 1, "A", 5, None, None), ("b", 1, "B", 6, None, None), ("c", 2, "C", None, None, None)], "id string, user_id bigint, name string, commander_id bigint, created_at timestamp, updated_at timestamp")
    cards = spark.createDataFrame([("a", 5, 1), ("b", 6, 2), ("c", 7, 3)], "deck_id string, card_id bigint, quantity int")
    rows = [(1, 0, "save", "a", "A2", 8), (1, 1, "save", None, "new", 9), (1, 2, "delete", "b", None, None), (1, 3, "save", None, "fits", 9), (2, 4, "delete", "x", None, None), (1, 5, "save", None, "over", 9)]
    ops = spark.createDataFrame(rows, "user_id bigint, seq bigint, op string, deck_id string, name string, commander_id bigint")
    ops = ops.select("*", F.timestamp_seconds("seq").alias("ts"), F.expr("array(struct(commander_id AS card_id, 1 AS quantity))").alias("cards"))
    classed = deck_log.classify_once(base, ops, 3)
    assert all(len(part.inputFiles()) for part in classed)
    after, refused = deck_log.apply_ops(base, ops, 3, classed=classed)
    want, want_refused = deck_log.apply_ops(base, ops, 3)
    assert rows_of(after) == rows_of(want) and rows_of(refused, "seq") == rows_of(want_refused, "seq") == [(5,)]
    assert rows_of(deck_log.cards_after(cards, base, ops, 3, classed=classed)) == rows_of(deck_log.cards_after(cards, base, ops, 3))
