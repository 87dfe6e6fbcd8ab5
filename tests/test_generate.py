"""Generated decks against a plain one-request-at-a-time walk over small pools."""

import random

import pytest

from cardloom.functions.constants import ONLY_OWNED, PREFER_OWNED, STRONGEST
from cardloom.operators.roles import assign_roles
from cardloom.operators.validate import validate_decks
from cardloom.plans import generate as gen
from pyspark.sql import functions as F

BASIC = [("Plains", "W"), ("Island", "U"), ("Swamp", "B"), ("Mountain", "R"), ("Forest", "G")]


def expected_deck(cards, names, preference, owned):
    """cards: list of (id, name, type, letters) in pool order."""
    may = lambda c: preference != ONLY_OWNED or c[0] in owned
    own_first = lambda c: 0 if preference == PREFER_OWNED and c[0] in owned else 1
    context = [c for c in cards if c[1] in names]
    identity = {x for c in context for x in c[3]} or {"G", "W"}
    legends = [c for c in cards if "Legendary" in c[2] and "Creature" in c[2] and may(c)]
    if not legends:
        return None
    covering = [c for c in legends if identity <= set(c[3])] or legends
    leader = sorted(covering, key=lambda c: (-len(identity & set(c[3])), -len(c[3]), own_first(c)))[0]
    fits = lambda c: set(c[3]) <= set(leader[3]) and may(c)
    spells = [c for c in cards if "Land" not in c[2] and c[0] != leader[0] and fits(c)]
    spells = sorted(spells, key=lambda c: (c[1] not in names, own_first(c)))[:63]
    needed = 99 - len(spells)
    lands = [c for c in cards if "Land" in c[2] and "Basic" not in c[2] and fits(c)]
    lands = sorted(lands, key=own_first)[: max(0, needed - len(leader[3]))]
    left = needed - len(lands)
    colors = list(leader[3]) or ["G", "W"]
    basics = []
    for i, color in enumerate(colors):
        count = left // len(colors) + (1 if i < left % len(colors) else 0)
        card = next((c for c in cards if c[1] == dict((b, a) for a, b in BASIC)[color]), None)
        if card and count:
            basics.append((card[0], count))
    rows = [("spell", i + 1, c[0], 1) for i, c in enumerate(spells)]
    rows += [("land", i + 1, c[0], 1) for i, c in enumerate(lands)]
    return leader[0], needed, sorted(rows), sorted(basics)


def random_pool(rng, size, legends=True):
    types = ["Creature", "Instant", "Artifact", "Land", "Land Creature", "Sorcery"] + (
        ["Legendary Creature", "Legendary Artifact"] if legends else []
    )
    cards = []
    for i in range(size):
        letters = "".join(rng.sample("WUBRG", rng.choice([0, 0, 1, 1, 1, 2, 3, 5])))
        cards.append((f"c{i:03d}", f"card {i}", rng.choice(types), letters))
    cards += [(f"b{n}", n, "Basic Land", "") for n, _ in BASIC if rng.random() < 0.8]
    rng.shuffle(cards)
    return cards


@pytest.mark.parametrize("seed,size", [(1, 12), (2, 60), (3, 260), (4, 500)])
def test_decks_equal_plain_walk(spark, make_cards, seed, size):
    rng = random.Random(seed)
    pool = random_pool(rng, size)
    cards = assign_roles(make_cards(pool))
    requests, owned = [], {}
    for i in range(40):
        user = f"u{i % 9}"
        if user not in owned:
            owned[user] = {c[0] for c in pool if rng.random() < rng.choice([0.02, 0.3, 0.9])}
        names = [c[1] for c in rng.sample(pool, rng.choice([0, 1, 3, 10, min(size, 90)]))] + ["not a card"]
        requests.append((f"r{i}", user, names, None, [STRONGEST, PREFER_OWNED, ONLY_OWNED][i % 3]))
    request_df = spark.createDataFrame(
        requests,
        "request_id string, user_id string, build_around_card_names array<string>, power_level string, "
        "collection_preference string",
    )
    holdings = [(u, c, 1) for u, ids in owned.items() for c in ids] + [("u0", pool[0][0] + "?", 3)]
    collection = spark.createDataFrame(holdings, "user_id string, card_id string, quantity int")
    made = gen.generate(cards, request_df, collection)
    summary = {r["request_id"]: r for r in made.collect()}
    listed = {}
    for r in gen.deck_list(made, gen.named_basics(cards)).collect():
        listed.setdefault(r["request_id"], []).append((r["section"], r["rank"], r["card_id"], r["quantity"]))
    for rid, user, names, _, preference in requests:
        want = expected_deck(pool, set(names), preference, owned[user])
        got = summary[rid]
        if want is None:
            assert got["commander_id"] is None and got["error"] == gen.NO_LEADER and rid not in listed
            continue
        leader, needed, rows, basics = want
        assert (got["commander_id"], got["lands_needed"], got["error"]) == (leader, needed, None), rid
        deck = listed.get(rid, [])
        assert sorted(r for r in deck if r[0] != "basic") == rows, rid
        assert sorted((c, q) for s, _, c, q in deck if s == "basic") == basics, rid


def test_without_collection_everything_comes_from_the_catalogue(spark, make_cards):
    pool = [("l", "Leader", "Legendary Creature", "WG"), ("s", "Spell", "Instant", "R")] + [
        (f"b{n}", n, "Basic Land", "") for n, _ in BASIC
    ]
    requests = spark.createDataFrame(
        [("r", "u", ["Spell"], None, ONLY_OWNED)],
        "request_id string, user_id string, build_around_card_names array<string>, power_level string, "
        "collection_preference string",
    )
    cards = assign_roles(make_cards(pool))
    made = gen.generate(cards, requests)
    row = made.first()
    # no legend covers R: the widest identity leads, and the red card cannot be played
    assert row["commander_id"] == "l" and row["spells"] == [] and row["lands_needed"] == 99
    assert row["explanation"].startswith("Built around Spell. Leader leads the deck: its color identity (WG)")
    basics = [(r["card_id"], r["quantity"]) for r in gen.deck_list(made, gen.named_basics(cards)).orderBy("rank").collect()]
    assert basics == [("bPlains", 50), ("bForest", 49)]


def test_generated_decks_obey_the_rules(spark, make_cards):
    rng = random.Random(7)
    pool = [("lead", "Lead", "Legendary Creature", "WUB")]
    pool += [(f"c{i}", f"card {i}", "Instant", rng.choice(["W", "U", "B", "R", ""])) for i in range(200)]
    pool += [(f"b{n}", n, "Basic Land", c) for n, c in BASIC]
    cards = assign_roles(make_cards(pool))
    requests = spark.createDataFrame(
        [(f"r{i}", "u", [f"card {i}", f"card {i + 1}"], None, None) for i in range(20)],
        "request_id string, user_id string, build_around_card_names array<string>, power_level string, "
        "collection_preference string",
    )
    made = gen.generate(cards, requests)
    decks = made.select(F.col("request_id").alias("id"), "commander_id")
    deck_cards = gen.deck_list(made, gen.named_basics(cards)).withColumnRenamed("request_id", "deck_id")
    assert validate_decks(decks, deck_cards, cards).where("NOT is_valid").count() == 0
