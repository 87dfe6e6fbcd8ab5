"""Places under a collation, imports with counts, damaged drafts, and the store of saved decks."""

import random

from pyspark.sql import functions as F

from cardloom.operators import collection as coll
from cardloom.operators import decks, facets, running
from cardloom.sources import deck_store, drafts
from cardloom.streaming import tables
from tests.test_streaming import finish, streamed


def test_ranked_over_many_parts(spark):
    pick = random.Random(1)
    rows = [(0 if k % 3 else pick.randrange(5), pick.randrange(1000), k) for k in range(1500)] + [(None, k, k) for k in range(5)]
    df = spark.createDataFrame(rows, "user_id long, v long, id long").repartition(6)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.user_id, r.place): (r.v, r.id) for r in running.ranked(df, ["user_id"], [-F.col("v"), F.col("id")], "place").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = {}
    for user in {r[0] for r in rows}:
        own = sorted(((v, i) for u, v, i in rows if u == user), key=lambda x: (-x[0], x[1]))
        expected |= {(user, k + 1): x for k, x in enumerate(own)}
    assert got == expected
    assert running.ranked(df.limit(0), ["user_id"], [F.col("id")], "place").count() == 0


def test_places_follow_the_collation(spark, make_cards):
    names = ["zed", "Éclair", "alpha", "Beta", "beta", "Cathars' Crusade"]
    cards = make_cards([(f"c{k}", n, "Creature", "W", float(k % 2)) for k, n in enumerate(names)])
    owned = cards.withColumn("user_id", F.explode(F.array(F.lit("u"), F.lit("w"))))
    listed = {r.place: r.name for r in facets.browse_ranked(owned).where("user_id = 'w'").collect()}
    assert [listed[k + 1] for k in range(6)] == ["alpha", "beta", "Beta", "Cathars' Crusade", "Éclair", "zed"]
    by_value = {r.place: r.mana_value for r in facets.browse_ranked(owned, sort="manaValue").where("user_id = 'u'").collect()}
    assert [by_value[k + 1] for k in range(6)] == [0.0] * 3 + [1.0] * 3


def test_newest_decks_first(spark):
    rows = [("a", "u", "2024-01-01 00:00:00"), ("b", "u", "2024-02-01 00:00:00"), ("c", "u", None), ("d", "u", "2024-02-01 00:00:00"), ("e", "w", None)]
    df = spark.createDataFrame(rows, "id string, user_id string, t string").withColumn("updated_at", F.to_timestamp("t"))
    assert {r.id: r.place for r in decks.newest_ranked(df).collect()} == {"b": 1, "d": 2, "a": 3, "c": 4, "e": 1}


def test_import_counts_and_adds(spark, make_cards, rows_of):
    cards = make_cards([("a", "Bolt", "Instant", "R"), ("b", "Ring", "Artifact", ""), ("z", "Bolt", "Instant", "R")])
    lines = [("u", " Bolt ", 2, None), ("u", "Bolt", 1, None), ("u", "Nope", 1, None), ("w", "Ring", 0, None), ("w", None, 1, "x"), ("w", "Ring", 4, None)]
    rows = spark.createDataFrame(lines, "user_id string, name string, quantity int, corrupt string")
    held = spark.createDataFrame([("u", "a", 5), ("v", "b", 1)], "user_id string, card_id string, quantity bigint")
    done = coll.import_collection(held, rows, cards)
    assert (done.imported, done.rejected) == (3, 3)
    assert rows_of(done.per_user, "user_id", "imported", "rejected") == [("u", 2, 1), ("w", 1, 2)]
    assert rows_of(done.collection) == [("u", "a", 8), ("v", "b", 1), ("w", "b", 4)]
    assert rows_of(done.refused, "reason") == [("malformed",), ("quantity",), ("unknown card",)]
    nothing = coll.import_collection(held, rows.limit(0), cards)
    assert (nothing.imported, nothing.rejected) == (0, 0) and nothing.collection.count() == 2


def test_one_bad_field_keeps_the_others(spark):
    texts = [
        '{"deckId":"d","name":7,"commanderId":"c","cards":{"a":1.0,"b":"2","c":"many","d":null,"e":[1],"f":3}}',
        '{"deckId":["x"],"cards":5,"commanderId":"c"}', '{"cards":', "[1]", None, "{}", '"x"', '{"deckId":null,"cards":{}}',
    ]
    rows = drafts.load_drafts(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, draft string"))
    got = {r.k: (r.deck_id, r.name, r.commander_id, r.cards, r.is_empty) for r in rows.collect()}
    assert got[0] == ("d", "7", "c", {"a": 1, "b": 2, "f": 3}, False)
    assert got[1][2:] == ("c", {}, False)
    assert all(got[k] == (None, None, None, {}, True) for k in (2, 3, 4, 5, 6, 7))


def test_deck_store_reads_older_and_broken_files(spark, rows_of, tmp_path):
    base = str(tmp_path / "decks")
    assert deck_store.load_decks(spark, base).count() == 0
    facts = spark.createDataFrame([("a", "u", "A", None), ("b", "u", "B", "x")], "id string, user_id string, name string, commander_id string")
    cards = spark.createDataFrame([("a", "c1", 2), ("a", "c0", 1)], "deck_id string, card_id string, quantity int")
    deck_store.save_decks(deck_store.with_cards(facts, cards), base)
    assert rows_of(deck_store.deck_rows(deck_store.load_decks(spark, base))) == [("a", "c0", 1), ("a", "c1", 2)]
    # A file from before decks had cards, and one with a column of later times.
    facts.limit(1).withColumn("id", F.lit("old")).write.mode("append").parquet(base)
    deck_store.with_cards(facts.limit(1), cards).withColumn("id", F.lit("new")).withColumn("tags", F.array(F.lit("t"))).write.mode("append").parquet(base)
    held = {r.id: r for r in deck_store.load_decks(spark, base).collect()}
    assert set(held) == {"a", "b", "old", "new"} and held["old"].cards == [] and held["b"].cards == [] and len(held["new"].cards) == 2
    # Decks read from the store can replace it.
    deck_store.save_decks(deck_store.load_decks(spark, base).where("id <> 'old'"), base)
    assert rows_of(deck_store.load_decks(spark, base), "id") == [("a",), ("b",), ("new",)]
    for file in (tmp_path / "decks").glob("*.parquet"):
        file.write_bytes(file.read_bytes()[:-40])
        (tmp_path / "decks" / f".{file.name}.crc").unlink(missing_ok=True)
    assert deck_store.load_decks(spark, base).count() == 0


def test_decks_from_a_stream_keep_cards_and_check_names(spark, rows_of, tmp_path):
    ops = "user_id bigint, seq bigint, op string, deck_id string, name string, commander_id bigint, ts timestamp, cards array<struct<card_id:bigint,quantity:int>>"
    rows = [
        (1, 0, "save", None, " First ", 5, [(5, 1), (6, 2)]), (1, 1, "save", None, "  ", 5, [(5, 1)]),
        (1, 2, "save", None, "x" * 81, 5, None), (1, 3, "save", None, "Bare", None, None),
    ]
    raw = spark.createDataFrame(rows, ops.replace("ts timestamp, ", "")).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    raw = raw.select(*[c.split()[0] for c in ops.split(", ")])
    base = str(tmp_path / "t")
    finish(tables.keep_decks(streamed(spark, raw, tmp_path / "in", 2), base, str(tmp_path / "ck")))
    held = {r.name: r for r in tables.read_decks(spark, base).collect()}
    assert set(held) == {"First", "Bare"} and [tuple(c) for c in held["First"].cards] == [(5, 1), (6, 2)] and held["Bare"].cards is None
    assert rows_of(tables.read_refused(spark, base), "seq") == [(1,), (2,)]
    # Saved again with other cards, by the id it got.
    again = [(1, 10, "save", held["First"].id, "Second", 7, [(9, 4)])]
    more = spark.createDataFrame(again, ops.replace("ts timestamp, ", "")).withColumn("ts", F.to_timestamp(F.lit("2024-01-02 00:00:00"))).select(*raw.columns)
    more.write.parquet(str(tmp_path / "in2"))
    finish(tables.keep_decks(spark.readStream.schema(more.schema).parquet(str(tmp_path / "in2")), base, str(tmp_path / "ck2")))
    held = {r.name: r for r in tables.read_decks(spark, base).collect()}
    assert set(held) == {"Second", "Bare"} and [tuple(c) for c in held["Second"].cards] == [(9, 4)]


def test_ranked_rows_are_exchanged_twice_only(spark):
    """By range and by key of a part; what keys have in earlier parts is sent to them."""
    rows = spark.range(4000).selectExpr("CASE WHEN id % 4 > 0 THEN 1 WHEN id % 3 > 0 THEN id % 17 END AS user_id", "id * 7919 % 4001 AS n", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = running.ranked(rows, ["user_id"], [F.col("n")], "place")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        got = {r.id: r.place for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lists = {}
    for r in rows.collect():
        lists.setdefault(r.user_id, []).append((r.n, r.id))
    assert got == {id: i for own in lists.values() for i, (_, id) in enumerate(sorted(own), 1)}
    assert "rightHint=(strategy=broadcast)" in plan
