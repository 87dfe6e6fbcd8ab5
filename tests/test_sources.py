import json

from cardloom.operators import collection as coll
from cardloom.operators import decks
from cardloom.sources import cards_json, collection_csv, drafts, export, stores
from pyspark.sql import functions as F


def raw(cid, name, **more):
    return {"id": cid, "name": name, "cmc": 2.0, "color_identity": ["G"], "type_line": "Creature", **more}


def test_card_files_as_lines_and_as_array(spark, tmp_path):
    good = [raw("1", "A"), raw("2", "B", image_uris={"normal": "u"}, colors=["G"]), raw("1", "A again")]
    lines = "\n".join(json.dumps(c) for c in good + [raw("3", "Odd", color_identity=["X"]), {"id": "4"}]) + "\n{broken"
    (tmp_path / "lines.json").write_text(lines)
    (tmp_path / "array.json").write_text("[\n" + ",\n".join(json.dumps(c) for c in good) + "\n]\n")
    cards, bad = cards_json.read_cards(spark, str(tmp_path / "lines.json"))
    rows = {r["id"]: r for r in cards.collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["name"] == "A" and rows["1"]["colors"] == []
    assert rows["2"]["image_url"] == "u" and rows["2"]["ci_mask"] == 16 and rows["1"]["ordinal"] < rows["2"]["ordinal"]
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed", "no id or name", "unknown color"]
    cards, bad = cards_json.read_cards(spark, str(tmp_path / "array.json"))
    assert cards.count() == 2 and bad.count() == 0


def test_collection_file(spark, make_cards, rows_of, tmp_path):
    (tmp_path / "c.csv").write_text('name,quantity\nRed,2\n"Lead, the One", 3\nRed,1\nNope,1\nRed,many\nRed,0\n')
    cards = make_cards([("r", "Red", "Instant", "R"), ("l", "Lead, the One", "Legendary Creature", "W")])
    lines = collection_csv.read_collection_csv(spark, str(tmp_path / "c.csv"), F.lit("u"))
    good, bad = coll.resolve_import(lines, cards)
    assert rows_of(good, "card_id", "quantity") == [("l", 3), ("r", 3)]
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed", "quantity", "unknown card"]


def test_draft_texts(spark, rows_of):
    texts = [
        (1, '{"deckId":"d","name":"n","commanderId":"c","cards":{"x":2,"y":1}}'),
        (2, '{"commanderId":"c","cards":{}}'),
        (3, "{}"),
        (4, '{"deckId":"d","cards":{"x"'),
        (5, None),
    ]
    loaded = drafts.load_drafts(spark.createDataFrame(texts, "k int, draft string"))
    got = rows_of(loaded, "k", "deck_id", "name", "commander_id", "is_empty")
    assert got == [
        (1, "d", "n", "c", False), (2, None, None, "c", False), (3, None, None, None, True),
        (4, None, None, None, True), (5, None, None, None, True),
    ]
    assert rows_of(drafts.draft_cards(loaded, "k")) == [(1, "x", 2), (1, "y", 1)]
    back = drafts.drafts_to_json(loaded).where("k < 4")
    again = drafts.load_drafts(back)
    assert rows_of(again, "k", "deck_id", "commander_id", F.size("cards")) == rows_of(
        loaded.where("k < 4"), "k", "deck_id", "commander_id", F.size("cards")
    )


def test_open_saved_decks(spark):
    saved = spark.createDataFrame(
        [("d", "n", "c", [("x", 1), ("y", 2), ("x", 5)])],
        "id string, name string, commander_id string, cards array<struct<card_id:string,quantity:int>>",
    )
    assert drafts.open_decks(saved).first()["cards"] == {"x": 5, "y": 2}


def test_stored_tables(spark, tmp_path):
    base, schema = str(tmp_path / "t"), "a int"
    assert stores.load_table(spark, base, schema) is None
    assert stores.load_or_seed(spark, base, schema, spark.createDataFrame([(1,)], schema)).count() == 1
    assert stores.load_or_seed(spark, base, schema, spark.createDataFrame([(1,), (2,)], schema)).count() == 1
    stores.save_table(stores.load_table(spark, base, schema).unionByName(spark.createDataFrame([(5,)], schema)), base)  # read while replaced
    assert sorted(r.a for r in stores.load_table(spark, base, schema).collect()) == [1, 5]
    (tmp_path / "t").rename(tmp_path / "t-next")  # stopped after the old rows went
    assert stores.load_table(spark, base, schema).count() == 2
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert stores.load_table(spark, base, schema) is None


def test_deck_list_files(spark, make_cards, tmp_path):
    cards = make_cards([("l", "Lead", "Legendary Creature", "W"), ("p", "Plains", "Basic Land", "")])
    decks_ = spark.createDataFrame([("d", "u", "l")], "id string, user_id string, commander_id string")
    deck_cards = spark.createDataFrame([("d", "p", 99)], "deck_id string, card_id string, quantity int")
    export.write_deck_lists(decks.export_lines(decks_, deck_cards, cards), str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert {(r["section"], r["line"]) for r in rows} == {("Commander", "1 Lead"), ("Deck", "99 Plains")}
