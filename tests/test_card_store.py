"""Loads of cards and metadata: what differs is found, what does not is left alone."""

from cardloom.sources import card_store

ROW = "id string, name string, mana_value double, color_identity array<string>, ordinal bigint"
META = "card_id string, summary string, roles array<string>, themes array<string>, power_rating double"


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("bucket=*/*.parquet")}


def test_a_second_load_writes_nothing(spark, rows_of, tmp_path):
    base = str(tmp_path)
    rows = [(f"c{k}", f"Card {k}", float(k), ["W"] if k % 2 else None, k) for k in range(300)]
    cards = spark.createDataFrame(rows, ROW)
    assert set(rows_of(card_store.load_cards(cards, base))) == {(f"c{k}", "new") for k in range(300)}
    before = files(tmp_path)
    assert card_store.load_cards(cards, base).count() == 0 and files(tmp_path) == before
    # One changes, one goes, one comes: at most three buckets are written again.
    later = [r for r in rows if r[0] != "c7"] + [("d", "New", 1.0, [], 1)]
    later[3] = ("c3", "Other", 3.0, ["W"], 3)
    assert rows_of(card_store.load_cards(spark.createDataFrame(later, ROW), base)) == sorted([("c3", "changed"), ("c7", "gone"), ("d", "new")])
    after = files(tmp_path)
    assert 1 <= len(set(before) - set(after)) <= 3 and all(after[p] == t for p, t in before.items() if p in after)
    held = {r.id: r for r in card_store.read_cards_stored(spark, base).collect()}
    assert len(held) == 300 and held["c3"].name == "Other" and held["c3"].ordinal == 3 and held["d"].ordinal == 301 and held["c1"].ci_mask == 1
    # All go: the store is empty, not as it was.
    assert card_store.load_cards(spark.createDataFrame([], ROW), base).count() == 300
    assert card_store.read_cards_stored(spark, base).count() == 0


def test_metadata_with_a_reference_check(spark, rows_of, tmp_path):
    base = str(tmp_path)
    card_store.load_cards(spark.createDataFrame([("a", "A", 0.0, [], 0), ("b", "B", 0.0, [], 1)], ROW), base)
    rows = [("a", "s", ["Ramp", "Draw", "Ramp"], None, 2.0), ("b", None, [], ["Tokens"], None), ("x", "?", ["R"], [], 1.0), (None, "?", ["R"], [], 1.0)]
    changes, refused = card_store.load_metadata(spark.createDataFrame(rows, META), base)
    assert sorted(str(r.card_id) for r in refused.collect()) == ["None", "x"]
    assert rows_of(changes) == sorted([("a", "metadata", "new"), ("b", "metadata", "new"), *[("a", "card_roles", "new")] * 3, ("b", "card_themes", "new")])
    back = {r.card_id: r for r in card_store.read_metadata(spark, base).collect()}
    assert back["a"].roles == ["Ramp", "Draw", "Ramp"] and back["a"].themes == [] and back["b"].roles == [] and back["b"].themes == ["Tokens"]
    rows[0] = ("a", "s", ["Ramp"], None, 2.0)
    changes, _ = card_store.load_metadata(spark.createDataFrame(rows, META), base)
    assert rows_of(changes) == [("a", "card_roles", "gone")] * 2
    assert next(r.roles for r in card_store.read_metadata(spark, base).collect() if r.card_id == "a") == ["Ramp"]
