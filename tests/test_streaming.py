"""Streams give the same tables as one batch over all rows."""

from cardloom.operators import collection as coll
from cardloom.operators import deck_log, edits
from cardloom.sources import stores
from cardloom.streaming import tables
from pyspark.sql import functions as F


def streamed(spark, df, path, parts):
    """A stream that delivers the rows in ``parts`` files, one per micro-batch."""
    for i in range(parts):
        piece = df.where(F.floor(F.col("seq") * parts / F.lit(df.count())) == i)
        piece.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_collection_stream_equals_batch(spark, rows_of, tmp_path):
    adds = spark.range(60).selectExpr("id AS seq", "id % 3 AS user_id", "(id + id div 20) % 7 AS card_id", "id % 5 AS quantity")
    base = str(tmp_path / "t")
    stream = streamed(spark, adds, tmp_path / "in", 4)
    cards = spark.range(6).selectExpr("id")  # card 6 is unknown
    finish(tables.keep_collection(stream, cards, base, str(tmp_path / "ck")))
    want, refused = coll.add_copies(spark.createDataFrame([], tables.COLLECTION), adds, cards)
    assert rows_of(tables.read_collection(spark, base)) == rows_of(want)
    assert rows_of(tables.read_refused(spark, base), "seq") == rows_of(refused, "seq") and refused.count() > 0


def test_a_new_checkpoint_adds_to_the_table(spark, rows_of, tmp_path):
    base, cards = str(tmp_path / "t"), spark.range(9).selectExpr("id")
    for number, rows in enumerate(([(0, 1, 5, 10), (1, 2, 7, 3)], [(0, 1, 5, 2)])):
        adds = spark.createDataFrame(rows, "seq bigint, user_id bigint, card_id bigint, quantity bigint")
        finish(tables.keep_collection(streamed(spark, adds, tmp_path / f"in{number}", 1), cards, base, str(tmp_path / f"ck{number}")))
    assert rows_of(tables.read_collection(spark, base)) == [(1, 5, 12), (2, 7, 3)]


def test_a_batch_that_runs_again_is_applied_once(spark, rows_of, tmp_path):
    base, schema = str(tmp_path / "t"), "k int, v bigint"
    batch = spark.createDataFrame([(k, 1) for k in range(20)], schema)

    def add(held, rows):
        return held.unionByName(rows).groupBy("k").agg(F.sum("v").alias("v"))

    for stream, number in (("a", 0), ("a", 0), ("a", 1), ("b", 0), ("a", 1), ("b", 0)):
        stores.update_buckets(batch, add, base, schema, ["k"], stream, number, buckets=8)
    assert sorted(rows_of(stores.read_buckets(spark, base, schema))) == sorted((k, 3) for k in range(20))
    only = spark.createDataFrame([(3, 0)], schema)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("bucket=*/*.parquet")}
    stores.update_buckets(only, lambda held, rows: held.where("k <> 3"), base, schema, ["k"], "a", 2, buckets=8)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("bucket=*/*.parquet")}
    assert len(set(before) - set(after)) == 1 and len(set(before) & set(after)) == len(before) - 1
    assert sorted(rows_of(stores.read_buckets(spark, base, schema))) == sorted((k, 3) for k in range(20) if k != 3)


def test_draft_stream_equals_batch(spark, rows_of, tmp_path):
    cards = spark.range(6).selectExpr("id", "CASE WHEN id = 0 THEN 'Basic Land' ELSE 'Creature' END AS type_line")
    log = spark.range(120).selectExpr(
        "CASE WHEN id > 60 THEN id % 2 ELSE id % 4 END AS deck_id", "id AS seq",
        "element_at(array('add','add','remove','set_commander','add','clear','remove_commander'), CAST(id * 31 % 37 % 7 + 1 AS INT)) AS op",
        "id * 17 % 6 AS card_id", "CAST(NULL AS BIGINT) AS quantity",
    )
    stream = streamed(spark, log, tmp_path / "in", 4)
    finish(tables.keep_drafts(stream, cards, str(tmp_path / "t"), str(tmp_path / "ck")))
    got = tables.read_drafts(spark, str(tmp_path / "t"))
    assert rows_of(got.where("NOT is_commander"), "deck_id", "card_id", "quantity") == rows_of(edits.replay_cards(log, cards))
    leaders = edits.replay_commanders(log).where("commander_id IS NOT NULL")
    assert rows_of(got.where("is_commander"), "deck_id", "card_id") == rows_of(leaders)


def test_deck_stream_keeps_the_cap_and_last_save(spark, rows_of, tmp_path):
    ops = spark.range(40).selectExpr(
        "id % 2 AS user_id", "id AS seq", "'save' AS op", "CAST(NULL AS STRING) AS deck_id",
        "concat('n', id) AS name", "id AS commander_id", "timestamp_seconds(id) AS ts",
    )
    stream = streamed(spark, ops, tmp_path / "in", 4)
    finish(tables.keep_decks(stream, str(tmp_path / "t"), str(tmp_path / "ck"), cap=7))
    got = tables.read_decks(spark, str(tmp_path / "t"))
    want, _ = deck_log.apply_ops(spark.createDataFrame([], tables.DECKS), ops, cap=7)
    assert rows_of(got) == rows_of(want) and got.count() == 14
    assert tables.read_refused(spark, str(tmp_path / "t")).count() == 26
