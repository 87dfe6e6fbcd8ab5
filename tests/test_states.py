"""Streams with Spark's own state against the batch operators."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from cardloom.operators import edits
from cardloom.streaming import states, tables
from tests.test_streaming import finish, streamed

LOG = "deck_id bigint, seq bigint, op string, card_id bigint, quantity bigint"


def random_log(n, seed):
    pick = random.Random(seed)
    ops = ["add"] * 5 + ["remove"] * 2 + ["set_commander"] * 2 + ["remove_commander", "clear", "open", "put", "seat"]
    rows = []
    for seq in range(n):
        op = pick.choice(ops)
        card = None if op in ("clear", "open", "remove_commander") else pick.randrange(6)
        rows.append((pick.randrange(4), seq, op, card, pick.randrange(4) if op == "put" else None))
    return rows


def basics(spark):
    return spark.range(6).selectExpr("id", "CASE WHEN id < 2 THEN 'Basic Land' ELSE 'Creature' END AS type_line")


def expected(spark, log):
    cards = basics(spark)
    inside = edits.replay_cards(log, cards).select("deck_id", "card_id", "quantity", F.lit(False).alias("is_commander"))
    leaders = edits.replay_commanders(log).where("commander_id IS NOT NULL")
    return inside.unionByName(leaders.selectExpr("deck_id", "commander_id AS card_id", "1L AS quantity", "true AS is_commander"))


def test_folded_drafts_equal_the_replay(spark, rows_of, tmp_path):
    log = spark.createDataFrame(random_log(300, 3), LOG)
    odd = spark.createDataFrame([(None, 300, "add", 1, None), (1, 301, "add", None, None)], LOG)
    base, checkpoint = str(tmp_path / "t"), str(tmp_path / "ck")
    finish(states.fold_drafts(streamed(spark, log.unionByName(odd), tmp_path / "in", 5), basics(spark), base, checkpoint))
    assert rows_of(states.folded_drafts(spark, base)) == rows_of(expected(spark, log))


def test_folded_drafts_go_on_after_a_restart(spark, rows_of, tmp_path):
    rows = random_log(200, 8)
    log = spark.createDataFrame(rows, LOG)
    base, checkpoint, folder = str(tmp_path / "t"), str(tmp_path / "ck"), tmp_path / "in"
    for part in range(3):  # a new query each time, from the state that the checkpoint keeps
        log.where(F.col("seq").between(part * 70, part * 70 + 69)).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(folder))
        finish(states.fold_drafts(stream, basics(spark), base, checkpoint))
        so_far = log.where(F.col("seq") < part * 70 + 70)
        assert rows_of(states.folded_drafts(spark, base)) == rows_of(expected(spark, so_far))


class CountedState:
    """A deck's value state that counts the trips to it."""

    def __init__(self):
        self.value, self.trips = None, 0

    def get(self):
        self.trips += 1
        return self.value

    def update(self, value):
        self.trips += 1
        self.value = value

    def clear(self):
        self.update(None)


def test_a_batch_makes_two_trips_to_the_state():
    state = CountedState()
    fold = states.DraftFold()
    fold.init(type("Handle", (), {"getValueState": lambda self, name, schema: state})())
    big = 2**53 + 1  # exact beside commands that name no card
    first = [Row(seq=2 + k, op="add", card_id=big + k, quantity=None, stacks=False) for k in range(50)]
    first += [Row(seq=99, op="seat", card_id=3, quantity=None, stacks=False), Row(seq=1, op="add", card_id=1, quantity=None, stacks=True), Row(seq=0, op="clear", card_id=None, quantity=None, stacks=False)]
    out = list(fold.handleInputRows((7,), iter(first), None))
    assert sorted(r.card_id for r in out if not r.is_commander) == [1, *range(big, big + 50)] and state.trips == 2
    out = list(fold.handleInputRows((7,), iter([Row(seq=100, op="clear", card_id=None, quantity=None, stacks=False)]), None))
    assert {(r.quantity, r.seq) for r in out} == {(0, 100)} and len(out) == 52 and state.trips == 4 and state.value is None


ADDS = "event_id bigint, ts timestamp, user_id bigint, card_id bigint, quantity bigint"


def test_counted_adds(spark, rows_of, tmp_path):
    """Repeated events count once, late ones are dropped and counted, unknown cards do not count."""
    def at(hour, minute=0):
        return f"2024-01-01 {hour:02d}:{minute:02d}:00"

    batches = [
        [(1, at(1), 7, 3, 2), (1, at(1), 7, 3, 2), (2, at(1, 5), 7, 3, 200), (3, at(1), 8, 99, 1)],
        [(2, at(1, 5), 7, 3, 200), (4, at(5), 8, 3, 1)],  # 2 again, in time
        [(5, at(2), 7, 3, 50), (6, at(5, 1), 7, 4, 0), (4, at(5), 8, 3, 1)],  # 5 is late, 4 again
    ]
    cards, base, folder = spark.range(5).selectExpr("id"), str(tmp_path / "t"), tmp_path / "in"
    late = 0
    for rows in batches:
        raw = spark.createDataFrame(rows, ADDS.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
        raw.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(ADDS).parquet(str(folder))
        query = states.count_adds(stream, cards, base, str(tmp_path / "ck"))
        finish(query)
        late += states.late_rows(query)
    assert rows_of(tables.read_collection(spark, base), "user_id", "card_id", "quantity") == [(7, 3, 101), (7, 4, 1), (8, 3, 1)]
    assert late == 1
    held = spark.createDataFrame([(7, 3, 9), (9, 1, 1)], tables.COLLECTION)
    whole = states.with_base(held, tables.read_collection(spark, base))
    assert rows_of(whole, "user_id", "card_id", "quantity") == [(7, 3, 110), (7, 4, 1), (8, 3, 1), (9, 1, 1)]
