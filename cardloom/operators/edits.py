"""Replay of deck edit logs: many decks, one ordered log.

A log row is (deck_id, seq, op, card_id, quantity) with a unique ``seq``. Ops:

* ``add``, ``remove``: one copy more (basic lands stack, others stay at one) or less
* ``set_commander``, ``remove_commander``
* ``clear``: empty the deck
* ``open``: replace the whole deck; its content follows as ``put`` rows
  (``quantity`` copies) and at most one ``seat`` row (the commander)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.operators import running

RESETS = ["clear", "open"]
LEADER_OPS = ["set_commander", "remove_commander", "seat"]
_NEVER = float("-inf")


def since_last_reset(log: DataFrame) -> DataFrame:
    """Only rows after the deck's last reset can matter."""
    resets = log.where(F.col("op").isin(RESETS)).groupBy("deck_id").agg(F.max("seq").alias("_reset"))
    return (
        log.where(~F.col("op").isin(RESETS))
        .join(resets, "deck_id", "left")
        .where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")))
        .drop("_reset")
    )


def _leader_events(log: DataFrame) -> DataFrame:
    holder = F.when(F.col("op") != "remove_commander", F.col("card_id"))
    return log.where(F.col("op").isin(LEADER_OPS)).select("deck_id", "seq", "op", holder.alias("leader"))


def replay_commanders(log: DataFrame) -> DataFrame:
    """Commander of each deck after the whole log; one row per deck in the log."""
    last = (
        _leader_events(since_last_reset(log))
        .groupBy("deck_id")
        .agg(F.max_by(F.struct("leader"), "seq")["leader"].alias("commander_id"))
    )
    return log.select("deck_id").distinct().join(last, "deck_id", "left")


def replay_cards(log: DataFrame, cards: DataFrame, chunk_rows: int = running.CHUNK_ROWS) -> DataFrame:
    """Cards of each deck after the whole log: (deck_id, card_id, quantity).

    The effect of a commander change on the displaced card becomes a row of its
    own, so every (deck, card) folds independently of the others.
    """
    live = since_last_reset(log)
    changes = running.with_previous(_leader_events(live), ["deck_id"], "seq", "leader", "displaced", chunk_rows)
    returned = changes.where(
        (F.col("op") == "set_commander") & F.col("displaced").isNotNull() & (F.col("displaced") != F.col("leader"))
    ).select(
        "deck_id", F.col("displaced").alias("card_id"), "seq", F.lit(1).alias("part"),
        F.lit(0.0).alias("shift"), F.lit(1.0).alias("floor"),
    )

    basics = cards.where(C.is_basic_land()).select(F.col("id").alias("card_id"), F.lit(True).alias("_basic"))
    commands = live.where(F.col("op").isin("add", "remove", "put", "set_commander")).join(basics, "card_id", "left")
    stacks = (F.col("op") == "add") & F.col("_basic").isNotNull()
    shift = (
        F.when(stacks, F.lit(1.0))
        .when(F.col("op") == "add", F.lit(0.0))
        .when(F.col("op") == "remove", F.lit(-1.0))
        .otherwise(F.lit(_NEVER))
    )
    floor = (
        F.when(F.col("op") == "add", F.lit(1.0))
        .when(F.col("op") == "put", F.col("quantity").cast("double"))
        .otherwise(F.lit(0.0))
    )
    steps = commands.select(
        "deck_id", "card_id", "seq", F.lit(0).alias("part"), shift.alias("shift"), floor.alias("floor")
    ).unionByName(returned)
    folded = running.fold_floors(
        steps, ["deck_id", "card_id"], ["seq", "part"], "seq", "shift", "floor", chunk_rows
    )
    return folded.select("deck_id", "card_id", F.col("value").cast("bigint").alias("quantity")).where(
        F.col("quantity") > 0
    )


def advance(
    deck_state: DataFrame, leaders: DataFrame, log: DataFrame, cards: DataFrame, chunk_rows: int = running.CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Apply a further stretch of log to known decks -> (deck cards, commanders).

    The known state enters as rows that precede the log, so the same distributed
    fold serves the first batch and every later one.
    """
    columns = ["deck_id", "seq", "op", "card_id", "quantity"]
    before = F.lit(-1).cast("bigint").alias("seq")
    held = deck_state.select("deck_id", before, F.lit("put").alias("op"), "card_id", F.col("quantity").cast("bigint"))
    seated = leaders.select(
        "deck_id",
        before,
        F.when(F.col("commander_id").isNull(), "remove_commander").otherwise("seat").alias("op"),
        F.col("commander_id").alias("card_id"),
        F.lit(None).cast("bigint").alias("quantity"),
    )
    whole = held.unionByName(seated).unionByName(log.select(*columns))
    return replay_cards(whole, cards, chunk_rows), replay_commanders(whole)
