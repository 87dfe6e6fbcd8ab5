"""How often cards are played, overall and next to a given commander.

``deck_cards`` holds one row per (deck_id, card_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.session import written


def card_inclusion(decks: DataFrame, deck_cards: DataFrame) -> DataFrame:
    """Decks that play a card, as count and share of all decks."""
    n_all = decks.agg(F.count(F.lit(1))).scalar()
    played = deck_cards.groupBy("card_id").agg(F.count(F.lit(1)).alias("n_decks"))
    return played.withColumn("share", F.col("n_decks") / n_all)


def commander_cooccurrence(decks: DataFrame, deck_cards: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards played under each commander, with share and synergy.

    ``share`` is the part of the commander's decks that play the card.
    ``synergy`` subtracts the part of all decks that do so among decks whose
    commander could play it by color identity. A deck contributes one row per
    card, never pairs of cards.
    """
    info = cards.select(F.col("id").alias("commander_id"), F.col("ci_mask").alias("leader_mask"))
    led = decks.join(info, "commander_id").select(F.col("id").alias("deck_id"), "commander_id", "leader_mask")
    per_leader = led.groupBy("commander_id").agg(F.count(F.lit(1)).alias("leader_decks"))

    # Decks per identity (at most 32 rows), then per identity that fits inside.
    by_mask = led.groupBy("leader_mask").agg(F.count(F.lit(1)).alias("n"))
    open_to = (
        by_mask.select("n", "leader_mask", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("ci_mask"))
        .where(C.mask_within("ci_mask", "leader_mask"))
        .groupBy("ci_mask")
        .agg(F.sum("n").alias("eligible_decks"))
    )

    masks = cards.select(F.col("id").alias("card_id"), "ci_mask")
    together = (
        deck_cards.select("deck_id", "card_id")
        .join(led, "deck_id")
        .groupBy("commander_id", "leader_mask", "card_id")
        .agg(F.count(F.lit(1)).alias("n_decks"))
        .join(masks, "card_id")
    )
    together = written(together, "together")  # read twice
    elsewhere = (
        together.where(C.mask_within("ci_mask", "leader_mask"))
        .groupBy("card_id")
        .agg(F.sum("n_decks").alias("eligible_playing"))
    )
    share = F.col("n_decks") / F.col("leader_decks")
    base = F.coalesce(F.col("eligible_playing") / F.col("eligible_decks"), F.lit(0.0))
    return (
        together.join(per_leader, "commander_id")
        .join(elsewhere, "card_id", "left")
        .join(F.broadcast(open_to), "ci_mask", "left")  # at most 32 rows
        .select("commander_id", "card_id", "n_decks", share.alias("share"), (share - base).alias("synergy"))
    )
