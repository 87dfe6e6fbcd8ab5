"""Deck rules. Every violation of a deck is reported, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.constants import DECK_SIZE


def _leaders(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """One row per deck with the commander's eligibility and identity mask."""
    info = cards.select(
        F.col("id").alias("commander_id"), C.can_lead().alias("can_lead"), F.col("ci_mask").alias("leader_mask")
    )
    return decks.select(F.col("id").alias("deck_id"), "commander_id").join(info, "commander_id", "left")


def identity_violations(decks: DataFrame, deck_cards: DataFrame, cards: DataFrame) -> DataFrame:
    """Deck cards with a color outside the commander's identity."""
    masks = cards.select(F.col("id").alias("card_id"), "ci_mask")
    leaders = _leaders(decks, cards).where(F.col("leader_mask").isNotNull())
    rows = deck_cards.join(masks, "card_id").join(leaders, "deck_id")
    return rows.where(~C.mask_within("ci_mask", "leader_mask")).select(
        "deck_id", "card_id", F.col("ci_mask").bitwiseAND(F.bitwise_not(F.col("leader_mask"))).alias("extra_mask")
    )


def deck_errors(facts: DataFrame, deck_size: int = DECK_SIZE, copy_limit: int = 1) -> Column:
    """Violations of one deck per row, NULL-free and in rule order.

    ``facts`` has deck_size, has_commander, can_lead and leader_mask (both NULL for
    an unknown commander), mask (all colors played) and repeated (cards beyond the
    copy limit).
    """
    size, can_lead, leader = facts["deck_size"], facts["can_lead"], facts["leader_mask"]
    return F.array_compact(
        F.array(
            F.when(size != deck_size, F.concat(F.lit(f"expected {deck_size} cards, found "), size.cast("string"))),
            F.when(~facts["has_commander"], F.lit("no commander"))
            .when(can_lead.isNull(), F.lit("commander is not in the catalogue"))
            .when(~can_lead, F.lit("commander is not a legendary creature")),
            F.when(leader.isNull(), F.lit("color identity cannot be checked")).when(
                ~C.mask_within(facts["mask"], leader), F.lit("cards outside the commander's color identity")
            ),
            F.when(
                facts["repeated"] > 0,
                F.concat(facts["repeated"].cast("string"), F.lit(f" cards exceed {copy_limit} copy")),
            ),
        )
    )


def card_facts(cards: DataFrame) -> DataFrame:
    """What the rules need to know of a card."""
    return cards.select(
        F.col("id").alias("card_id"),
        F.col("name").alias("card_name"),
        F.coalesce(F.col("oracle_id").cast("string"), F.col("id").cast("string")).alias("copy_key"),
        C.is_basic_land().alias("basic"),
        C.can_lead().alias("can_lead"),
        "ci_mask",
    )


def deck_facts(rows: DataFrame, deck: list[str], copy_limit: int = 1) -> DataFrame:
    """Per deck: copies, colors, cards beyond the copy limit and unknown cards.

    ``rows`` are deck cards joined with their facts; ``listed`` names the entry as
    the deck has it. Copies of one card combine before any exchange on the deck.
    """
    known = F.col("copy_key").isNotNull()
    per_card = rows.groupBy(*deck, F.coalesce("copy_key", "listed").alias("_key"), known.alias("_known")).agg(
        F.sum("quantity").alias("_copies"),
        F.bool_or(F.coalesce("basic", F.lit(True))).alias("_exempt"),
        F.bit_or(F.coalesce("ci_mask", F.lit(0))).alias("_mask"),
    )
    return per_card.groupBy(*deck).agg(
        F.sum("_copies").alias("copies"),
        F.count_if(~F.col("_exempt") & (F.col("_copies") > copy_limit)).alias("repeated"),
        F.bit_or("_mask").alias("mask"),
        F.count_if(~F.col("_known") & F.col("_key").isNotNull()).alias("unknown"),
    )


def validate_decks(
    decks: DataFrame, deck_cards: DataFrame, cards: DataFrame, deck_size: int = DECK_SIZE, copy_limit: int = 1
) -> DataFrame:
    """deck_id, deck_size, is_valid and the ``"; "``-joined errors.

    Copies count per ``oracle_id`` (per card id where a card has none), basic
    lands aside. The identity rule needs a known commander; without one it is
    reported as not evaluable. Cards missing from the catalogue count towards
    the size and are reported.
    """
    rows = deck_cards.join(card_facts(cards).drop("can_lead"), "card_id", "left")
    per_deck = deck_facts(rows.withColumn("listed", F.col("card_id").cast("string")), ["deck_id"], copy_limit)
    whole = _leaders(decks, cards).join(per_deck, "deck_id", "left")
    led = F.col("commander_id").isNotNull()
    facts = whole.select(
        "deck_id",
        (F.coalesce("copies", F.lit(0)) + led.cast("int")).cast("bigint").alias("deck_size"),
        led.alias("has_commander"),
        "can_lead",
        "leader_mask",
        F.coalesce("mask", F.lit(0)).alias("mask"),
        F.coalesce("repeated", F.lit(0)).alias("repeated"),
        F.coalesce("unknown", F.lit(0)).alias("unknown"),
    )
    note = F.when(F.col("unknown") > 0, F.concat(F.col("unknown").cast("string"), F.lit(" unknown cards")))
    errors = F.concat(deck_errors(facts, deck_size, copy_limit), F.array_compact(F.array(note)))
    return facts.withColumn("_errors", errors).select(
        "deck_id",
        "deck_size",
        (F.size("_errors") == 0).alias("is_valid"),
        F.array_join("_errors", "; ").alias("errors"),
    )
