"""Saved decks: sizes, caps, leaders, ownership splits and export lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.constants import DECK_SIZE, MAX_DECKS, SEARCH_LIMIT
from cardloom.operators import facets, running
from cardloom.operators.collection import with_owned


def deck_sizes(decks: DataFrame, deck_cards: DataFrame) -> DataFrame:
    """Copies plus one for a commander, and whether the deck is complete.

    The copies are added up per deck before the join, so the join moves one row per deck.
    """
    copies = deck_cards.groupBy(F.col("deck_id").alias("id")).agg(F.sum("quantity").alias("_copies"))
    size = F.coalesce("_copies", F.lit(0)) + F.col("commander_id").isNotNull().cast("int")
    status = (
        F.when(F.col("deck_size") == DECK_SIZE, "complete").when(F.col("deck_size") > DECK_SIZE, "over").otherwise("under")
    )
    return (
        decks.join(copies, "id", "left")
        .select(F.col("id").alias("deck_id"), "user_id", size.cast("bigint").alias("deck_size"))
        .withColumn("status", status)
    )


def decks_per_user(decks: DataFrame, cap: int = MAX_DECKS) -> DataFrame:
    counts = decks.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_decks"))
    return counts.withColumn("at_cap", F.col("n_decks") >= cap)


def commander_ids(decks: DataFrame) -> DataFrame:
    """Distinct commanders in use."""
    return decks.where(F.col("commander_id").isNotNull()).select(F.col("commander_id").alias("card_id")).distinct()


def with_commanders(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """Add commander name, default deck name and display date; no match leaves NULL."""
    leaders = cards.select(F.col("id").alias("commander_id"), F.col("name").alias("commander_name"))
    return (
        decks.join(leaders, "commander_id", "left")
        .withColumn("default_name", C.default_deck_name("commander_name"))
        .withColumn("updated_label", C.display_date("updated_at"))
    )


def newest_first(decks: DataFrame) -> DataFrame:
    return decks.orderBy(F.col("updated_at").desc(), "id")


def newest_ranked(decks: DataFrame) -> DataFrame:
    """Each user's decks with their ``place``, the last changed first; a deck without a time comes last."""
    age = -F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**62)))
    return running.ranked(decks, ["user_id"], [age, F.col("id")], "place")


def ownership_split(deck_cards: DataFrame, decks: DataFrame, collection: DataFrame) -> DataFrame:
    """Per deck card: owned, missing and proxy. A card not owned at all is a proxy."""
    owners = decks.select(F.col("id").alias("deck_id"), "user_id")
    rows = with_owned(deck_cards.join(owners, "deck_id"), collection)
    return (
        rows.withColumn("owned", F.col("owned_quantity") > 0)
        .withColumn("missing_quantity", F.greatest(F.col("quantity") - F.col("owned_quantity"), F.lit(0)))
        .withColumn("proxy", ~F.col("owned"))
    )


def member_ids(decks: DataFrame, deck_cards: DataFrame) -> DataFrame:
    """Ids of deck cards together with the commander: distinct (deck_id, card_id)."""
    leaders = decks.where(F.col("commander_id").isNotNull()).select(
        F.col("id").alias("deck_id"), F.col("commander_id").alias("card_id")
    )
    return deck_cards.select("deck_id", "card_id").unionByName(leaders).distinct()


def addable_results(
    deck_queries: DataFrame, decks: DataFrame, deck_cards: DataFrame, cards: DataFrame, limit: int = SEARCH_LIMIT
) -> DataFrame:
    """Search results per deck with in-deck marker and whether a card can be added."""
    found = facets.search_batch(cards, deck_queries.select(F.col("deck_id").alias("query_id"), "query"), limit)
    found = found.withColumnRenamed("query_id", "deck_id")
    marked = found.join(
        member_ids(decks, deck_cards).withColumn("_in", F.lit(True)), ["deck_id", "card_id"], "left"
    ).withColumn("in_deck", F.coalesce("_in", F.lit(False)))
    types = cards.select(F.col("id").alias("card_id"), C.is_basic_land().alias("_basic"))
    return (
        marked.join(types, "card_id")
        .withColumn("addable", ~F.col("in_deck") | F.col("_basic"))
        .select("deck_id", "rank", "card_id", "in_deck", "addable")
    )


def export_lines(decks: DataFrame, deck_cards: DataFrame, cards: DataFrame) -> DataFrame:
    """One text line per card: quantity and name; the commander has its own section."""
    names = cards.select(F.col("id").alias("card_id"), "name")
    leaders = decks.where(F.col("commander_id").isNotNull()).select(
        F.col("id").alias("deck_id"),
        F.col("commander_id").alias("card_id"),
        F.lit(1).cast("bigint").alias("quantity"),
        F.lit("Commander").alias("section"),
    )
    listed = deck_cards.select("deck_id", "card_id", F.col("quantity").cast("bigint").alias("quantity"), F.lit("Deck").alias("section"))
    return (
        leaders.unionByName(listed)
        .join(names, "card_id")
        .select("deck_id", "section", "name", F.concat_ws(" ", F.col("quantity").cast("string"), "name").alias("line"))
    )


def pip_demand(deck_cards: DataFrame, cards: DataFrame) -> DataFrame:
    """Mana symbols a deck asks for: copies times symbols, per deck and label."""
    symbols = cards.select(
        F.col("id").alias("card_id"), F.transform(C.mana_symbols("mana_cost"), C.symbol_label).alias("_symbols")
    ).where(F.size("_symbols") > 0)
    rows = deck_cards.join(symbols, "card_id").select("deck_id", "quantity", F.explode("_symbols").alias("symbol"))
    return rows.groupBy("deck_id", "symbol").agg(F.sum("quantity").cast("bigint").alias("pips"))
