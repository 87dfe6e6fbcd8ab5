"""Strategic roles of cards and role-wise views of decks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.operators import running
from cardloom.functions.constants import CARD_ROLES, COUNTED_ROLES


def fixed_role_table(spark) -> DataFrame:
    """The built-in role table: (name, roles)."""
    return spark.createDataFrame(list(CARD_ROLES.items()), "name string, roles array<string>")


def assign_roles(cards: DataFrame, role_table: DataFrame | None = None, front_face: bool = False) -> DataFrame:
    """Add ``roles`` and ``primary_role``; cards without an entry are Land or Utility.

    Lookup is by exact name. ``front_face`` also tries the part of a two-faced
    name before ``//``.
    """
    table = fixed_role_table(cards.sparkSession) if role_table is None else role_table
    table = table.select(F.col("name").alias("_role_name"), F.col("roles").alias("_roles"))
    if role_table is None:
        table = F.broadcast(table)  # 66 fixed rows
    key = F.split("name", " // ", 2)[0] if front_face else F.col("name")
    fallback = F.when(C.is_land(), F.array(F.lit("Land"))).otherwise(F.array(F.lit("Utility")))
    return (
        cards.join(table, key == F.col("_role_name"), "left")
        .withColumn("roles", F.coalesce("_roles", fallback))
        .withColumn("primary_role", F.get("roles", F.lit(0)))
        .drop("_role_name", "_roles")
    )


def role_entries(deck_cards: DataFrame, cards_with_roles: DataFrame) -> DataFrame:
    """Deck rows with role, mana value and name; unknown card ids drop out."""
    info = cards_with_roles.select(
        F.col("id").alias("card_id"), "name", "mana_value", "primary_role", C.role_order_key("primary_role").alias("role_order")
    )
    return deck_cards.join(info, "card_id")


def role_columns(deck_cards: DataFrame, cards_with_roles: DataFrame) -> DataFrame:
    """Deck entries in column order: role, then mana value, then name.

    Rows stay rows: a global sort places them, so no deck is gathered into one value.
    """
    rows = role_entries(deck_cards, cards_with_roles)
    return rows.orderBy("deck_id", "role_order", "primary_role", "mana_value", C.name_key())


def role_columns_ranked(deck_cards: DataFrame, cards_with_roles: DataFrame) -> DataFrame:
    """The same with each entry's ``place`` in its deck's column."""
    rows = role_entries(deck_cards, cards_with_roles)
    return running.ranked(rows, ["deck_id", "role_order", "primary_role"], [F.col("mana_value"), C.name_key(), F.col("card_id")], "place")


def role_totals(deck_cards: DataFrame, cards_with_roles: DataFrame) -> DataFrame:
    """Per deck and role: entries and copies."""
    return (
        role_entries(deck_cards, cards_with_roles)
        .groupBy("deck_id", "primary_role", "role_order")
        .agg(F.count(F.lit(1)).alias("entries"), F.sum("quantity").cast("bigint").alias("copies"))
    )


def role_histogram(deck_cards: DataFrame, cards_with_roles: DataFrame) -> DataFrame:
    """Per deck: how many entries play each counted role as primary role."""
    counts = [
        F.count_if(F.col("primary_role") == role).alias(role.lower().replace(" ", "_")) for role in COUNTED_ROLES
    ]
    return role_entries(deck_cards, cards_with_roles).groupBy("deck_id").agg(*counts)
