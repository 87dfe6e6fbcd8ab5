"""Saved decks with their cards in one table, as they are listed and opened again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom import schemas
from cardloom.sources import stores

SAVED = T.StructType([*schemas.DECK, T.StructField("cards", T.ArrayType(T.StructType([
    T.StructField("card_id", T.StringType()), T.StructField("quantity", T.IntegerType()),
])))])


def with_cards(decks: DataFrame, deck_cards: DataFrame) -> DataFrame:
    """Decks in the stored shape, each with its list of cards in the order of their ids (as long as the deck itself)."""
    entry = F.struct(F.col("card_id").cast("string").alias("card_id"), F.col("quantity").cast("int").alias("quantity"))
    lists = deck_cards.groupBy(F.col("deck_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("cards"))
    facts = schemas.conform(decks, schemas.DECK)
    return facts.join(lists, "id", "left").withColumn("cards", F.coalesce("cards", F.array().cast(SAVED["cards"].dataType)))


def save_decks(decks: DataFrame, base: str) -> None:
    """Replace the stored decks. Columns beyond the stored shape are stored with them."""
    stores.save_table(decks, base)


def load_decks(spark: SparkSession, base: str) -> DataFrame:
    """The stored decks, in the declared shape.

    Files of an older or newer shape are read together, by the declared columns: what one lacks is NULL, or an empty
    list of cards. Files that cannot be read count as empty, as does a store that is not there.
    """
    if not stores.is_whole(spark, base):
        return spark.createDataFrame([], SAVED)
    rows = spark.read.schema(SAVED).option("ignoreCorruptFiles", True).parquet(base)
    return rows.withColumn("cards", F.coalesce("cards", F.array().cast(SAVED["cards"].dataType)))


def deck_rows(decks: DataFrame) -> DataFrame:
    """(deck_id, card_id, quantity) of the decks' lists."""
    return decks.select(F.col("id").alias("deck_id"), F.inline("cards"))
