"""User collections: library joins, totals and additive upserts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.session import written


def first_named(cards: DataFrame) -> DataFrame:
    """One card for each name: the first of the pool."""
    rest = [c for c in cards.columns if c != "name"]
    return cards.groupBy("name").agg(F.min_by(F.struct(*rest), F.struct("ordinal", "id")).alias("_first")).select("name", "_first.*").select(*cards.columns)


def library(cards: DataFrame, collection: DataFrame) -> DataFrame:
    """All card columns plus user and quantity; empty and unknown entries drop out."""
    owned = collection.where(F.col("quantity") != 0).select("user_id", F.col("card_id").alias("id"), "quantity")
    return cards.join(owned, "id")


def totals(collection: DataFrame) -> DataFrame:
    """Copies per user over the whole, unfiltered collection."""
    return collection.groupBy("user_id").agg(F.sum("quantity").cast("bigint").alias("total_copies"))


def with_owned(rows: DataFrame, collection: DataFrame) -> DataFrame:
    """Add the owned quantity of (user_id, card_id), zero when absent."""
    owned = collection.select("user_id", "card_id", F.col("quantity").alias("_owned"))
    return (
        rows.join(owned, ["user_id", "card_id"], "left")
        .withColumn("owned_quantity", F.coalesce("_owned", F.lit(0)))
        .drop("_owned")
    )


def add_copies(collection: DataFrame, adds: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Additive upsert -> (new collection, rejected adds with unknown card ids)."""
    ids = cards.select(F.col("id").alias("card_id"))
    known = adds.join(ids, "card_id", "left_semi")
    rejected = adds.join(ids, "card_id", "left_anti")
    columns = ["user_id", "card_id", "quantity"]
    merged = (
        collection.select(*columns)
        .unionByName(known.select("user_id", "card_id", C.clamp_copies("quantity").alias("quantity")))
        .groupBy("user_id", "card_id")
        .agg(F.sum("quantity").cast("bigint").alias("quantity"))
    )
    return merged, rejected


def replace_or_append(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; others are appended."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def seed(cards: DataFrame, quantities: DataFrame, user: Column) -> DataFrame:
    """Initial collection of a user from (name, quantity) rows; of several cards of one name the first of the pool."""
    wanted = quantities.where(F.col("quantity") > 0)
    return first_named(cards.select("name", "id", "ordinal")).join(wanted, "name").select(user.alias("user_id"), F.col("id").alias("card_id"), "quantity")


def judge_import(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Imported (user_id, name, quantity, corrupt) lines with their ``card_id`` and the ``reason`` they are refused for.

    A line is refused when it did not parse, has no positive quantity, or names no card. Of several cards of one
    name the first of the pool is meant.
    """
    named = first_named(cards.select("name", "id", "ordinal")).select(F.col("name").alias("_known"), F.col("id").alias("card_id"))
    checked = rows.withColumn("name", C.trim_all("name")).join(named, F.col("name") == F.col("_known"), "left")
    reason = (
        F.when(F.col("corrupt").isNotNull() | F.col("quantity").isNull() | F.col("name").isNull(), F.lit("malformed"))
        .when(F.col("quantity") <= 0, F.lit("quantity"))
        .when(F.col("_known").isNull(), F.lit("unknown card"))
    )
    return checked.withColumn("reason", reason).drop("_known")


def _imported(judged: DataFrame) -> DataFrame:
    return (
        judged.where(F.col("reason").isNull())
        .groupBy("user_id", "card_id")
        .agg(F.sum("quantity").cast("bigint").alias("quantity"))
    )


def resolve_import(rows: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imported lines -> (collection rows, quarantine with reasons)."""
    judged = judge_import(rows, cards)
    return _imported(judged), judged.where(F.col("reason").isNotNull()).drop("card_id")


class Import(NamedTuple):
    """What an import did: the collection after it, counts per user, refused lines, and counts over all."""

    collection: DataFrame
    per_user: DataFrame
    refused: DataFrame
    imported: int
    rejected: int


def import_collection(collection: DataFrame, rows: DataFrame, cards: DataFrame) -> Import:
    """Add imported lines to a collection. The lines are judged and written once; that pass counts them, too."""
    counts = Observation("import")
    good = F.col("reason").isNull()
    watched = judge_import(rows, cards).observe(counts, F.count_if(good).alias("imported"), F.count_if(~good).alias("rejected"))
    judged = written(watched, "import")
    merged = (
        collection.select("user_id", "card_id", "quantity").unionByName(_imported(judged))
        .groupBy("user_id", "card_id").agg(F.sum("quantity").cast("bigint").alias("quantity"))
    )
    per_user = judged.groupBy("user_id").agg(F.count_if(F.col("reason").isNull()).alias("imported"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    return Import(merged, per_user, judged.where(~good).drop("card_id"), counts.get["imported"], counts.get["rejected"])
