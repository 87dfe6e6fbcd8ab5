"""Tables kept up to date from streams of commands.

A table lies in hash buckets of its key. A micro-batch reads and replaces the buckets it touches and
no others, so its cost follows the batch. What a batch brings is applied to the rows held, whichever
stream or checkpoint wrote them; a batch that runs again after a failure is not applied twice.
Commands that are refused are kept in a table of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardloom.functions.constants import MAX_DECKS
from cardloom.operators import deck_log, edits
from cardloom.operators.collection import add_copies
from cardloom.sources import stores

COLLECTION = "user_id bigint, card_id bigint, quantity bigint"
COLLECTION_KEYS = ["user_id", "card_id"]
DECKS = (
    "id string, user_id bigint, name string, commander_id bigint, created_at timestamp, updated_at timestamp, "
    "cards array<struct<card_id:bigint,quantity:int>>"
)
DECK_KEYS = ["user_id"]
DRAFTS = "deck_id bigint, card_id bigint, quantity bigint, is_commander boolean"
DRAFT_KEYS = ["deck_id"]

# (held rows of the touched keys, batch) -> (their new rows, refused commands or None)
Update = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]


def _refused(base: str) -> str:
    return f"{base}-refused"


def _keep(stream: DataFrame, update: Update, base: str, schema: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The query's id is kept in its checkpoint: a new checkpoint is a new stream, whose batches count anew.
        name = spark.read.json(f"{checkpoint}/metadata").first().id

        def change(held: DataFrame, commands: DataFrame) -> DataFrame:
            touched = commands.select(*keys).distinct()
            rows, refused = update(held.join(touched, keys, "left_semi"), commands)
            if refused is not None:
                # By bucket: a batch that runs again handles, and writes again, only those it had not finished.
                placed = refused.withColumn("bucket", stores.bucket_of(keys))
                placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{_refused(base)}/stream={name}/batch={number}")
            return rows.select(*held.columns).unionByName(held.join(touched, keys, "left_anti"))

        stores.update_buckets(batch, change, base, schema, keys, name, number)

    return (
        stream.writeStream.outputMode("append")
        .foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_refused(spark: SparkSession, base: str) -> DataFrame:
    """Refused commands of all streams, with the stream and batch that brought them."""
    return spark.read.parquet(_refused(base)).drop("bucket")


def keep_collection(adds: DataFrame, cards: DataFrame, base: str, checkpoint: str, schema: str = COLLECTION) -> StreamingQuery:
    """Maintain a collection table: copies are added to those held; adds of unknown cards are refused."""

    def update(held: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        return add_copies(held, batch, cards)

    return _keep(adds, update, base, schema, COLLECTION_KEYS, checkpoint)


def read_collection(spark: SparkSession, base: str, schema: str = COLLECTION) -> DataFrame:
    return stores.read_buckets(spark, base, schema)


def keep_decks(
    ops: DataFrame, base: str, checkpoint: str, cap: int = MAX_DECKS, schema: str = DECKS
) -> StreamingQuery:
    """Maintain the saved decks with their cards: the last save wins, deletes repeat safely, creates obey the cap.

    Names are trimmed; saves with a blank or overlong one are refused, like creates beyond the cap. Commands without `cards`
    save decks without any.
    """
    if "cards" not in ops.columns:
        ops = ops.withColumn("cards", F.lit(None).cast("array<struct<card_id:bigint,quantity:int>>"))

    def update(held: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        named, unnamed = deck_log.clean_names(batch)
        rows, refused = deck_log.apply_ops(held, named, cap)
        return rows, refused.unionByName(unnamed.select(*refused.columns))

    return _keep(ops, update, base, schema, DECK_KEYS, checkpoint)


def read_decks(spark: SparkSession, base: str, schema: str = DECKS) -> DataFrame:
    return stores.read_buckets(spark, base, schema)


def keep_drafts(
    log: DataFrame, cards: DataFrame, base: str, checkpoint: str, schema: str = DRAFTS
) -> StreamingQuery:
    """Maintain draft decks from an edit stream; a row is a card or the commander."""

    def update(held: DataFrame, batch: DataFrame) -> tuple[DataFrame, None]:
        inside = held.where(~F.col("is_commander"))
        leading = held.where("is_commander").select("deck_id", F.col("card_id").alias("commander_id"))
        deck_cards, leaders = edits.advance(inside, leading, batch, cards)
        seated = leaders.where(F.col("commander_id").isNotNull()).select(
            "deck_id", F.col("commander_id").alias("card_id"), F.lit(1).cast("bigint").alias("quantity"), F.lit(True).alias("is_commander")
        )
        return deck_cards.withColumn("is_commander", F.lit(False)).unionByName(seated), None

    return _keep(log, update, base, schema, DRAFT_KEYS, checkpoint)


def read_drafts(spark: SparkSession, base: str, schema: str = DRAFTS) -> DataFrame:
    return stores.read_buckets(spark, base, schema)
