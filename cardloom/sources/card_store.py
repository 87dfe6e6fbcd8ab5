"""Cards and their metadata as normalised tables that are loaded again and again.

A load compares content hashes with what is stored and rewrites only the buckets in which something
differs, so a second load of the same file writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom import schemas
from cardloom.functions import columns as C
from cardloom.sources import stores
from cardloom.sources.cards_json import read_cards

CARD_ROW = T.StructType([*schemas.CARD, T.StructField("ordinal", T.LongType())])
CARDS = schemas.ddl(CARD_ROW)
FACTS, ROLES, THEMES = (schemas.ddl(x) for x in (schemas.METADATA_FACTS, schemas.CARD_ROLE, schemas.CARD_THEME))


def load_cards(cards: DataFrame, base: str) -> DataFrame:
    """Make the store hold these cards -> (id, change) of those that are new, changed or gone.

    A card that stays keeps its place in the pool; new ones follow after the last, in the order they come in.
    """
    spark = cards.sparkSession
    held = read_cards_stored(spark, base).select("id", F.col("ordinal").alias("_held"))
    last = F.coalesce(held.agg(F.max("_held")).scalar(), F.lit(-1))
    placed = cards.withColumn("_place", F.col("ordinal")).drop("ordinal").join(held, "id", "left")
    place = F.coalesce("_held", last + 1 + F.col("_place")).cast("bigint")
    rows = schemas.conform(placed.withColumn("ordinal", place), CARD_ROW)
    return stores.load_changed(rows, f"{base}/cards", CARDS, ["id"])


def import_cards(spark: SparkSession, path: str, base: str) -> tuple[DataFrame, DataFrame]:
    """Load a bulk file -> (changed cards, refused lines)."""
    cards, refused = read_cards(spark, path)
    return load_cards(cards, base), refused


def read_cards_stored(spark: SparkSession, base: str) -> DataFrame:
    """The stored cards in the declared shape, with their pool order and identity mask."""
    return stores.read_buckets(spark, f"{base}/cards", CARDS).withColumn("ci_mask", C.identity_mask("color_identity"))


def load_metadata(metadata: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Make the store hold this metadata -> (card_id and change, by table; refused rows).

    Roles and themes are child tables, one row for each entry in its order. A row whose card is not
    stored is refused, as is one without a card id; of several rows of one card one stays.
    """
    spark = metadata.sparkSession
    rows = schemas.conform(metadata, schemas.CARD_METADATA)
    ids = read_cards_stored(spark, base).select(F.col("id").alias("card_id"))
    known = rows.join(ids, "card_id", "left_semi").dropDuplicates(["card_id"])
    refused = rows.join(ids, "card_id", "left_anti")

    def entries(column: str, name: str) -> DataFrame:
        return known.select("card_id", F.posexplode(column).alias("position", name))

    changes = [
        stores.load_changed(frame, f"{base}/{table}", ddl, keys).select("card_id", F.lit(table).alias("table"), "change")
        for table, ddl, keys, frame in (
            ("metadata", FACTS, ["card_id"], known.drop("roles", "themes")),
            ("card_roles", ROLES, ["card_id", "position"], entries("roles", "role")),
            ("card_themes", THEMES, ["card_id", "position"], entries("themes", "theme")),
        )
    ]
    return changes[0].unionByName(changes[1]).unionByName(changes[2]), refused


def read_metadata(spark: SparkSession, base: str) -> DataFrame:
    """Stored metadata with its lists put together again; cards without entries have empty lists."""
    facts = stores.read_buckets(spark, f"{base}/metadata", FACTS)

    def listed(table: str, ddl: str, name: str, out: str) -> DataFrame:
        # A list is one card's own, as long as it was in one input row.
        ordered = F.array_sort(F.collect_list(F.struct("position", name)))
        rows = stores.read_buckets(spark, f"{base}/{table}", ddl)
        return rows.groupBy("card_id").agg(F.transform(ordered, lambda x: x[name]).alias(out))

    whole = facts.join(listed("card_roles", ROLES, "role", "roles"), "card_id", "left").join(listed("card_themes", THEMES, "theme", "themes"), "card_id", "left")
    filled = [F.coalesce(name, C.no_strings()).alias(name) for name in ("roles", "themes")]
    return whole.withColumns({"roles": filled[0], "themes": filled[1]}).select(*[f.name for f in schemas.CARD_METADATA])
