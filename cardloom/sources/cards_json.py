"""Bulk card files: raw card JSON to card rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions import columns as C
from cardloom.functions.constants import COLORS

_STRS = T.ArrayType(T.StringType())
RAW_CARD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("oracle_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("mana_cost", T.StringType()),
        T.StructField("cmc", T.DoubleType()),
        T.StructField("oracle_text", T.StringType()),
        T.StructField("colors", _STRS),
        T.StructField("color_identity", _STRS),
        T.StructField("type_line", T.StringType()),
        T.StructField("keywords", _STRS),
        T.StructField("image_uris", T.StructType([T.StructField("normal", T.StringType())])),
        T.StructField("legalities", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def read_cards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """-> (cards, quarantined lines with a reason).

    Takes JSON lines, and also one JSON array written with a card per line: the
    array brackets and the comma after a card are dropped, so a large file still
    splits into many tasks. The pool order is the order of the lines; write the
    result once and read it back rather than deriving it again.
    """
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())
    body = F.regexp_replace(C.trim_all("value"), r"^\[|,$|\]$", "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = (
        lines.withColumn("_body", body)
        .where(F.length("_body") > 0)
        .withColumn("_c", F.from_json("_body", RAW_CARD, options))
    )
    odd_color = F.size(F.array_except(F.coalesce("_c.color_identity", C.no_strings()), F.array(*[F.lit(c) for c in COLORS])))
    reason = (
        F.when(F.col("_c").isNull() | F.col("_c._corrupt").isNotNull(), "malformed")
        .when(F.col("_c.id").isNull() | F.col("_c.name").isNull(), "no id or name")
        .when(odd_color > 0, "unknown color")
    )
    judged = parsed.withColumn("reason", reason)
    none = C.no_strings()
    cards = judged.where(F.col("reason").isNull()).select(
        "_c.id",
        "_c.oracle_id",
        "_c.name",
        F.coalesce("_c.mana_cost", F.lit("")).alias("mana_cost"),
        F.coalesce("_c.cmc", F.lit(0.0)).alias("mana_value"),
        F.coalesce("_c.oracle_text", F.lit("")).alias("oracle_text"),
        F.coalesce("_c.colors", none).alias("colors"),
        F.coalesce("_c.color_identity", none).alias("color_identity"),
        F.coalesce("_c.type_line", F.lit("")).alias("type_line"),
        F.coalesce("_c.keywords", none).alias("keywords"),
        F.col("_c.image_uris.normal").alias("image_url"),
        F.col("_c.legalities").alias("legalities"),
        "ordinal",
    )
    # The first line of an id stays; the choice is made by order, not by chance.
    first = cards.groupBy("id").agg(F.min_by(F.struct(*[c for c in cards.columns if c != "id"]), "ordinal").alias("_r"))
    unique = first.select("id", "_r.*").withColumn("ci_mask", C.identity_mask("color_identity"))
    return unique, judged.where(F.col("reason").isNotNull()).select("value", "reason")
