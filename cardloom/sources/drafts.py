"""Working decks kept as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CARDS = "map<string,int>"
FIELDS = {"deckId": "deck_id", "name": "name", "commanderId": "commander_id"}


def load_drafts(texts: DataFrame, text: str = "draft") -> DataFrame:
    """Replace the text by deck_id, name, commander_id, cards and is_empty.

    The text is read field by field: a field that is missing, or of a type that does not turn into
    the field's, is NULL or an empty map, and the others stay. A quantity may be written as 1.0 or "1"; cards with one that is
    no number drop out. A text that is no JSON object is an empty draft, as is one that names a field twice.
    """
    parsed = texts.withColumn("_d", F.try_parse_json(text))
    kept = [c for c in texts.columns if c != text]
    listed = F.try_variant_get("_d", "$.cards", "map<string,variant>")
    counted = F.transform_values(listed, lambda k, v: F.try_variant_get(v, "$", "int"))
    rows = parsed.select(
        *kept,
        *[F.try_variant_get("_d", f"$.{field}", "string").alias(name) for field, name in FIELDS.items()],
        F.coalesce(F.map_filter(counted, lambda k, v: v.isNotNull()), F.create_map().cast(_CARDS)).alias("cards"),
    )
    return rows.withColumn("is_empty", F.col("commander_id").isNull() & (F.size(F.map_keys("cards")) == 0))


def draft_cards(drafts: DataFrame, key: str) -> DataFrame:
    """Cards of drafts as rows (key, card_id, quantity)."""
    return drafts.select(key, F.explode("cards").alias("card_id", "quantity"))


def open_decks(decks: DataFrame, cards: str = "cards") -> DataFrame:
    """Saved decks as drafts. ``cards`` holds (card_id, quantity) structs; a repeated
    card keeps its last quantity."""
    ids = F.transform(cards, lambda c: c["card_id"])
    last = F.transform(
        F.array_distinct(ids),
        lambda i: F.struct(i, F.element_at(F.filter(cards, lambda c: c["card_id"] == i), -1)["quantity"]),
    )
    return decks.select(
        F.col("id").alias("deck_id"), "name", "commander_id", F.map_from_entries(last).cast(_CARDS).alias("cards")
    )


def drafts_to_json(drafts: DataFrame, out: str = "draft") -> DataFrame:
    """Drafts back to JSON text; open fields are written as null."""
    body = F.struct(
        F.col("deck_id").alias("deckId"), "name", F.col("commander_id").alias("commanderId"), "cards"
    )
    kept = [c for c in drafts.columns if c not in ("deck_id", "name", "commander_id", "cards", "is_empty")]
    return drafts.select(*kept, F.to_json(body, {"ignoreNullFields": "false"}).alias(out))
