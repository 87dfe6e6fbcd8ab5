"""Deck lists as text for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_deck_lists(lines: DataFrame, path: str) -> None:
    """Write (deck_id, section, name, line) rows as CSV, decks in one piece.

    Ranges over deck, section and name keep files even when one deck is large; the
    rows of a deck follow each other across files.
    """
    ordered = lines.repartitionByRange("deck_id", "section", "name").sortWithinPartitions("deck_id", "section", "name")
    ordered.select(F.col("deck_id").cast("string"), "section", "line").write.mode("overwrite").option(
        "header", True
    ).csv(path)
