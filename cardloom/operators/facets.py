"""Catalogue and collection browsing: filters, sorts, facet counts and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.constants import FACET_COLORS, SEARCH_LIMIT
from cardloom.operators import running

GRAM = 3
BROADCAST_CHARS = 4_000_000
ROW_CHARS = 40  # what a row costs besides its text


def filter_cards(cards: DataFrame, query: str = "", colors: list[str] | None = None, type_: str = "") -> DataFrame:
    """Name substring (any case), type substring (exact case) and color facet.

    A facet that is blank or empty adds no predicate to the plan.
    """
    needle = query.strip().lower()
    if needle:
        cards = cards.where(F.lower("name").contains(needle))
    if type_:
        cards = cards.where(F.col("type_line").contains(type_))
    if colors:
        cards = cards.where(C.matches_colors("color_identity", colors))
    return cards


def sort_keys(sort: str = "name") -> list[Column]:
    """Ordering for ``name``, ``manaValue`` or ``color``; the pool order breaks ties."""
    lead = {
        "name": [],
        "manaValue": [F.col("mana_value")],
        "color": [C.color_sort_key()],
    }[sort]
    return [*lead, C.name_key(), F.col("ordinal")]


def browse(
    cards: DataFrame, query: str = "", colors: list[str] | None = None, type_: str = "", sort: str = "name"
) -> DataFrame:
    """Filter and sort in one lazy plan."""
    return filter_cards(cards, query, colors, type_).orderBy(*sort_keys(sort))


def browse_ranked(cards: DataFrame, query: str = "", colors: list[str] | None = None, type_: str = "", sort: str = "name") -> DataFrame:
    """What each user would see, with the row's ``place`` in their list; names are in collation order."""
    return running.ranked(filter_cards(cards, query, colors, type_), ["user_id"], [*sort_keys(sort), F.col("id")], "place")


def facet_counts(cards: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many rows each color facet would keep, per ``by`` group.

    One pass: a row lists the facets it belongs to, then counts are combined
    before the exchange.
    """
    by = by or []
    facets = F.array_compact(
        F.array(*[F.when(C.matches_colors("color_identity", [c]), F.lit(c)) for c in FACET_COLORS])
    )
    rows = cards.select(*by, F.explode(facets).alias("facet"))
    return rows.groupBy(*by, "facet").agg(F.count(F.lit(1)).alias("n_cards"))


def search_cards(cards: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """First matches in pool order; a blank query finds nothing."""
    needle = query.strip().lower()
    if not needle:
        return cards.where(F.lit(False))
    hit = F.lower("name").contains(needle) | F.lower("type_line").contains(needle)
    return cards.where(hit).orderBy("ordinal").limit(limit)


def _grams(text: Column, length: int) -> Column:
    """All substrings of a length; a shorter text is its own only one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (length - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(length)))


def search_batch(
    cards: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT, broadcast_chars: int = BROADCAST_CHARS
) -> DataFrame:
    """Search for many queries at once: (query_id, query) -> ranked card ids.

    Each distinct needle is looked up once, through an equi-join on its leading
    gram; the substring test then decides. No query meets a card that shares no
    gram with it. The needles are counted first: up to ``broadcast_chars``
    characters they go to every task and the grams of the catalogue stay where
    they are; beyond, both sides are exchanged by gram.
    """
    wanted = queries.select("query_id", C.folded("query").alias("needle")).where(F.length("needle") > 0)
    needles = wanted.select("needle").distinct().withColumn("gram", F.substring("needle", 1, GRAM))
    size = needles.agg(
        F.sum(F.length("needle") + ROW_CHARS).alias("chars"), F.min(F.length("needle")).alias("shortest")
    ).first()
    if (size["chars"] or 0) <= broadcast_chars:
        needles = F.broadcast(needles)

    name, type_line = F.lower("name"), F.lower("type_line")
    lengths = range(min(size["shortest"] or GRAM, GRAM), GRAM + 1)
    grams = F.concat(*[_grams(text, n) for text in (name, type_line) for n in lengths])
    indexed = cards.select(
        F.col("id").alias("card_id"),
        "ordinal",
        name.alias("_name"),
        type_line.alias("_type"),
        F.explode(F.array_distinct(grams)).alias("gram"),
    )
    hits = indexed.join(needles, "gram").where(
        F.col("_name").contains(F.col("needle")) | F.col("_type").contains(F.col("needle"))
    )
    rank = F.row_number().over(Window.partitionBy("needle").orderBy("ordinal", "card_id"))
    best = hits.select("needle", "card_id", "ordinal").withColumn("rank", rank).where(F.col("rank") <= limit)
    return wanted.join(best, "needle").select("query_id", "rank", "card_id")


def cards_by_ids(cards: DataFrame, ids: DataFrame, id_column: str = "card_id") -> DataFrame:
    """The catalogue rows whose id is listed; repeats and unknown ids do not matter."""
    return cards.join(ids.select(F.col(id_column).alias("id")), "id", "left_semi")
