"""Rule-based assembly of whole decks for many build-around requests at once.

The catalogue enters the job once. A card matters to a request only through its
identity mask (32 values), its kind and its pool order, so the catalogue shrinks
to the first few cards per mask before any request meets it. Each request then
stays one row: its spells, lands and basics are cut from short arrays.

How short is exact, not a sample: a deck takes at most 63 spells, of which the
m build-around or owned ones come first. Filling the other 63 - m places skips at
most those m cards and the commander, so the first 64 of the pool always suffice.
Lands take at most 99.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.constants import (
    ALL_COLORS_MASK,
    BASIC_NAMES,
    COUNTED_ROLES,
    DECK_SIZE_WITHOUT_COMMANDER,
    DEFAULT_IDENTITY,
    MAX_SPELLS,
    ONLY_OWNED,
    PREFER_OWNED,
    STRONGEST,
)

HEADS = {"spell": MAX_SPELLS + 1, "land": DECK_SIZE_WITHOUT_COMMANDER, "leader": 1}
LONGEST_HEAD = max(HEADS.values())
NO_LEADER = "no eligible commander"


# --- pools ----------------------------------------------------------------


def pool_rows(cards: DataFrame) -> DataFrame:
    """Cards as pool entries; a legendary creature is an entry of two kinds."""
    kinds = F.array_compact(
        F.array(
            F.when(~C.is_land(), F.lit("spell")),
            F.when(C.is_nonbasic_land(), F.lit("land")),
            F.when(C.can_lead(), F.lit("leader")),
        )
    )
    return cards.select(
        F.col("id").alias("card_id"),
        "ci_mask",
        F.explode(kinds).alias("kind"),
        F.struct("ordinal", "id", F.col("primary_role").alias("role")).alias("entry"),
        F.when(C.can_lead(), F.struct("id", "name", "color_identity", "ci_mask")).alias("leader"),
    )


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The leading entries of every (keys, kind) in pool order."""
    rank = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("entry.ordinal", "entry.id"))
    limit = F.lit(0)
    for kind, count in HEADS.items():
        limit = F.when(F.col("kind") == kind, F.lit(count)).otherwise(limit)
    return (
        rows.withColumn("_rank", rank)
        .where((F.col("_rank") <= LONGEST_HEAD) & (F.col("_rank") <= limit))
        .drop("_rank")
    )


def pool_heads(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, mask, kind) the entries that can still reach a deck."""
    return _first(rows, [*keys, "ci_mask"])


def _as_arrays(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Pool entries as one short array per kind: at most 64 spells and 99 lands."""
    def ordered(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("entry"))))

    return rows.groupBy(*keys).agg(
        ordered("spell").alias(f"{prefix}_spells"), ordered("land").alias(f"{prefix}_lands")
    )


def _masks_covering() -> Column:
    """All identity masks a card's mask fits into."""
    masks = F.sequence(F.lit(0), F.lit(ALL_COLORS_MASK))
    return F.filter(masks, lambda m: F.col("ci_mask").bitwiseAND(F.bitwise_not(m)) == 0)


def catalogue_pools(cards: DataFrame) -> DataFrame:
    """32 rows: per leader mask the leading spells and lands of the catalogue."""
    heads = pool_heads(pool_rows(cards).where(F.col("kind") != "leader"), [])
    spread = heads.withColumn("leader_mask", F.explode(_masks_covering()))
    return _as_arrays(_first(spread, ["leader_mask"]), ["leader_mask"], "pool")


def owned_cards(cards: DataFrame, collection: DataFrame) -> DataFrame:
    """One row per user: the own cards that can still reach a deck, in pool order.

    The array is bounded by the heads: 32 masks times 64 spells, 99 lands and one
    leader, however large the collection is.
    """
    owned = collection.where(F.col("quantity") > 0).select("user_id", "card_id")
    heads = pool_heads(owned.join(pool_rows(cards), "card_id"), ["user_id"])
    return heads.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("entry", "kind", "ci_mask", "leader"))).alias("own"))


def _own_entries(kind: str) -> Column:
    """Own entries of a kind within the leader's identity."""
    fitting = F.filter("own", lambda e: (e["kind"] == kind) & C.mask_within(e["ci_mask"], F.col("leader_mask")))
    return F.slice(F.transform(fitting, lambda e: e["entry"]), 1, HEADS[kind])


# --- leaders --------------------------------------------------------------


def _fit(ci_mask: Column, wanted_mask: Column) -> list[Column]:
    """How well an identity serves the wanted colors: covering, overlap, width."""
    return [
        (wanted_mask.bitwiseAND(F.bitwise_not(ci_mask)) == 0).cast("int"),
        F.bit_count(ci_mask.bitwiseAND(wanted_mask)),
        F.bit_count(ci_mask),
    ]


def leader_table(cards: DataFrame) -> DataFrame:
    """32 rows: the best leader of the catalogue for every wanted mask."""
    best = (
        pool_rows(cards)
        .where(F.col("kind") == "leader")
        .groupBy("ci_mask")
        .agg(F.min(F.struct("entry.ordinal", "leader")).alias("_first"))
    )
    scored = best.withColumn("wanted_mask", F.explode(F.sequence(F.lit(0), F.lit(ALL_COLORS_MASK)))).select(
        "wanted_mask",
        F.struct(*_fit(F.col("ci_mask"), F.col("wanted_mask")), -F.col("_first.ordinal")).alias("_score"),
        F.col("_first.leader").alias("leader"),
    )
    return scored.groupBy("wanted_mask").agg(F.max_by("leader", "_score").alias("pool_leader"))


def _best_owned(wanted_mask: Column) -> Column:
    def scored(e: Column) -> Column:
        fit = [c.alias(n) for n, c in zip(["covers", "overlap", "width"], _fit(e["ci_mask"], wanted_mask))]
        return F.struct(*fit, (-e["entry"]["ordinal"]).alias("order"), e["leader"].alias("leader"))

    legends = F.filter("own", lambda e: e["kind"] == "leader")
    return F.array_max(F.transform(legends, scored))["leader"]


# --- requests -------------------------------------------------------------


def resolve_context(cards: DataFrame, requests: DataFrame, collection: DataFrame | None) -> DataFrame:
    """One row per request with its resolved build-around cards in pool order.

    Unknown names drop out. The array is no longer than the request's own list of
    names, given unique card names.
    """
    named = requests.select(
        "request_id",
        "user_id",
        "power_level",
        "collection_preference",
        F.explode_outer(F.array_distinct("build_around_card_names")).alias("_wanted"),
    )
    info = cards.select(
        F.col("name").alias("_wanted"),
        F.col("id").alias("card_id"),
        F.struct(
            "ordinal", "id", F.col("primary_role").alias("role"), "name", "ci_mask", C.is_land().alias("land")
        ).alias("card"),
    )
    rows = named.join(info, "_wanted", "left")
    owned = F.lit(False)
    if collection is not None:
        have = collection.where(F.col("quantity") > 0).select("user_id", "card_id", F.lit(True).alias("_have"))
        rows = rows.join(have, ["user_id", "card_id"], "left")
        owned = F.col("_have").isNotNull()
    return (
        rows.withColumn("card", F.when(F.col("card_id").isNotNull(), F.col("card").withField("owned", owned)))
        .groupBy("request_id", "user_id", "power_level", "collection_preference")
        .agg(
            F.coalesce(F.bit_or("card.ci_mask"), F.lit(0)).alias("_context_mask"),
            F.sort_array(F.collect_list("card")).alias("context"),
        )
        .withColumn(
            "wanted_mask",
            F.when(F.col("_context_mask") == 0, F.lit(C.mask_of(DEFAULT_IDENTITY))).otherwise(F.col("_context_mask")),
        )
        .drop("_context_mask")
    )


def pick_leaders(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """Add ``leader``; NULL when no card may lead.

    Owned-only requests choose among own legends (``own``, where present). With
    owned cards preferred, an own legend wins a tie on the color criteria.
    """
    # 32 rows at most, one per wanted mask.
    picked = requests.join(F.broadcast(leader_table(cards)), "wanted_mask", "left")
    if "own" not in requests.columns:
        return picked.withColumnRenamed("pool_leader", "leader")
    picked = picked.withColumn("own_leader", _best_owned(F.col("wanted_mask")))
    own_mask, pool_mask = F.col("own_leader.ci_mask"), F.col("pool_leader.ci_mask")
    ties = F.struct(*_fit(own_mask, F.col("wanted_mask"))) == F.struct(*_fit(pool_mask, F.col("wanted_mask")))
    choice = (
        F.when(F.col("collection_preference") == ONLY_OWNED, F.col("own_leader"))
        .when((F.col("collection_preference") == PREFER_OWNED) & F.coalesce(ties, F.lit(False)), F.col("own_leader"))
        .otherwise(F.col("pool_leader"))
    )
    return picked.withColumn("leader", choice).drop("pool_leader", "own_leader")


def generate(cards: DataFrame, requests: DataFrame, collection: DataFrame | None = None) -> DataFrame:
    """One row per request: leader, spells, lands, basic slots and explanation.

    ``cards`` carries ``ordinal``, ``ci_mask`` and ``primary_role``. Without a
    collection every request is served from the whole catalogue.
    """
    entries = entries_type(cards)
    none = F.array().cast(entries)
    if collection is None:
        asked = resolve_context(cards, requests.withColumn("collection_preference", F.lit(STRONGEST)), None)
    else:
        asked = resolve_context(cards, requests, collection).join(owned_cards(cards, collection), "user_id", "left")
    led = pick_leaders(asked, cards).withColumn("leader_mask", F.col("leader.ci_mask"))
    # 32 rows at most, one per leader mask.
    rows = led.join(F.broadcast(catalogue_pools(cards)), "leader_mask", "left")
    pool_spells, pool_lands = F.coalesce("pool_spells", none), F.coalesce("pool_lands", none)
    own_spells = own_lands = none
    if collection is not None:
        uses_own = F.col("collection_preference").isin(PREFER_OWNED, ONLY_OWNED)
        own_spells = F.when(uses_own, F.coalesce(_own_entries("spell"), none)).otherwise(none)
        own_lands = F.when(uses_own, F.coalesce(_own_entries("land"), none)).otherwise(none)
        only = F.col("collection_preference") == ONLY_OWNED
        pool_spells = F.when(only, none).otherwise(pool_spells)
        pool_lands = F.when(only, none).otherwise(pool_lands)

    fitting = F.filter(
        "context",
        lambda c: ~c["land"] & C.mask_within(c["ci_mask"], F.col("leader_mask")) & (c["id"] != F.col("leader.id")),
    )
    first = fitting
    if collection is not None:
        own = F.filter("_fitting", lambda c: c["owned"])
        rows = rows.withColumn("_fitting", fitting)
        first = (
            F.when(F.col("collection_preference") == ONLY_OWNED, own)
            .when(F.col("collection_preference") == PREFER_OWNED, F.concat(own, F.filter("_fitting", lambda c: ~c["owned"])))
            .otherwise(F.col("_fitting"))
        )
    identity = F.col("leader.color_identity")
    rows = (
        rows.withColumn("_own_spells", own_spells)
        .withColumn("_own_lands", own_lands)
        .withColumn("_pool_spells", pool_spells)
        .withColumn("_pool_lands", pool_lands)
        .withColumn("_first", F.transform(first, lambda c: F.struct(c["ordinal"], c["id"], c["role"])).cast(entries))
        .withColumn("_deck", F.when(F.col("leader").isNotNull(), _assemble(identity)))
    )
    made = rows.select(
        "request_id",
        "user_id",
        "power_level",
        "collection_preference",
        F.col("leader.id").alias("commander_id"),
        identity.alias("color_identity"),
        F.col("leader_mask").alias("commander_mask"),
        "leader",
        "context",
        F.coalesce("_deck.spells", none).alias("spells"),
        F.coalesce("_deck.lands", none).alias("lands"),
        "_deck.basics",
        "_deck.lands_needed",
    )
    led_by = F.col("leader").isNotNull()
    return (
        made.withColumn("explanation", F.when(led_by, explanation()))
        .withColumn("error", F.when(~led_by, F.lit(NO_LEADER)))
        .drop("leader", "context")
    )


def _ids(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["id"])


def _without(entries: Column, ids: Column) -> Column:
    return C.let(ids, lambda taken: F.filter(entries, lambda e: ~F.array_contains(taken, e["id"])))


def _assemble(identity: Column) -> Column:
    """Struct of spells, lands_needed, lands and basics of one request."""
    first, own, pool = F.col("_first"), F.col("_own_spells"), F.col("_pool_spells")
    leader_id = F.array("leader.id")
    ranked = F.concat(
        first,
        _without(own, F.concat(_ids(first), leader_id)),
        _without(pool, F.concat(_ids(first), leader_id, _ids(own))),
    )
    lands = F.concat("_own_lands", _without(F.col("_pool_lands"), _ids(F.col("_own_lands"))))
    colors = F.when(F.size(identity) > 0, identity).otherwise(F.array(*[F.lit(c) for c in DEFAULT_IDENTITY]))

    def with_lands(spells: Column) -> Column:
        needed = F.lit(DECK_SIZE_WITHOUT_COMMANDER) - F.size(spells)
        room = F.greatest(F.lit(0), needed - F.size(identity))
        return F.struct(
            spells.alias("spells"), needed.alias("lands_needed"), F.slice(lands, F.lit(1), room).alias("lands")
        )

    def with_basics(deck: Column) -> Column:
        left = deck["lands_needed"] - F.size(deck["lands"])
        return F.struct(
            deck["spells"].alias("spells"),
            deck["lands_needed"].alias("lands_needed"),
            deck["lands"].alias("lands"),
            C.let(F.struct(left.alias("left"), colors.alias("colors")), _split_basics).alias("basics"),
        )

    return C.let(C.let(F.slice(ranked, 1, MAX_SPELLS), with_lands), with_basics)


def _split_basics(slots: Column) -> Column:
    """Even split over the colors; the remainder goes to the first ones."""
    left, colors = slots["left"], slots["colors"]
    each = F.floor(left / F.size(colors)).cast("int")
    spare = left % F.size(colors)
    counted = F.transform(
        colors, lambda color, i: F.struct(color.alias("color"), (each + (i < spare).cast("int")).alias("quantity"))
    )
    return F.filter(counted, lambda s: s["quantity"] > 0)


def entries_type(cards: DataFrame) -> str:
    """Type of an array of pool entries."""
    kind = {c: cards.schema[c].dataType.simpleString() for c in ("ordinal", "id")}
    return f"array<struct<ordinal:{kind['ordinal']},id:{kind['id']},role:string>>"


def _count_role(role: str) -> Column:
    return F.size(F.filter("spells", lambda spell: spell["role"] == role))


def explanation() -> Column:
    """Why the deck looks the way it does. The wording is fixed text."""
    names = F.array_join(F.transform("context", lambda c: c["name"]), ", ")
    lead_in = F.when(F.size("context") > 0, F.concat(F.lit("Built around "), names, F.lit(". "))).otherwise(
        F.lit("No build-around cards were provided, so a +1/+1 counters shell was chosen. ")
    )
    letters = F.array_join("leader.color_identity", "")
    counts = {role: _count_role(role).cast("string") for role in COUNTED_ROLES}
    return F.concat(
        lead_in,
        F.col("leader.name"),
        F.lit(" leads the deck: its color identity ("),
        F.when(letters == "", F.lit("colorless")).otherwise(letters),
        F.lit(") covers the strategy and its abilities reinforce the theme. The list runs "),
        counts["Ramp"],
        F.lit(" ramp, "),
        counts["Card Draw"],
        F.lit(" draw, "),
        counts["Removal"],
        F.lit(" removal, and "),
        counts["Protection"],
        F.lit(" protection pieces alongside the synergy package, with "),
        F.col("lands_needed").cast("string"),
        F.lit(" lands to keep the curve consistent."),
    )


def named_basics(cards: DataFrame) -> DataFrame:
    """(color, card_id) of the basic lands by name: at most five rows."""
    color = F.lit(None).cast("string")
    for symbol, name in BASIC_NAMES.items():
        color = F.when(F.col("name") == name, F.lit(symbol)).otherwise(color)
    found = cards.where(F.col("name").isin(list(BASIC_NAMES.values()))).withColumn("color", color)
    return found.groupBy("color").agg(F.min_by("id", "ordinal").alias("card_id"))


def deck_list(generated: DataFrame, basics: DataFrame) -> DataFrame:
    """Deck rows (request_id, section, rank, card_id, quantity) of generated decks.

    A basic slot whose land is missing from the catalogue is lost.
    """
    id_type = generated.schema["commander_id"].dataType

    def listed(section: str, entries: str) -> Column:
        return F.transform(
            entries,
            lambda e, i: F.struct(
                F.lit(section).alias("section"),
                (i + 1).alias("rank"),
                e["id"].alias("card_id"),
                F.lit(None).cast("string").alias("color"),
                F.lit(1).alias("quantity"),
            ),
        )

    slots = F.transform(
        "basics",
        lambda s, i: F.struct(
            F.lit("basic").alias("section"),
            (i + 1).alias("rank"),
            F.lit(None).cast(id_type).alias("card_id"),
            s["color"].alias("color"),
            s["quantity"].alias("quantity"),
        ),
    )
    rows = generated.where(F.col("error").isNull()).select(
        "request_id", F.inline(F.concat(listed("spell", "spells"), listed("land", "lands"), slots))
    )
    # One row per color symbol: five at most.
    by_color = F.broadcast(basics.select("color", F.col("card_id").alias("_basic")))
    return (
        rows.join(by_color, "color", "left")
        .withColumn("card_id", F.coalesce("card_id", "_basic"))
        .where(F.col("card_id").isNotNull())
        .select("request_id", "section", "rank", "card_id", "quantity")
    )


def deck_results(generated: DataFrame, listed: DataFrame) -> DataFrame:
    """One result per request: commander, cards with their copies, explanation.

    Copies of basic lands are kept. A deck has at most 99 entries, so the list per
    request is short. Requests without a deck keep their error.
    """
    section = F.array_position(F.array(*[F.lit(s) for s in ("spell", "land", "basic")]), F.col("section"))
    entry = F.struct(section.alias("part"), "rank", F.struct("card_id", "quantity").alias("card"))
    cards = listed.groupBy("request_id").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["card"]).alias("cards")
    )
    none = F.array().cast(cards.schema["cards"].dataType)
    return generated.join(cards, "request_id", "left").select(
        "request_id", "user_id", "commander_id", F.coalesce("cards", none).alias("cards"), "explanation", "error"
    )
