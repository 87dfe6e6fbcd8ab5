"""Card-shaped views over the driver's star-schema tables.

The given data holds no cards, so parts stand in for cards, order lines for
owned copies, orders for decks, customers for requests and events for logs.
Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.constants import COLORS, ONLY_OWNED, PREFER_OWNED, STRONGEST
from cardloom.operators.facets import cards_by_ids
from cardloom.plans.prompts import build_prompts
from cardloom.session import written

# Noun of the part name -> roles; nouns not listed have no role entry.
NOUN_ROLES = {
    "bolt": ["Removal"],
    "ring": ["Ramp"],
    "gear": ["Card Draw", "Ramp"],
    "plate": ["Protection"],
    "rod": ["Oddity", "Tutor"],
}
TYPE_LINES = {
    "ECONOMY": "Basic Land",
    "PROMO": "Land",
    "LARGE": "Legendary Creature",
    "MEDIUM": "Creature",
    "SMALL": "Instant",
    "STANDARD": "Artifact",
}


class Tables:
    """The views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A given table; its footer is read once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def cards(self) -> DataFrame:
        brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        mask = ((brand * 7 + F.col("p_size")) % 32).cast("int")
        type_line = F.lit(None).cast("string")
        for code, text in TYPE_LINES.items():
            type_line = F.when(F.col("p_type") == code, F.lit(text)).otherwise(type_line)
        value = (F.col("p_size") % 10).cast("int")
        base = self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_partkey").alias("ordinal"),
            F.concat(F.lit("o"), F.col("p_partkey").cast("string")).alias("oracle_id"),
            F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
            "p_name",
            value.cast("double").alias("mana_value"),
            type_line.alias("type_line"),
            mask.alias("ci_mask"),
        )
        pips = F.when(
            F.bit_count("ci_mask") == 2, F.concat(F.lit("{"), F.array_join("color_identity", "/"), F.lit("}"))
        ).otherwise(F.array_join(F.transform("color_identity", lambda c: F.concat(F.lit("{"), c, F.lit("}"))), ""))
        cost = F.concat(F.lit("{"), F.col("mana_value").cast("int").cast("string"), F.lit("}"), pips)
        return (
            base.withColumn("color_identity", C.mask_colors("ci_mask"))
            .withColumn("colors", F.col("color_identity"))
            .withColumn("keywords", F.split("p_name", " "))
            .withColumn("mana_cost", F.when(C.is_land(), F.lit("")).otherwise(cost))
        )

    def role_table(self) -> DataFrame:
        """(name, roles) for parts whose noun has an entry."""
        noun = F.split("p_name", " ")[1]
        roles = F.lit(None).cast("array<string>")
        for word, listed in NOUN_ROLES.items():
            roles = F.when(noun == word, F.array(*[F.lit(r) for r in listed])).otherwise(roles)
        named = self.raw("part").select(
            F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), roles.alias("roles")
        )
        return named.where(F.col("roles").isNotNull())

    def role_cards(self) -> DataFrame:
        """Cards with roles. The role table covers the catalogue itself, so the
        join by name is replaced by the rule that made the table."""
        noun = F.split("p_name", " ")[1]
        roles = F.when(C.is_land(), F.array(F.lit("Land"))).otherwise(F.array(F.lit("Utility")))
        for word, listed in NOUN_ROLES.items():
            roles = F.when(noun == word, F.array(*[F.lit(r) for r in listed])).otherwise(roles)
        return self.cards().withColumn("roles", roles).withColumn("primary_role", F.get("roles", F.lit(0)))

    def basics(self) -> DataFrame:
        """(color, card_id): the first basic land of each single-color identity."""
        color = F.lit(None).cast("string")
        for i, symbol in enumerate(COLORS):
            color = F.when(F.col("ci_mask") == (1 << i), F.lit(symbol)).otherwise(color)
        mono = self.cards().where(C.is_basic_land()).withColumn("color", color).where(F.col("color").isNotNull())
        return mono.groupBy("color").agg(F.min("id").alias("card_id"))

    def collection(self) -> DataFrame:
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return (
            lines.join(orders, "l_orderkey")
            .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("card_id"))
            .agg(F.sum("l_quantity").cast("bigint").alias("quantity"))
        )

    def deck_lines(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").alias("card_id"))
            .agg(F.sum("l_quantity").cast("bigint").alias("quantity"))
        )

    def decks(self) -> DataFrame:
        legends = self.raw("part").where(F.col("p_type") == "LARGE").select(F.col("p_partkey").alias("l_partkey"))
        leaders = (
            self.raw("lineitem")
            .select("l_orderkey", "l_partkey")
            .join(legends, "l_partkey")
            .groupBy(F.col("l_orderkey").alias("id"))
            .agg(F.min("l_partkey").alias("commander_id"))
        )
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderpriority").alias("name"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
            "o_orderstatus",
        )
        return orders.join(leaders, "id", "left")

    def deck_cards(self, decks: DataFrame | None = None) -> DataFrame:
        """Deck lines without the commander; `decks` are the decks where they are at hand already."""
        leaders = (self.decks() if decks is None else decks).select(F.col("id").alias("deck_id"), "commander_id")
        return (
            self.deck_lines()
            .join(leaders, "deck_id")
            .where(F.col("commander_id").isNull() | (F.col("commander_id") != F.col("card_id")))
            .select("deck_id", "card_id", "quantity")
        )

    def requests(self) -> DataFrame:
        """One request per customer, built around all distinct parts of their order of lowest key."""
        first = self.raw("orders").groupBy(F.col("o_custkey").alias("request_id")).agg(F.min("o_orderkey").alias("l_orderkey"))
        names = self.raw("part").select(
            F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name")
        )
        built_around = (
            self.raw("lineitem").select("l_orderkey", "l_partkey").join(first, "l_orderkey").join(names, "l_partkey")
            .groupBy("request_id")
            .agg(F.array_sort(F.collect_set("name")).alias("build_around_card_names"))  # the lines of one order
        )
        preference = (
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit(STRONGEST))
            .when(F.col("c_mktsegment").isin("AUTOMOBILE", "FURNITURE"), F.lit(PREFER_OWNED))
            .otherwise(F.lit(ONLY_OWNED))
        )
        power = F.when(F.col("c_acctbal") < 0, "Casual").when(F.col("c_acctbal") < 5000, "Focused").otherwise("Competitive")
        customers = self.raw("customer").select(
            F.col("c_custkey").alias("request_id"),
            F.col("c_custkey").alias("user_id"),
            power.alias("power_level"),
            preference.alias("collection_preference"),
        )
        return customers.join(built_around, "request_id", "left")

    def edit_log(self, events: DataFrame | None = None) -> DataFrame:
        """Deck edits: the event user is the deck, the JSON number the card."""
        op = (
            F.when(F.col("event_type").isin("click", "purchase"), "add")
            .when(F.col("event_type") == "error", "remove")
            .when(F.col("event_type") == "signup", "set_commander")
            .when(F.col("value") > 60, "clear")
            .when(F.col("value") < 2, "remove_commander")
        )
        events = (self.events() if events is None else events).select(
            F.col("user_id").alias("deck_id"),
            F.col("event_id").alias("seq"),
            op.alias("op"),
            F.col("k").alias("card_id"),
            F.lit(None).cast("bigint").alias("quantity"),
        )
        return events.where(F.col("op").isNotNull())

    def events(self) -> DataFrame:
        """Events with the number in their JSON text."""
        return self.raw("events").withColumn("k", self._number())

    def event_stream(self) -> DataFrame:
        """The same events as a stream over the files of their table."""
        reader = self.spark.readStream.schema(self.raw("events").schema).option("pathGlobFilter", "events*.parquet")
        return reader.parquet(self.folder).withColumn("k", self._number())

    @staticmethod
    def _number():
        return F.get_json_object("props", "$.k").cast("bigint")

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("card_id"), "embedding")

    def tagged_cards(self) -> DataFrame:
        """Cards with roles, themes and tags: the words of the part name are the tags."""
        return self.role_cards().withColumn("themes", F.array("type_line")).withColumn("tags", F.col("keywords"))

    def text_cards(self) -> DataFrame:
        """Documents as cards with long rules text."""
        return self.raw("documents").select(
            F.col("doc_id").alias("id"),
            F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("name"),
            F.col("text").alias("oracle_text"),
            "lang",
            "source",
            "n_chars",
        )

    def text_metadata(self) -> DataFrame:
        """Labels as metadata of those documents; unlabelled ones have none."""
        labelled = self.raw("documents").select("doc_id", "lang", "source").join(self.raw("labels"), "doc_id")
        return labelled.select(
            F.col("doc_id").alias("card_id"),
            F.concat(F.lit("Text from "), "source").alias("summary"),
            F.array(F.lit("Text"), F.col("lang")).alias("roles"),
            F.when(F.col("quality") == 1, F.array(F.lit("Good"))).otherwise(C.no_strings()).alias("themes"),
            C.no_strings().alias("strengths"),
            F.when(F.col("toxic") == 1, F.array(F.lit("Toxic"))).otherwise(C.no_strings()).alias("weaknesses"),
        )

    def metadata_responses(self) -> DataFrame:
        """JSON answers about documents, some of them cut off or out of range."""
        stage = F.element_at(F.array(*[F.lit(s) for s in ("Early", "Mid", "Late", "Endless")]), (F.col("doc_id") % 4 + 1).cast("int"))
        body = F.to_json(
            F.struct(
                F.concat(F.lit("Text from "), "source").alias("summary"),
                F.array(F.col("source"), F.col("lang")).alias("roles"),
                stage.alias("game_stage"),
                (F.col("n_chars") / 500.0).alias("power_rating"),
            )
        )
        docs = self.raw("documents").join(self.raw("labels"), "doc_id", "left")
        cut = F.when(F.col("toxic") == 1, F.substring(body, F.lit(1), F.length(body) - 9)).otherwise(body)
        return docs.select(F.col("doc_id").alias("card_id"), cut.alias("response"))

    def drafts(self) -> DataFrame:
        """Draft decks as JSON text, one per event, with gaps and damage by event type."""
        cards = F.create_map(F.col("k").cast("string"), F.lit(1), (F.col("k") + 1).cast("string"), F.lit(2))
        named = F.to_json(
            F.struct(
                F.col("user_id").cast("string").alias("deckId"),
                F.concat(F.lit("Draft "), F.col("k").cast("string")).alias("name"),
                F.col("k").cast("string").alias("commanderId"),
                cards.alias("cards"),
            )
        )
        older = F.to_json(F.struct(F.col("k").cast("string").alias("commanderId"), cards.alias("cards")))
        text = (
            F.when(F.col("event_type").isin("click", "purchase"), named)
            .when(F.col("event_type") == "signup", older)
            .when(F.col("event_type") == "view", F.lit("{}"))
            .otherwise(F.substring(named, F.lit(1), F.length(named) - 1))
        )
        return self.events().select("event_id", text.alias("draft"))

    def damaged_drafts(self) -> DataFrame:
        """Drafts with one field of another type, by event type; the other fields are good."""
        k = F.col("k").cast("string")
        kind = F.col("event_type")
        quantity = (
            F.when(kind == "click", F.lit("2.0")).when(kind == "purchase", F.lit('"3"')).when(kind == "signup", F.lit('"many"')).otherwise(F.lit("4"))
        )
        cards = F.when(kind == "error", F.lit("[1]")).otherwise(F.concat(F.lit('{"'), k, F.lit('": '), quantity, F.lit(', "x": 1}')))
        text = F.concat(F.lit('{"deckId": '), k, F.lit(', "name": ["n"], "commanderId": null, "cards": '), cards, F.lit("}"))
        return self.events().select("event_id", text.alias("draft"))

    def csv_lines(self) -> DataFrame:
        """Collection lines, one per event: unknown names, bad numbers and zeroes occur."""
        names = self.raw("part").select(F.col("p_partkey").alias("_part"), "p_name")
        copies = F.when(F.col("event_type") == "error", F.lit("many")).otherwise(F.floor("value").cast("string"))
        part = F.col("k") * 30
        return (
            self.events()
            .join(names, F.col("_part") == part, "left")
            .select(
                "event_id",
                "user_id",
                F.concat(
                    F.lit('" '), F.coalesce("p_name", F.lit("lost")), F.lit(" "), part.cast("string"), F.lit('",'), copies
                ).alias("line"),
            )
        )

    def responses(self) -> DataFrame:
        """Deck answers as JSON text, one per event, right and wrong ones."""
        names = self.cards().select("id", "name")
        basic = self.raw("part").where(F.col("p_type") == "ECONOMY").agg(F.min("p_partkey").alias("id")).join(names, "id")
        basic_name = basic.select("name").scalar()
        a = names.select(F.col("id").alias("k"), F.col("name").alias("_a"))
        b = names.select((F.col("id") - 1).alias("k"), F.col("name").alias("_b"))
        c = names.select((F.col("id") - 2).alias("k"), F.col("name").alias("_c"))
        odd = (F.col("event_id") % 2).cast("int")
        one = F.lit(1)

        def listed(name, quantity):
            return F.struct(name.alias("name"), quantity.cast("int").alias("quantity"))

        lost = F.when(F.col("event_type") == "view", listed(F.lit("no such card"), one))
        basics = listed(basic_name, 97 - odd - (F.col("event_type") == "view").cast("int"))
        cards = F.array_compact(F.array(listed(F.col("_b"), one), listed(F.col("_c"), one + odd), basics, lost))
        body = F.to_json(F.struct(F.col("_a").alias("commander"), cards.alias("cards")))
        text = F.when(F.col("event_type") == "error", F.substring(body, F.lit(1), F.length(body) - 7)).otherwise(body)
        return (
            self.events().join(a, "k").join(b, "k").join(c, "k")
            .select(F.col("event_id").alias("request_id"), (F.col("k") % 4).cast("int").alias("attempt"), text.alias("response"))
        )

    def loop_prompts(self) -> DataFrame:
        """One prompt per event: two cards to build around and six that may lead, next to its number, and a basic land."""
        asked = self.events().select(F.col("event_id").alias("request_id"), "k")
        open_choice = F.lit(None).cast("string")
        requests = asked.select("request_id", open_choice.alias("power_level"), open_choice.alias("collection_preference"))
        around = F.array(F.col("k") + 6, F.col("k") + 7)
        context = asked.select("request_id", F.explode(around).alias("card_id"))
        basic = self.cards().where(C.is_basic_land()).agg(F.min_by("id", F.struct(F.col("ci_mask") != 0, F.col("id"))).alias("id"))
        near = F.array(*[F.col("k") + i for i in range(6)], basic.scalar())
        offered = asked.select("request_id", F.posexplode(near).alias("rank", "card_id"))
        # The cards that are listed, as a table of known size: a small one goes to every task.
        listed = asked.select("k").distinct().select(F.explode(F.concat(around, near)).alias("card_id"))
        return build_prompts(requests, context, offered, written(cards_by_ids(self.cards(), listed), "listed"))
