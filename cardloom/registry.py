"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.constants import FACET_COLORS
from cardloom.operators import collection as coll
from cardloom.operators import deck_log, decks, edits, facets, roles, stats, validate
from cardloom.plans import generate as gen
from cardloom.plans import build_loop, knowledge, prompts, retrieve
from cardloom.session import shared_dir, tune, written
from cardloom.sources import card_store, deck_store, stores, vector_store
from cardloom.sources.collection_csv import parse_collection_lines
from cardloom.sources.drafts import draft_cards, load_drafts, open_decks
from cardloom.sources.views import Tables
from cardloom.streaming import states
from cardloom.streaming import tables as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

DECK_LOG_CAP = 12
USER_DECK_CAP = 12
# Ratings end here.
MAX_RATING = 10


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Tables(tune(spark), folder))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# --- catalogue and collections --------------------------------------------


@query
def collection_browse(t: Tables) -> DataFrame:
    owned = coll.library(t.cards(), t.collection())
    found = facets.browse(owned, query=" Bolt ", colors=["W", "U", "C"], type_="Creature", sort="manaValue")
    return found.select("user_id", "id", "name", "mana_value", "quantity")


@query
def collection_by_color(t: Tables) -> DataFrame:
    owned = coll.library(t.cards(), t.collection())
    found = facets.browse(owned, colors=["R", "G"], sort="color")
    return found.select("user_id", "id", "name", C.color_sort_key().alias("color_key"), "quantity")


@query
def catalog_search_topk(t: Tables) -> DataFrame:
    """Every word of the part names and type lines is a query."""
    cards = t.cards()
    words = cards.select(F.explode(F.split(F.concat_ws(" ", "p_name", "type_line"), " ")).alias("query")).distinct()
    found = facets.search_batch(cards, words.select(F.col("query").alias("query_id"), F.upper("query").alias("query")))
    return found.select(F.col("query_id").alias("query"), "rank", "card_id")


@query
def facet_counts(t: Tables) -> DataFrame:
    return facets.facet_counts(coll.library(t.cards(), t.collection()), ["user_id"])


@query
def color_sort_keys(t: Tables) -> DataFrame:
    return t.cards().select("id", C.color_sort_key().alias("color_key"))


@query
def collection_totals(t: Tables) -> DataFrame:
    return coll.totals(t.collection())


@query
def collection_upsert(t: Tables) -> DataFrame:
    """Purchases add copies; unknown cards are rejected and counted per user."""
    merged, _ = coll.add_copies(t.collection(), _adds(t), t.cards())
    return merged


@query
def collection_upsert_rejects(t: Tables) -> DataFrame:
    _, rejected = coll.add_copies(t.collection(), _adds(t), t.cards())
    return rejected.select("seq", "user_id", "card_id")


def _adds(t: Tables, events: DataFrame | None = None) -> DataFrame:
    bought = (t.events() if events is None else events).where(F.col("event_type") == "purchase")
    return bought.select(
        F.col("event_id").alias("seq"),
        "user_id",
        (F.col("k") * 30).alias("card_id"),
        F.floor("value").cast("bigint").alias("quantity"),
    )


@query
def collection_merge(t: Tables) -> DataFrame:
    """Later per-user counts replace collection rows with the same key."""
    newer = _adds(t).groupBy("user_id", "card_id").agg(F.max("quantity").alias("quantity"))
    return coll.replace_or_append(t.collection(), newer, ["user_id", "card_id"])


@query
def collection_seed(t: Tables) -> DataFrame:
    """First collection of every user from a table of names and quantities."""
    quantities = t.cards().select("name", (F.col("mana_value") - 4).cast("int").alias("quantity"))
    return coll.seed(t.cards(), quantities, F.lit("new user"))


# --- decks ----------------------------------------------------------------


@query
def deck_sizes(t: Tables) -> DataFrame:
    return decks.deck_sizes(t.decks(), t.deck_cards())


@query
def decks_per_user_cap(t: Tables) -> DataFrame:
    return decks.decks_per_user(t.decks(), USER_DECK_CAP)


@query
def deck_commanders(t: Tables) -> DataFrame:
    rows = decks.with_commanders(t.decks(), t.cards())
    return rows.select("id", "commander_id", "commander_name", "default_name", "updated_label")


@query
def decks_newest_first(t: Tables) -> DataFrame:
    return decks.newest_first(t.decks()).select("id", "user_id", "updated_at")


@query
def cards_by_ids(t: Tables) -> DataFrame:
    return facets.cards_by_ids(t.cards(), decks.commander_ids(t.decks())).select("id", "name")


@query
def owned_missing_split(t: Tables) -> DataFrame:
    """Deck lines against a twentieth of what their owner bought, so that copies are missing."""
    owned = t.collection().withColumn("quantity", F.floor(F.col("quantity") / 20).cast("bigint"))
    rows = decks.ownership_split(t.deck_cards(), t.decks(), owned)
    return rows.select("deck_id", "card_id", "quantity", "owned_quantity", "missing_quantity", "owned", "proxy")


@query
def addable_cards(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "F", "bolt").when(F.col("o_orderstatus") == "O", " RING").otherwise("basic land")
    asked = t.decks().select(F.col("id").alias("deck_id"), text.alias("query"))
    return decks.addable_results(asked, t.decks(), t.deck_cards(), t.cards())


@query
def deck_export(t: Tables) -> DataFrame:
    return decks.export_lines(t.decks(), t.deck_cards(), t.cards()).select("deck_id", "section", "line")


@query
def pip_demand(t: Tables) -> DataFrame:
    return decks.pip_demand(t.deck_cards(), t.cards())


@query
def deck_upsert_lww(t: Tables) -> DataFrame:
    after, _ = deck_log.apply_ops(_base_decks(t), _deck_ops(t), DECK_LOG_CAP)
    return after.select("id", "user_id", "name", "commander_id", "created_at", "updated_at")


@query
def deck_creates_refused(t: Tables) -> DataFrame:
    _, refused = deck_log.apply_ops(_base_decks(t), _deck_ops(t), DECK_LOG_CAP)
    return refused.select("user_id", "seq")


@query
def deck_cards_after(t: Tables) -> DataFrame:
    """Cards of all decks after the saves and deletes; a save brings its commander in one to four copies."""
    listed = F.array(F.struct(F.col("commander_id").alias("card_id"), (F.col("commander_id") % 4 + 1).cast("int").alias("quantity")))
    ops, _ = deck_log.clean_names(_deck_ops(t).withColumn("cards", F.when(F.col("commander_id").isNotNull(), listed)))
    base_cards = t.deck_cards().select("deck_id", "card_id", F.col("quantity").cast("int").alias("quantity"))
    return deck_log.cards_after(base_cards, _base_decks(t), ops, DECK_LOG_CAP)


def _base_decks(t: Tables) -> DataFrame:
    return t.decks().select("id", "user_id", "name", "commander_id", "created_at", "updated_at")


def _deck_ops(t: Tables, events: DataFrame | None = None) -> DataFrame:
    """Events as deck commands by the owner of the deck they name; sign-ups create."""
    events = (t.events() if events is None else events).where(F.col("event_type") != "view")
    target = F.when(F.col("event_type") != "signup", F.col("user_id") * 10 + F.col("k") % 10)
    named = events.withColumn("_target", target)
    owners = t.raw("orders").select(F.col("o_orderkey").alias("_target"), "o_custkey")
    return named.join(owners, "_target", "left").select(
        F.coalesce("o_custkey", "user_id").alias("user_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("save").alias("op"),
        F.col("_target").cast("string").alias("deck_id"),
        F.concat(F.lit("deck of event "), F.col("event_id").cast("string")).alias("name"),
        F.col("k").alias("commander_id"),
        "ts",
    )


@query
def edit_log_replay(t: Tables) -> DataFrame:
    return edits.replay_cards(t.edit_log(), t.cards())


@query
def edit_log_commanders(t: Tables) -> DataFrame:
    return edits.replay_commanders(t.edit_log())


# --- roles ----------------------------------------------------------------


def _deck_roles(t: Tables) -> DataFrame:
    return roles.assign_roles(t.cards(), t.role_table())


@query
def role_columns(t: Tables) -> DataFrame:
    rows = roles.role_columns(t.deck_cards(), _deck_roles(t))
    return rows.select("deck_id", "primary_role", "role_order", "mana_value", "name", "quantity")


@query
def role_totals(t: Tables) -> DataFrame:
    return roles.role_totals(t.deck_cards(), _deck_roles(t))


@query
def role_histogram(t: Tables) -> DataFrame:
    return roles.role_histogram(t.deck_cards(), _deck_roles(t))


# --- rules and statistics -------------------------------------------------


@query
def deck_validate(t: Tables) -> DataFrame:
    return validate.validate_decks(t.decks(), t.deck_cards(), t.cards())


@query
def identity_violations(t: Tables) -> DataFrame:
    return validate.identity_violations(t.decks(), t.deck_cards(), t.cards())


@query
def card_inclusion(t: Tables) -> DataFrame:
    rows = stats.card_inclusion(t.decks(), t.deck_cards())
    return rows.select("card_id", "n_decks", F.round("share", 9).alias("share"))


@query
def card_cooccurrence(t: Tables) -> DataFrame:
    rows = stats.commander_cooccurrence(t.decks(), t.deck_cards(), t.cards())
    return rows.select(
        "commander_id", "card_id", "n_decks", F.round("share", 9).alias("share"), F.round("synergy", 9).alias("synergy")
    )


# --- deck generation ------------------------------------------------------


def generated(t: Tables) -> DataFrame:
    return gen.generate(t.role_cards(), t.requests(), t.collection())


@query
def identity_union(t: Tables) -> DataFrame:
    rows = gen.resolve_context(t.role_cards(), t.requests(), None)
    return rows.select("request_id", "wanted_mask", F.size("context").alias("n_context"))


@query
def commander_pick(t: Tables) -> DataFrame:
    rows = generated(t)
    return rows.select("request_id", "commander_id", F.array_join("color_identity", "").alias("identity"), "error")


@query
def spell_select(t: Tables) -> DataFrame:
    return generated(t).select("request_id", F.posexplode("spells").alias("pos", "s")).select(
        "request_id", (F.col("pos") + 1).alias("rank"), F.col("s.id").alias("card_id"), F.col("s.role").alias("role")
    )


@query
def nonbasic_select(t: Tables) -> DataFrame:
    return generated(t).select("request_id", F.posexplode("lands").alias("pos", "s")).select(
        "request_id", (F.col("pos") + 1).alias("rank"), F.col("s.id").alias("card_id")
    )


@query
def basic_split(t: Tables) -> DataFrame:
    return generated(t).select("request_id", F.inline("basics")).select("request_id", "color", "quantity")


@query
def deck_generate(t: Tables) -> DataFrame:
    return gen.deck_list(generated(t), t.basics())


@query
def deck_explain(t: Tables) -> DataFrame:
    return generated(t).select("request_id", "lands_needed", "explanation")


@query
def deck_result_split(t: Tables) -> DataFrame:
    rows = generated(t)
    return prompts.split_result(rows, gen.deck_list(rows, t.basics()), t.collection())


@query
def deck_results(t: Tables) -> DataFrame:
    rows = generated(t)
    results = gen.deck_results(rows, gen.deck_list(rows, t.basics()))
    cards = F.array_join(
        F.transform("cards", lambda c: F.concat_ws("x", c["quantity"].cast("string"), c["card_id"].cast("string"))), ","
    )
    return results.select("request_id", "commander_id", cards.alias("cards"), "error")


# --- semi-structured input ------------------------------------------------


@query
def draft_json_defaults(t: Tables) -> DataFrame:
    rows = load_drafts(t.drafts())
    return rows.select("event_id", "deck_id", "name", "commander_id", F.size("cards").alias("n_cards"), "is_empty")


@query
def draft_card_rows(t: Tables) -> DataFrame:
    return draft_cards(load_drafts(t.drafts()), "event_id")


@query
def csv_import_resolve(t: Tables) -> DataFrame:
    accepted, _ = coll.resolve_import(parse_collection_lines(t.csv_lines()), t.cards())
    return accepted


@query
def csv_import_quarantine(t: Tables) -> DataFrame:
    _, rejected = coll.resolve_import(parse_collection_lines(t.csv_lines()), t.cards())
    return rejected.select("event_id", "reason")


@query
def draft_damaged_fields(t: Tables) -> DataFrame:
    """Drafts with a field of another type: quantities as 1.0 or text, names as numbers, cards as a list."""
    return draft_cards(load_drafts(t.damaged_drafts()), "event_id")


@query
def csv_import_counts(t: Tables) -> DataFrame:
    """How many lines of each user's file came in, beside what the whole import counted."""
    done = coll.import_collection(t.collection(), parse_collection_lines(t.csv_lines()), t.cards())
    return done.per_user.withColumns({"all_imported": F.lit(done.imported).cast("bigint"), "all_rejected": F.lit(done.rejected).cast("bigint")})


@query
def csv_import_collection(t: Tables) -> DataFrame:
    return coll.import_collection(t.collection(), parse_collection_lines(t.csv_lines()), t.cards()).collection


# --- visible order -----------------------------------------------------------


@query
def collection_places(t: Tables) -> DataFrame:
    """Every user's whole collection in the order of names."""
    owned = coll.library(t.cards(), t.collection()).select("user_id", "id", "name", "ordinal")
    return facets.browse_ranked(owned).select("user_id", "place", "id")


@query
def collection_places_by_value(t: Tables) -> DataFrame:
    owned = coll.library(t.cards(), t.collection())
    return facets.browse_ranked(owned, colors=["R", "C"], sort="manaValue").select("user_id", "place", "id")


@query
def collection_places_by_color(t: Tables) -> DataFrame:
    owned = coll.library(t.cards(), t.collection())
    return facets.browse_ranked(owned, query="ring", sort="color").select("user_id", "place", "id")


@query
def deck_places(t: Tables) -> DataFrame:
    return decks.newest_ranked(t.decks()).select("user_id", "place", "id")


@query
def role_column_places(t: Tables) -> DataFrame:
    return roles.role_columns_ranked(t.deck_cards(), _deck_roles(t)).select("deck_id", "primary_role", "place", "card_id")


# --- stored decks ------------------------------------------------------------


def _saved_decks(t: Tables) -> DataFrame:
    """The decks after all saves and deletes, with their cards, through the store."""
    listed = F.array(F.struct(F.col("commander_id").alias("card_id"), (F.col("commander_id") % 4 + 1).cast("int").alias("quantity")))
    ops, _ = deck_log.clean_names(_deck_ops(t).withColumn("cards", F.when(F.col("commander_id").isNotNull(), listed)))
    # Decks and the judgement of the commands are worked out once, for the decks and for their cards.
    held = written(_base_decks(t), "decks")
    base_cards = t.deck_cards(held).select("deck_id", "card_id", F.col("quantity").cast("int").alias("quantity"))
    classed = deck_log.classify_once(held, ops, DECK_LOG_CAP)
    after, _ = deck_log.apply_ops(held, ops, DECK_LOG_CAP, classed=classed)
    base = shared_dir(t.spark, "decks")
    deck_store.save_decks(deck_store.with_cards(after, deck_log.cards_after(base_cards, held, ops, DECK_LOG_CAP, classed=classed)), base)
    return deck_store.load_decks(t.spark, base)


@query
def deck_store_lists(t: Tables) -> DataFrame:
    rows = _saved_decks(t)
    total = F.aggregate("cards", F.lit(0).cast("bigint"), lambda a, c: a + c["quantity"])
    return rows.select("id", "name", F.size("cards").alias("n_entries"), total.alias("copies"))


@query
def deck_store_cards(t: Tables) -> DataFrame:
    return deck_store.deck_rows(_saved_decks(t))


@query
def deck_store_opened(t: Tables) -> DataFrame:
    """Stored decks opened as drafts, then changed by the edit log of the deck of that number."""
    opened = open_decks(deck_store.with_cards(t.decks(), t.deck_cards()))
    numbered = F.col("deck_id").cast("bigint").alias("deck_id")
    first = F.lit(-3).cast("bigint")
    log = (
        opened.select(numbered, first.alias("seq"), F.lit("open").alias("op"), F.lit(None).cast("bigint").alias("card_id"), F.lit(None).cast("bigint").alias("quantity"))
        .unionByName(opened.select(numbered, (first + 1).alias("seq"), F.lit("seat").alias("op"), F.col("commander_id").cast("bigint").alias("card_id"), F.lit(None).cast("bigint").alias("quantity")).where("card_id IS NOT NULL"))
        .unionByName(opened.select(numbered, F.explode("cards").alias("_c", "_q")).select("deck_id", (first + 2).alias("seq"), F.lit("put").alias("op"), F.col("_c").cast("bigint").alias("card_id"), F.col("_q").cast("bigint").alias("quantity")))
    )
    return edits.replay_cards(log.unionByName(t.edit_log()), t.cards())


@query
def collection_stored(t: Tables) -> DataFrame:
    """A collection that is not stored yet is seeded, then replaced by what came after."""
    base, schema = shared_dir(t.spark, "collection"), "user_id bigint, card_id bigint, quantity bigint"
    held = stores.load_or_seed(t.spark, base, schema, t.collection())
    stores.save_table(coll.add_copies(held, _adds(t), t.cards())[0], base)
    return stores.load_or_seed(t.spark, base, schema, t.collection().limit(0))


# --- stored cards -----------------------------------------------------------


def _bulk_file(t: Tables) -> str:
    """The catalogue as a bulk file of JSON lines, with lines that are no cards."""
    path = shared_dir(t.spark, "bulk")
    raw = F.struct(
        F.col("id").cast("string").alias("id"), "oracle_id", "name", "mana_cost", F.col("mana_value").alias("cmc"), F.lit("").alias("oracle_text"),
        "colors", "color_identity", "type_line", "keywords",
    )
    text = F.to_json(raw)
    broken = F.when(F.col("type_line") == "Basic Land", F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    t.cards().select(broken.alias("value")).write.text(path)
    return path


@query
def card_import(t: Tables) -> DataFrame:
    """A bulk file into the store and back."""
    base = shared_dir(t.spark, "cards")
    card_store.import_cards(t.spark, _bulk_file(t), base)
    rows = card_store.read_cards_stored(t.spark, base)
    return rows.select("id", "oracle_id", "name", "mana_cost", "mana_value", F.array_join("color_identity", "").alias("identity"), "type_line", "ci_mask")


@query
def card_import_quarantine(t: Tables) -> DataFrame:
    _, refused = card_store.import_cards(t.spark, _bulk_file(t), shared_dir(t.spark, "cards"))
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def card_reload_changes(t: Tables) -> DataFrame:
    """What a second load finds: instants are new, artifacts renamed, suppliers' cards gone."""
    base = shared_dir(t.spark, "cards")
    cards = t.cards().withColumn("id", F.col("id").cast("string"))
    before = cards.where("type_line <> 'Instant'").withColumn("name", F.when(F.col("type_line") == "Artifact", F.concat(F.lit("old "), "name")).otherwise(F.col("name")))
    gone = t.raw("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ordinal"))
    card_store.load_cards(before.unionByName(gone, allowMissingColumns=True), base)
    return card_store.load_cards(cards, base)


@query
def card_role_rows(t: Tables) -> DataFrame:
    """Metadata as child rows, for the cards that are stored: of labelled documents, those with a part of their number."""
    base = shared_dir(t.spark, "cards")
    card_store.load_cards(t.cards().withColumn("id", F.col("id").cast("string")), base)
    card_store.load_metadata(t.text_metadata().withColumn("card_id", F.col("card_id").cast("string")), base)
    return card_store.read_metadata(t.spark, base).select("card_id", "summary", F.posexplode("roles").alias("position", "role"), F.array_join("themes", ",").alias("themes"))


@query
def metadata_without_cards(t: Tables) -> DataFrame:
    base = shared_dir(t.spark, "cards")
    card_store.load_cards(t.cards().withColumn("id", F.col("id").cast("string")), base)
    _, refused = card_store.load_metadata(t.text_metadata().withColumn("card_id", F.col("card_id").cast("string")), base)
    return refused.select("card_id")


# --- knowledge ------------------------------------------------------------

TAG_RULES = [
    ("[0-9]{3}", "theme", "Numbers"),
    ("@", "theme", "Contact"),
    ("licen[cs]e", "role", "License"),
    ("the ", "role", "English"),
    ("http", "theme", "Links"),
]


@query
def metadata_ingest(t: Tables) -> DataFrame:
    accepted, _ = knowledge.ingest_metadata(t.metadata_responses())
    roles_text = F.array_join("roles", ",").alias("roles")
    return accepted.select("card_id", "summary", "game_stage", F.round("power_rating", 6).alias("power_rating"), roles_text)


@query
def metadata_quarantine(t: Tables) -> DataFrame:
    """All answers that break a rule, those rated above the scale among them."""
    _, rejected = knowledge.ingest_metadata(t.metadata_responses(), MAX_RATING)
    return rejected.select("card_id", "reason")


@query
def metadata_tags(t: Tables) -> DataFrame:
    texts = t.text_cards().select(F.col("id").alias("card_id"), "oracle_text")
    return knowledge.tag_texts(texts, TAG_RULES)


@query
def knowledge_docs(t: Tables) -> DataFrame:
    return knowledge.build_documents(t.text_cards(), t.text_metadata())


def _weights(rows: DataFrame, *columns: str) -> DataFrame:
    used = F.size(F.filter("embedding", lambda x: x != 0)).alias("n_used")
    heaviest = F.array_max("embedding").cast("double")
    place = F.array_position("embedding", F.array_max("embedding")).cast("int")
    return rows.select("card_id", *columns, used, F.round(heaviest, 4).alias("heaviest"), F.when(heaviest > 0, place).alias("place"))


@query
def tfidf_embed(t: Tables) -> DataFrame:
    return _weights(knowledge.embed_documents(knowledge.build_documents(t.text_cards(), t.text_metadata()))).drop("place")


def letter_counts(texts: list[str]) -> list[list[float]]:
    """An encoder of one's own: how often each of four letters occurs."""
    return [[float(text.count(letter)) for letter in "aeio"] for text in texts]


@query
def encoder_embed(t: Tables) -> DataFrame:
    """Documents through a user's encoder, in Arrow batches."""
    rows = knowledge.embed_documents(knowledge.build_documents(t.text_cards(), t.text_metadata()), letter_counts)
    return rows.select("card_id", *[F.get("embedding", F.lit(i)).cast("bigint").alias(f"n_{c}") for i, c in enumerate("aeio")])


@query
def word_frequencies(t: Tables) -> DataFrame:
    """Documents by source counted apart, then added up."""
    docs = knowledge.build_documents(t.text_cards(), t.text_metadata()).join(t.raw("documents").select(F.col("doc_id").alias("card_id"), "lang"), "card_id")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return knowledge.merged_frequencies(*[knowledge.document_frequencies(docs.where(part)) for part in (english, ~english)])


def _records(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents of two runs into one store: first without the labels' metadata, then whole -> (changes, records)."""
    base = shared_dir(t.spark, "records")
    cards = t.text_cards().withColumns({"colors": F.array("lang"), "mana_value": F.col("n_chars").cast("double")})
    bare = t.text_metadata().limit(0)
    vector_store.update_records(knowledge.build_documents(cards, bare), cards, bare, base)
    changes = vector_store.update_records(knowledge.build_documents(cards, t.text_metadata()), cards, t.text_metadata(), base)
    return changes, vector_store.read_records(t.spark, base)


@query
def vector_records(t: Tables) -> DataFrame:
    """Records of all documents, those with metadata embedded again by the second run."""
    _, records = _records(t)
    return records.select(
        "card_id", "meta.name", F.array_join("meta.colors", "").alias("colors"), F.array_join("meta.roles", ",").alias("roles"),
        F.array_join("meta.themes", ",").alias("themes"), "meta.mana_value", F.size("embedding").alias("dims"), F.length("document").alias("n_chars"),
    )


@query
def vector_record_changes(t: Tables) -> DataFrame:
    return _records(t)[0]


# --- retrieval ------------------------------------------------------------


def _context(t: Tables) -> DataFrame:
    rows = gen.resolve_context(t.role_cards(), t.requests(), None)
    return rows.select("request_id", F.explode("context.id").alias("card_id"))


def _asked(t: Tables) -> DataFrame:
    return retrieve.retrieval_queries(_context(t), t.tagged_cards(), t.vectors())


@query
def retrieval_query(t: Tables) -> DataFrame:
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return _asked(t).select(
        "request_id",
        "mask",
        *[F.array_join(name, ",").alias(name) for name in ("roles", "themes", "mechanics")],
        F.round(norm, 6).alias("vector_norm"),
    )


@query
def vector_topk(t: Tables) -> DataFrame:
    return retrieve.similar_cards(_asked(t), t.vectors())


@query
def vector_topk_filtered(t: Tables) -> DataFrame:
    """Only records of some colors and roles with a low mana value take part."""
    facts = t.tagged_cards().select(F.col("id").alias("card_id"), F.struct("name", "colors", "roles", "themes", "mana_value").alias("meta"))
    wanted = retrieve.record_filter(colors=["W", "U", "G"], roles=["Utility", "Ramp", "Oddity"], max_mana=6)
    return retrieve.similar_cards(_asked(t), t.vectors().join(facts, "card_id"), 20, wanted)


@query
def vector_topk_themed(t: Tables) -> DataFrame:
    """Only creatures with bolt in their name take part."""
    facts = t.tagged_cards().select(F.col("id").alias("card_id"), F.struct("name", "colors", "roles", "themes", "mana_value").alias("meta"))
    wanted = retrieve.record_filter(name="Bolt", themes=["Creature", "Legendary Creature"])
    return retrieve.similar_cards(_asked(t), t.vectors().join(facts, "card_id"), 5, wanted)


@query
def synergistic_cards(t: Tables) -> DataFrame:
    return retrieve.synergistic_cards(_asked(t), t.tagged_cards()).select("request_id", "rank", "card_id", "score")


@query
def supporting_cards(t: Tables) -> DataFrame:
    return retrieve.supporting_cards(_asked(t), t.tagged_cards())


def _candidates(t: Tables) -> DataFrame:
    return retrieve.candidates(_asked(t), t.tagged_cards(), t.vectors())


@query
def candidate_mix(t: Tables) -> DataFrame:
    return _candidates(t).select("request_id", "rank", "card_id", "score", "kinds")


@query
def prompt_table(t: Tables) -> DataFrame:
    return prompts.build_prompts(t.requests(), _context(t), _candidates(t), t.cards(), retrieve.offerable(t.tagged_cards(), t.vectors()))


@query
def response_check(t: Tables) -> DataFrame:
    return prompts.judge_responses(t.responses(), t.cards())


@query
def retry_table(t: Tables) -> DataFrame:
    asked = t.events().select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("Build deck "), F.col("event_id").cast("string")).alias("prompt")
    )
    return prompts.retry_table(prompts.judge_responses(t.responses(), t.cards()), asked)


def mending_builder(asked: pd.DataFrame) -> list[str]:
    """Stands in for a model: reads the prompt alone, makes mistakes by the request's number, and mends what it is told."""
    answers = []
    for number, attempt, prompt in zip(asked["request_id"], asked["attempt"], asked["prompt"]):
        def names(heading: str, prompt: str = prompt) -> list[str]:
            block = prompt.split(f"{heading}:\n", 1)[1].split("\n\n", 1)[0]
            return [line[2:].split(" | ")[0] for line in block.split("\n")]

        told = prompt.split("The previous deck broke these rules:", 1)[-1] if attempt > 1 else ""
        *leaders, basic = names("Candidate cards")
        first, second = names("Selected cards")
        cards = []
        if "outside" not in told:
            cards = [(first, 1), (second, 2 if number % 2 and "exceed" not in told else 1)]
        if number % 5 == 0 and "unknown" not in told:
            cards.append(("no such card", 1))
        missing = 1 if number % 3 == 0 and "expected" not in told else 0
        cards.append((basic, 99 - missing - sum(n for _, n in cards)))
        leader = leaders[min(told.count("legendary"), len(leaders) - 1)]
        text = json.dumps({"commander": leader, "cards": [{"name": name, "quantity": n} for name, n in cards]})
        answers.append(text[:-7] if attempt == 1 and number % 7 == 0 else text)
    return answers


@query
def deck_build_loop(t: Tables) -> DataFrame:
    """Every request is asked again with the errors of its answer until it is valid or out of rounds."""
    rows = build_loop.build_until_valid(t.loop_prompts(), t.cards(), build_loop.in_batches(mending_builder), max_rounds=4)
    return rows.select("request_id", "attempts", "status", "errors")


@query
def deck_build_rounds(t: Tables) -> DataFrame:
    """What went wrong in each round of the loop."""
    rounds = build_loop.build_rounds(t.loop_prompts(), t.cards(), build_loop.in_batches(mending_builder), max_rounds=4)
    return reduce(DataFrame.unionByName, rounds).groupBy("attempt", "errors").agg(F.count(F.lit(1)).alias("n_requests"))


@query
def upgrade_suggestions(t: Tables) -> DataFrame:
    deck = gen.deck_list(generated(t), t.basics())
    return retrieve.upgrade_suggestions(_candidates(t), deck, t.requests(), t.collection())


# --- streams --------------------------------------------------------------


@query
def stream_collection(t: Tables) -> DataFrame:
    """The add commands as a stream that keeps a collection table."""
    base = shared_dir(t.spark, "collection")
    adds = _adds(t, t.event_stream()).where(F.col("card_id").isNotNull())
    streams.keep_collection(adds, t.cards(), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return streams.read_collection(t.spark, f"{base}/table")


@query
def stream_edits(t: Tables) -> DataFrame:
    """The edit log as a stream that keeps draft decks."""
    base = shared_dir(t.spark, "edits")
    log = t.edit_log(t.event_stream())
    streams.keep_drafts(log, t.cards(), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    drafts = streams.read_drafts(t.spark, f"{base}/table")
    return drafts.where(~F.col("is_commander")).select("deck_id", "card_id", "quantity")


@query
def stream_decks(t: Tables) -> DataFrame:
    """Deck commands without known decks as a stream: all saves create, up to the cap."""
    base = shared_dir(t.spark, "decks")
    ops = _deck_ops(t, t.event_stream())
    streams.keep_decks(ops, f"{base}/table", f"{base}/checkpoint", DECK_LOG_CAP).awaitTermination()
    return streams.read_decks(t.spark, f"{base}/table").drop("cards")


@query
def stream_deck_cards(t: Tables) -> DataFrame:
    """The cards those decks were saved with: the commander in one to four copies."""
    base = shared_dir(t.spark, "decks")
    listed = F.array(F.struct(F.col("commander_id").alias("card_id"), (F.col("commander_id") % 4 + 1).cast("int").alias("quantity")))
    ops = _deck_ops(t, t.event_stream()).withColumn("cards", listed)
    streams.keep_decks(ops, f"{base}/table", f"{base}/checkpoint", DECK_LOG_CAP).awaitTermination()
    return deck_store.deck_rows(streams.read_decks(t.spark, f"{base}/table"))


@query
def stream_drafts_folded(t: Tables) -> DataFrame:
    """The edit log as a stream, folded in the state of each deck."""
    base = shared_dir(t.spark, "folds")
    states.fold_drafts(t.edit_log(t.event_stream()), t.cards(), f"{base}/changes", f"{base}/checkpoint").awaitTermination()
    rows = states.folded_drafts(t.spark, f"{base}/changes")
    return rows.where(~F.col("is_commander")).select("deck_id", "card_id", "quantity")


@query
def stream_draft_commanders(t: Tables) -> DataFrame:
    """Who leads the drafts that the same stream has folded."""
    base = shared_dir(t.spark, "folds")
    states.fold_drafts(t.edit_log(t.event_stream()), t.cards(), f"{base}/changes", f"{base}/checkpoint").awaitTermination()
    rows = states.folded_drafts(t.spark, f"{base}/changes")
    return rows.where("is_commander").select("deck_id", F.col("card_id").alias("commander_id"))


@query
def stream_counted_adds(t: Tables) -> DataFrame:
    """The add commands as a stream that delivers each of them twice, on top of the collection."""
    base = shared_dir(t.spark, "counts")
    twice = t.event_stream().unionByName(t.event_stream()).where("event_type = 'purchase'")
    adds = twice.select("event_id", "ts", "user_id", (F.col("k") * 30).alias("card_id"), F.floor("value").cast("bigint").alias("quantity"))
    states.count_adds(adds, t.cards(), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return states.with_base(t.collection(), streams.read_collection(t.spark, f"{base}/table"))
