"""From cards to searchable knowledge: metadata, documents, embeddings, records."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom import schemas
from cardloom.functions import columns as C
from cardloom.functions.constants import GAME_STAGES
from cardloom.session import written

# Section headings of a knowledge document, in order (fixed text).
SECTIONS = ["Card", "Summary", "Roles", "Themes", "Strengths", "Weakness", "Oracle Text"]


def ingest_metadata(responses: DataFrame, max_rating: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(card_id, response JSON text) -> (metadata rows, quarantine with reason).

    One parse per text. Missing lists become empty ones. A rating above `max_rating`,
    where one is given, is refused like a negative one.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = responses.withColumn("_r", F.from_json("response", schemas.METADATA_JSON, options))
    rating, stage = F.col("_r.power_rating"), F.col("_r.game_stage")
    beyond = F.lit(False) if max_rating is None else rating > max_rating
    reason = (
        F.when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "malformed")
        .when(F.coalesce(F.size("_r.roles"), F.lit(0)) <= 0, "no roles")
        .when(stage.isNull() | ~stage.isin(GAME_STAGES), "game stage")
        .when(rating.isNull() | (rating < 0) | beyond, "power rating")
    )
    judged = parsed.withColumn("reason", reason)
    lists = ["roles", "themes", "strengths", "weaknesses", "synergy_tags"]
    accepted = judged.where(F.col("reason").isNull()).select(
        "card_id",
        "_r.summary",
        "_r.game_stage",
        "_r.power_rating",
        *[F.coalesce(F.col(f"_r.{name}"), C.no_strings()).alias(name) for name in lists],
    )
    return accepted, judged.where(F.col("reason").isNotNull()).select("card_id", "response", "reason")


def tag_texts(texts: DataFrame, rules: list[tuple[str, str, str]], text: str = "oracle_text") -> DataFrame:
    """Keyword tagging: every rule (pattern, kind, tag) that matches gives a row.

    All rules are tested in one pass over the whole text, without a join.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = [
        F.when(F.rlike(lowered, F.lit(pattern)), F.struct(F.lit(kind).alias("kind"), F.lit(tag).alias("tag")))
        for pattern, kind, tag in rules
    ]
    return texts.select("card_id", F.inline(F.array_distinct(F.array_compact(F.array(*found)))))


def _section(heading: str, body: Column) -> Column:
    return F.when(F.length(body) > 0, F.concat(F.lit(f"{heading}:\n\n"), body))


def build_documents(cards: DataFrame, metadata: DataFrame) -> DataFrame:
    """One text per card; sections without content are left out."""
    facts = cards.select(F.col("id").alias("card_id"), "name", "oracle_text")
    joined = facts.join(metadata, "card_id", "left")

    def lines(name: str) -> Column:
        return F.array_join(F.coalesce(F.col(name), C.no_strings()), "\n")

    bodies = [
        F.col("name"),
        F.col("summary"),
        lines("roles"),
        lines("themes"),
        lines("strengths"),
        lines("weaknesses"),
        F.col("oracle_text"),
    ]
    parts = [_section(heading, body) for heading, body in zip(SECTIONS, bodies)]
    return joined.select("card_id", F.concat_ws("\n\n", *parts).alias("document"))


Encoder = Callable[[list[str]], list[list[float]]]

# Slots of a document vector, and the shape of the stored frequencies: how many documents hold a word of each slot.
FEATURES = 512
FREQUENCIES = "slot int, documents bigint"
# Words whose slots a task remembers (forgetting costs time only), text counted and vectors filled at a time.
SLOT_WORDS = 500_000
COUNTED_BYTES = 1 << 22
FILLED = 2048


def _slot_of(word: str, known: dict[str, int], features: int) -> int:
    if len(known) > SLOT_WORDS:
        known.clear()
    slot = known[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % features
    return slot


def _count_slots(texts: pa.Array, known: dict[str, int], features: int) -> list[pa.ListArray]:
    """Per text the slots of its words, ascending, and how often each occurs."""
    lists = pc.ascii_split_whitespace(pc.cast(texts, pa.large_string()))
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    names, places = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    slot = np.array([-1 if x == "" else known[x] if x in known else _slot_of(x, known, features) for x in names], np.int64)[places]
    held = slot >= 0
    pairs, times = np.unique(owner[held] * features + slot[held], return_counts=True)
    offsets = pa.array(np.searchsorted(pairs, np.arange(len(lists) + 1) * features), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((pairs % features, pa.int32()), (times, pa.int64()))]


def term_lists(documents: DataFrame, features: int = FEATURES) -> DataFrame:
    """(card_id, slots, times): one row for each card, with the slots its words fall into and how often.

    Words are runs between white space, in lower case. A word's slot is the first 32 bits of its md5 modulo `features`.
    NULL texts have none. No word is ever a row; a card with several texts may have several entries for a slot.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.searchsorted(ends, np.arange(0, max(1, ends[-1]), COUNTED_BYTES)))
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)]):
                lists = _count_slots(texts.slice(low, high - low), known, features)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *lists], ["card_id", "slots", "times"])

    id_type = documents.schema["card_id"].dataType.simpleString()
    lists = documents.select("card_id", F.lower("document").alias("document")).mapInArrow(count, f"card_id {id_type}, slots array<int>, times array<bigint>")
    return lists.groupBy("card_id").agg(F.flatten(F.collect_list("slots")).alias("slots"), F.flatten(F.collect_list("times")).alias("times"))


def document_frequencies(documents: DataFrame, features: int = FEATURES, lists: DataFrame | None = None) -> DataFrame:
    """(slot, documents): a row for each slot that occurs, and slot -1 with the number of documents. Such tables add up.

    `lists` are the documents' `term_lists`, where there are some already.
    """
    lists = term_lists(documents, features) if lists is None else lists
    slots = lists.select(F.explode(F.array_distinct("slots")).alias("slot"))
    counted = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("documents"))
    return counted.unionByName(documents.agg(F.lit(-1).alias("slot"), F.count(F.lit(1)).alias("documents")))


def merged_frequencies(*tables: DataFrame) -> DataFrame:
    """The frequencies of all documents behind the tables, those of documents that left with minus signs."""
    return reduce(DataFrame.unionByName, tables).groupBy("slot").agg(F.sum("documents").cast("bigint").alias("documents"))


def embed_documents(
    documents: DataFrame, encoder: Encoder | None = None, features: int = FEATURES, frequencies: DataFrame | None = None, lists: DataFrame | None = None
) -> DataFrame:
    """card_id, document and a unit-length ``embedding``; card ids are unique.

    The default is hashed term frequencies weighted by inverse document frequency, ln((n + 1) / (documents + 1)),
    from `frequencies` or else from the documents themselves. Documents without words, or of words that
    all documents share, have a zero vector. A given ``encoder`` maps a batch of texts to vectors and
    runs in Arrow batches. `lists` are the documents' `term_lists`, where there are some already; else they are written once.
    """
    if encoder is not None:
        id_type = documents.schema["card_id"].dataType.simpleString()

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                vectors = encoder(batch["document"].tolist())
                yield batch.assign(embedding=[[float(x) for x in v] for v in vectors])

        rows = documents.select("card_id", "document")
        return rows.mapInPandas(encode, f"card_id {id_type}, document string, embedding array<float>")

    lists = written(term_lists(documents, features), "terms") if lists is None else lists
    known = document_frequencies(documents, features, lists) if frequencies is None else frequencies
    total = F.max(F.when(F.col("slot") == -1, F.col("documents"))).over(Window.partitionBy(F.lit(0)))  # `features` + 1 rows
    weights = known.select("slot", F.log((total + 1) / (F.col("documents") + 1)).alias("idf"))
    # `features` rows at most are collected. A slot that no document had is as rare as can be.
    rows = {r.slot: r.idf for r in weights.collect()}
    size = known.where("slot = -1").select(F.max("documents")).first()[0]
    idf = np.full(features, math.log(size + 1) if size is not None else np.nan)
    for slot, value in rows.items():
        if 0 <= slot < features and value is not None:
            idf[slot] = value

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), FILLED):
                part = batch.slice(at, FILLED)
                slots, times = part.column(2), part.column(3)
                owner = np.repeat(np.arange(len(part)), pc.list_value_length(slots).to_numpy(zero_copy_only=False))
                slot = slots.flatten().to_numpy()
                # Without any entry bincount gives whole numbers.
                matrix = np.bincount(owner * features + slot, weights=times.flatten().to_numpy() * idf[slot], minlength=len(part) * features).astype(np.float64)
                matrix = matrix.reshape(len(part), features)
                norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                unit = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0).astype(np.float32)
                offsets = pa.array(np.arange(len(part) + 1) * features, pa.int32())
                embedding = pa.ListArray.from_arrays(offsets, pa.array(unit.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), embedding], ["card_id", "document", "embedding"])

    id_type = documents.schema["card_id"].dataType.simpleString()
    listed = documents.select("card_id", "document").join(lists, "card_id", "left")
    filled = [F.coalesce(x, F.array().cast("array<bigint>")).alias(x) for x in ("slots", "times")]
    return listed.select("card_id", "document", *filled).mapInArrow(fill, f"card_id {id_type}, document string, embedding array<float>")


def vector_records(embedded: DataFrame, cards: DataFrame, metadata: DataFrame) -> DataFrame:
    """Vector store rows: document, filterable metadata and embedding per card."""
    facts = cards.select(F.col("id").alias("card_id"), "name", "colors", "mana_value")
    extra = metadata.select("card_id", "roles", "themes")
    meta = F.struct(
        "name",
        "colors",
        F.coalesce("roles", C.no_strings()).alias("roles"),
        F.coalesce("themes", C.no_strings()).alias("themes"),
        "mana_value",
    )
    return (
        embedded.join(facts, "card_id")
        .join(extra, "card_id", "left")
        .select("card_id", "document", meta.alias("meta"), "embedding")
    )
