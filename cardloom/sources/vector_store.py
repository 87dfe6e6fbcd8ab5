"""Knowledge documents, their word frequencies and vector records, kept from run to run.

A run embeds only documents that are new or changed, weighted by the frequencies of all documents of that
time, which are a small table that adds up: new documents in, old texts out. Records embedded earlier keep
their vectors until `embed_all` works them out again. What needs only a card's own rows is done for some hash buckets
at a time, so that shuffles and tables in between hold a part of the texts, and records are written once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom import schemas
from cardloom.plans import knowledge
from cardloom.session import discard, written
from cardloom.sources import stores

RECORDS = schemas.ddl(schemas.VECTOR)
# The row of the frequencies that says what was counted last.
NOTE = -2
# Text of one wave of buckets; no more than WAVES of them, as each reads all texts given.
WAVE_BYTES = 16 << 20
WAVES = 8


def read_records(spark: SparkSession, base: str) -> DataFrame:
    """card_id, document, meta and embedding of all stored cards."""
    return stores.read_buckets(spark, f"{base}/records", RECORDS)


def read_frequencies(spark: SparkSession, base: str) -> DataFrame:
    held = stores.load_table(spark, f"{base}/frequencies", knowledge.FREQUENCIES)
    return spark.createDataFrame([], knowledge.FREQUENCIES) if held is None else held


def _counted(differing: DataFrame, old: DataFrame, base: str, lists: DataFrame | None = None) -> DataFrame:
    """The stored frequencies with what differs counted in and old texts taken out.

    They are stored before the records, with a note of what was counted: a run that stops in between finds
    the same differences again and does not count them twice. `lists` are the term lists of what enters, where there are some already.
    """
    spark = differing.sparkSession
    held = read_frequencies(spark, base)
    note = differing.agg(F.bit_xor(F.xxhash64("card_id", "change", "document", "_stored")).alias("note")).first().note
    counted = held.where(F.col("slot") == NOTE).select("documents").first()
    if note is None or (counted is not None and counted.documents == note):
        return held.where(F.col("slot") != NOTE)
    entered = differing.where("change <> 'gone'").select("card_id", "document")
    left = knowledge.document_frequencies(old).withColumn("documents", -F.col("documents"))
    whole = knowledge.merged_frequencies(held.where(F.col("slot") != NOTE), knowledge.document_frequencies(entered, lists=lists), left)
    noted = spark.createDataFrame([(NOTE, note)], knowledge.FREQUENCIES)
    stores.save_table(whole.where("documents > 0 OR slot = -1").unionByName(noted), f"{base}/frequencies")
    return read_frequencies(spark, base).where(F.col("slot") != NOTE)


def update_records(
    documents: DataFrame, cards: DataFrame, metadata: DataFrame, base: str, encoder: knowledge.Encoder | None = None, embed_all: bool = False
) -> DataFrame:
    """Bring the stored records up to the given documents -> (card_id, change): new, changed or gone.

    `documents` holds (card_id, document) of every card; `cards` and `metadata` give what records can be filtered by. A
    document whose text is stored already keeps its vector, and only its filterable facts are renewed.
    """
    spark, place = documents.sparkSession, f"{base}/records"
    stores.unstage(spark, place)
    given = written(documents.select(F.col("card_id").cast("string").alias("card_id"), "document"), "documents")
    size = given.agg(F.sum(F.octet_length("document"))).first()[0] or 0
    waves = [[*range(i, stores.BUCKETS, n)] for n in [max(1, min(WAVES, -(-size // WAVE_BYTES)))] for i in range(n)]

    def of(rows: DataFrame, wave: list[int], key: str = "card_id") -> DataFrame:
        return rows if len(waves) == 1 else rows.where(stores.bucket_of([key]).isin(wave))

    def held(wave: list[int]) -> DataFrame:
        return stores.read_buckets(spark, place, RECORDS, wave).select("card_id", "document", "embedding")

    def differences(wave: list[int]) -> DataFrame:
        both = held(wave).select("card_id", F.col("document").alias("_stored")).join(of(given, wave), "card_id", "full")
        same = F.col("_stored").eqNullSafe(F.col("document")) & F.col("_stored").isNotNull()
        change = F.when(F.col("_stored").isNull(), "new").when(F.col("document").isNull(), "gone").otherwise("changed")
        return written(both.where(~same).select("card_id", "document", "_stored", change.alias("change")), "differing")

    parts = [differences(wave) for wave in waves]
    differing = reduce(DataFrame.unionByName, parts)
    fresh = [of(given, wave) if embed_all else part.where("change <> 'gone'").select("card_id", "document") for wave, part in zip(waves, parts)]
    old = differing.where("change <> 'new'").select("card_id", F.col("_stored").alias("document"))
    frequencies, lists = None, [None] * len(waves)
    if encoder is None:
        # The words of what is embedded are counted once.
        lists = [written(knowledge.term_lists(x), "terms") for x in fresh]
        frequencies = _counted(differing, old, base, None if embed_all else reduce(DataFrame.unionByName, lists))
    changes, ids = written(differing.select("card_id", "change"), "changes"), written(given.select("card_id"), "ids")
    if not embed_all:
        discard(given)  # what differs has its texts, all others have those stored
    facts = cards.select(F.col("id").cast("string").alias("id"), "name", "colors", "mana_value")
    extra = metadata.select(F.col("card_id").cast("string").alias("card_id"), "roles", "themes")
    for wave, entering, words, part in zip(waves, fresh, lists, parts):
        made = knowledge.embed_documents(entering, encoder, frequencies=frequencies, lists=words)
        kept = of(ids, wave).join(held(wave), "card_id").join(entering.select("card_id"), "card_id", "left_anti")
        embedded = made.unionByName(kept)
        records = knowledge.vector_records(embedded, of(facts, wave, "id"), of(extra, wave))
        stores.stage(schemas.conform(records, schemas.VECTOR), place, RECORDS, ["card_id"], wave)
        for table in [part, *[words] * (words is not None)]:
            discard(table)
    discard(given)
    discard(ids)
    stores.load_changed(None, place, RECORDS, ["card_id"])
    return changes
