"""Streams whose state Spark keeps itself: drafts folded per deck, collections counted per card."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cardloom.functions import columns as C
from cardloom.sources import stores
from cardloom.streaming.tables import COLLECTION, COLLECTION_KEYS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "deck_id bigint, seq bigint, card_id bigint, quantity bigint, is_commander boolean"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; those started elsewhere keep their own setting."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class DraftFold(StatefulProcessor):
    """One deck's draft, its commander and copies by card, as one value. Emits what a batch changed.

    Every question to the state is a trip to the JVM: a batch reads its deck by one and writes it by one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.draft = handle.getValueState("draft", "leader bigint, cards array<bigint>, copies array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        # A batch of one deck's commands, as narrow rows; a trigger's limit bounds them.
        log = sorted(((row.seq, row.op, row.card_id, row.quantity, row.stacks) for row in rows), key=itemgetter(0))
        leader, cards, copies = self.draft.get() or (None, [], [])
        before, known = leader, dict(zip(cards, copies))
        now = dict(known)
        for _, op, card, quantity, stacks in log:
            if op in ("clear", "open"):
                now.clear()
                leader = None
            elif op == "remove_commander":
                leader = None
            elif op == "seat":
                leader = card
            elif op == "add":
                now[card] = now.get(card, 0) + 1 if stacks else max(now.get(card, 0), 1)
            elif op == "remove":
                now[card] = max(now.get(card, 0) - 1, 0)
            elif op == "put":
                now[card] = max(quantity or 0, 0)
            elif op == "set_commander":
                now[card] = 0
                if leader is not None and leader != card:
                    now[leader] = max(now.get(leader, 0), 1)
                leader = card

        now = {card: n for card, n in now.items() if n}
        out = [(card, now.get(card, 0), False) for card in known.keys() | now.keys() if known.get(card, 0) != now.get(card, 0)]
        if leader != before:
            out += [(c, n, True) for c, n in ((before, 0), (leader, 1)) if c is not None]
        if out:
            if now or leader is not None:
                self.draft.update((leader, list(now), list(now.values())))
            else:
                self.draft.clear()
        for card, count, leads in out:
            yield Row(deck_id=key[0], seq=log[-1][0], card_id=card, quantity=count, is_commander=leads)

    def close(self) -> None:
        pass


def fold_drafts(log: DataFrame, cards: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Fold an edit stream deck by deck; what changes is appended to the table of changes at `base`, each batch once.

    The log is (deck_id, seq, op, card_id, quantity); a deck's later batches hold later numbers. Commands on a card
    that name none, and rows without a deck, are passed over. Basic lands of `cards` stack.
    """
    basics = cards.where(C.is_basic_land()).select(F.col("id").alias("card_id"), F.lit(True).alias("_basic"))
    whole = F.col("op").isin("clear", "open", "remove_commander")
    rows = log.where(F.col("deck_id").isNotNull() & (F.col("card_id").isNotNull() | whole)).join(basics, "card_id", "left").select(
        "deck_id", "seq", "op", "card_id", F.col("quantity").cast("bigint").alias("quantity"), F.col("_basic").isNotNull().alias("stacks")
    )
    with rocksdb(log.sparkSession):
        changes = rows.groupBy("deck_id").transformWithState(DraftFold(), CHANGES, "append", "none")
        return (
            changes.writeStream.outputMode("append").format("parquet").option("path", base)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def folded_drafts(spark: SparkSession, base: str) -> DataFrame:
    """deck_id, card_id, quantity, is_commander: the last change of each card, from the table of changes."""
    changes = spark.read.schema(CHANGES).parquet(base)
    last = changes.groupBy("deck_id", "card_id", "is_commander").agg(F.max_by("quantity", "seq").alias("quantity"))
    return last.where("quantity > 0").select("deck_id", "card_id", "quantity", "is_commander")


def count_adds(adds: DataFrame, cards: DataFrame, base: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Copies added per (user, card) by a stream of (event_id, ts, user_id, card_id, quantity), as totals at `base`.

    An event delivered again within `delay` of its time counts once. An event that comes later than `delay`
    behind the newest one is late: Spark drops it, and `late_rows` says how many there were. Adds of unknown cards do not
    count. Totals are Spark's own streaming state; a batch hands over the totals it changed.
    """
    ids = cards.select(F.col("id").alias("card_id"))
    once = adds.withColumn("ts", F.col("ts").cast("timestamp")).join(ids, "card_id", "left_semi").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    totals = once.groupBy(*COLLECTION_KEYS).agg(F.sum(C.clamp_copies("quantity")).cast("bigint").alias("quantity"))

    def keep(batch: DataFrame, number: int) -> None:
        name = batch.sparkSession.read.json(f"{checkpoint}/metadata").first().id
        stores.update_buckets(batch, _replace, base, COLLECTION, COLLECTION_KEYS, name, number)

    with rocksdb(adds.sparkSession):
        return (
            totals.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def _replace(held: DataFrame, changed: DataFrame) -> DataFrame:
    return held.join(changed.select(*COLLECTION_KEYS), COLLECTION_KEYS, "left_anti").unionByName(changed.select(*held.columns))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped as late, as far as its recent progress tells."""
    return sum(int(state["numRowsDroppedByWatermark"]) for p in query.recentProgress for state in p["stateOperators"])


def with_base(base: DataFrame, totals: DataFrame) -> DataFrame:
    """A collection as it was before a stream, with what the stream has added."""
    both = base.select("user_id", "card_id", "quantity").unionByName(totals.select("user_id", "card_id", "quantity"))
    return both.groupBy("user_id", "card_id").agg(F.sum("quantity").cast("bigint").alias("quantity"))
