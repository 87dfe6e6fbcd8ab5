"""Batch save and delete of decks with a per-user cap.

An op row is (user_id, seq, op, deck_id, name, commander_id, ts) with a unique
``seq`` and op ``save`` or ``delete``. Ids of new decks become known to users
after the batch, so ops refer to decks of the base table only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.constants import DECK_NAME_LENGTH, MAX_DECKS
from cardloom.operators import running
from cardloom.session import written

COLUMNS = ["id", "user_id", "name", "commander_id", "created_at", "updated_at"]


def new_deck_id(user: Column | str, seq: Column | str) -> Column:
    """Repeatable id of a created deck."""
    return F.concat(F.lit("deck-"), F.sha2(F.concat_ws(":", user, seq), 256))


def classify(base: DataFrame, ops: DataFrame) -> DataFrame:
    """Add ``effect``: update, create, delete or none (a delete without target)."""
    deletes = (
        ops.where(F.col("op") == "delete").groupBy("user_id", "deck_id").agg(F.min("seq").alias("_deleted_at"))
    )
    targets = base.select("user_id", F.col("id").cast("string").alias("deck_id"), F.lit(True).alias("_exists"))
    joined = ops.join(targets, ["user_id", "deck_id"], "left").join(deletes, ["user_id", "deck_id"], "left")
    alive = F.col("_exists").isNotNull() & (F.col("_deleted_at").isNull() | (F.col("seq") < F.col("_deleted_at")))
    effect = (
        F.when((F.col("op") == "save") & alive, "update")
        .when(F.col("op") == "save", "create")
        .when(F.col("_exists").isNotNull() & (F.col("seq") == F.col("_deleted_at")), "delete")
        .otherwise("none")
    )
    return joined.withColumn("effect", effect).drop("_exists", "_deleted_at")


def accept_creates(
    base: DataFrame, classified: DataFrame, cap: int = MAX_DECKS, chunk_rows: int = running.CHUNK_ROWS
) -> DataFrame:
    """Creates with ``accepted``: a create is refused while its user is at the cap.

    The deck count of a user moves up with creates and down with deletes and is
    held at the cap. A create is refused exactly when the free-running count would
    reach a new high above the cap, so running sums and maxima decide it. A user
    who starts above the cap first has to delete the excess, and those deletes
    leave no room.
    """
    start = base.groupBy("user_id").agg((F.count(F.lit(1)) - cap).alias("_over"))
    moves = classified.where(F.col("effect").isin("create", "delete")).join(start, "user_id", "left")
    moves = moves.withColumn("_over", F.coalesce("_over", F.lit(-cap).cast("bigint")))
    counted = {
        f"_{effect}s": (F.col("effect") == effect).cast("bigint") for effect in ("create", "delete")
    }
    moves = running.with_running(moves, ["user_id"], "seq", sums=counted, chunk_rows=chunk_rows)
    excess, room = F.greatest("_over", F.lit(0)), F.least("_over", F.lit(0))
    level = room + F.col("_creates") - F.greatest(F.col("_deletes") - excess, F.lit(0))
    moves = moves.withColumn("_level", level)
    moves = running.with_running(
        moves, ["user_id"], "seq", maxes={"_high": F.col("_level")}, chunk_rows=chunk_rows, inclusive=False
    )
    refused = F.col("_level") > F.greatest(F.coalesce("_high", F.lit(0)), F.lit(0))
    return (
        moves.where(F.col("effect") == "create")
        .withColumn("accepted", ~refused)
        .drop("_over", "_creates", "_deletes", "_level", "_high")
    )


def classify_once(
    base: DataFrame, ops: DataFrame, cap: int = MAX_DECKS, chunk_rows: int = running.CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """-> (classified ops, creates with ``accepted``) as tables, for a batch that both `apply_ops` and `cards_after` take."""
    classified = written(classify(base, ops), "classified")
    return classified, written(accept_creates(base, classified, cap, chunk_rows), "creates")


def apply_ops(
    base: DataFrame, ops: DataFrame, cap: int = MAX_DECKS, chunk_rows: int = running.CHUNK_ROWS,
    classed: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """-> (deck table after the batch, refused creates). The last save of a deck wins.

    Where both decks and ops have `cards`, a save replaces them, too; decks that have them alone keep them. `classed` is
    what `classify_once` gives for the same decks, ops and cap.
    """
    carried = [c for c in ("cards",) if c in base.columns and c in ops.columns]
    classified = classed[0] if classed else classify(base, ops)
    latest = (
        classified.where(F.col("effect") == "update")
        .groupBy("user_id", F.col("deck_id").alias("id"))
        .agg(F.max_by(F.struct("name", "commander_id", "ts", *carried), "seq").alias("_new"))
    )
    gone = classified.where(F.col("effect") == "delete").select("user_id", F.col("deck_id").alias("id"))
    kept = (
        base.withColumn("id", F.col("id").cast("string"))
        .join(gone, ["user_id", "id"], "left_anti")
        .join(latest, ["user_id", "id"], "left")
    )
    touched = F.col("_new").isNotNull()
    kept = kept.select(
        "id",
        "user_id",
        F.when(touched, F.col("_new.name")).otherwise(F.col("name")).alias("name"),
        F.when(touched, F.col("_new.commander_id")).otherwise(F.col("commander_id")).alias("commander_id"),
        "created_at",
        F.when(touched, F.col("_new.ts")).otherwise(F.col("updated_at")).alias("updated_at"),
        *[F.when(touched, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in carried],
        *[c for c in ("cards",) if c in base.columns and c not in carried],
    )
    creates = classed[1] if classed else accept_creates(base, classified, cap, chunk_rows)
    created = creates.where("accepted").select(
        new_deck_id(F.col("user_id").cast("string"), F.col("seq").cast("string")).alias("id"),
        "user_id",
        "name",
        "commander_id",
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        *carried,
    )
    return kept.unionByName(created, allowMissingColumns=True), creates.where(~F.col("accepted")).drop("effect", "accepted")


def clean_names(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> (ops with trimmed names, refused saves): a save needs a name that is neither blank nor too long."""
    trimmed = ops.withColumn("name", C.trim_all("name"))
    length = F.coalesce(F.length("name"), F.lit(0))
    fits = (F.col("op") != "save") | ((length > 0) & (length <= DECK_NAME_LENGTH))
    return trimmed.where(fits), trimmed.where(~fits)


def cards_after(
    base_cards: DataFrame, base: DataFrame, ops: DataFrame, cap: int = MAX_DECKS, chunk_rows: int = running.CHUNK_ROWS,
    classed: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(deck_id, card_id, quantity) of all decks after the batch.

    Ops carry ``cards``, an array of (card_id, quantity). The last save of a deck replaces its cards, an
    accepted create brings its own, a delete takes them away. `classed` is what `classify_once` gives.
    """
    classified, creates = classed or (classify(base, ops), None)
    if creates is None:
        creates = accept_creates(base, classified, cap, chunk_rows)
    last = (
        classified.where(F.col("effect") == "update").groupBy("deck_id").agg(F.max_by("cards", "seq").alias("cards"))
    )
    gone = classified.where(F.col("effect") == "delete").select("deck_id")
    kept = (
        base_cards.select(F.col("deck_id").cast("string").alias("deck_id"), "card_id", "quantity")
        .join(last.select("deck_id").unionByName(gone).distinct(), "deck_id", "left_anti")
    )
    replaced = last.join(gone, "deck_id", "left_anti").select("deck_id", F.inline("cards"))
    new_id = new_deck_id(F.col("user_id").cast("string"), F.col("seq").cast("string")).alias("deck_id")
    created = creates.where("accepted").select(new_id, F.inline("cards"))
    return kept.unionByName(replaced).unionByName(created)
