"""Ordered folds that stay distributed when one key holds most of the rows.

A plain window per key would send a hot key to one task. Here the rows of a key
are cut into chunks of a log sequence; each chunk is folded on its own, and only
one summary row per chunk takes part in the per-key step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.session import written

# Sequence numbers per chunk. A unique sequence bounds the rows of one chunk.
CHUNK_ROWS = 65_536


def chunk_of(seq: Column | str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a unique, non-negative log sequence."""
    value = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(value / F.lit(rows)).cast("bigint")


def with_running(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums and maxima per key, ordered by a unique sequence.

    ``inclusive=False`` leaves the row itself out (NULL maximum on the first row).
    """
    steps = [(out, expr, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) for out, expr in (sums or {}).items()]
    steps += [(out, expr, F.max, F.greatest) for out, expr in (maxes or {}).items()]
    chunked = df.withColumn("_chunk", chunk_of(order, chunk_rows))

    totals = chunked.groupBy(*keys, "_chunk").agg(*[agg(expr).alias(f"_total_{out}") for out, expr, agg, _ in steps])
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *keys, "_chunk", *[agg(f"_total_{out}").over(earlier).alias(f"_carry_{out}") for out, _, agg, _ in steps]
    )

    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    local = chunked.select("*", *[agg(expr).over(inside).alias(f"_local_{out}") for out, expr, agg, _ in steps])
    joined = local.join(carried, [*keys, "_chunk"])
    return joined.select(
        *df.columns,
        *[merge(F.col(f"_local_{out}"), F.col(f"_carry_{out}")).alias(out) for out, _, _, merge in steps],
    )


def with_previous(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add the value of the key's preceding row (NULL for the first row)."""
    boxed = F.struct(F.col(value).alias("v"))
    chunked = df.withColumn("_chunk", chunk_of(order, chunk_rows))
    last = chunked.groupBy(*keys, "_chunk").agg(F.max_by(boxed, order).alias("_last"))
    carried = last.select(
        *keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    local = chunked.withColumn("_before", F.lag(boxed).over(inside))
    return local.join(carried, [*keys, "_chunk"]).select(
        *df.columns, F.coalesce("_before", "_carry")["v"].alias(out)
    )


def fold_floors(
    df: DataFrame, keys: list[str], order: list[str], seq: str, shift: str, floor: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Fold steps ``x -> max(floor, x + shift)`` per key, starting from zero.

    Steps of this form compose into one step of the same form, so every chunk
    folds to one (shift, floor) pair and the pairs fold once more per key. A
    shift of minus infinity makes a step a constant. ``order`` lists the ordering
    columns, the first of which is ``seq``. Returns keys and DOUBLE ``value``.
    """

    def compose(rows: DataFrame, by: list[str], ordering: list[str]) -> DataFrame:
        later = (
            Window.partitionBy(*by)
            .orderBy(*[F.col(c).desc() for c in ordering])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return (
            rows.withColumn("_after", F.coalesce(F.sum("_shift").over(later), F.lit(0.0)))
            .groupBy(*by)
            .agg(F.sum("_shift").alias("_shift"), F.max(F.col("_floor") + F.col("_after")).alias("_floor"))
        )

    steps = df.select(
        *keys,
        *order,
        chunk_of(seq, chunk_rows).alias("_chunk"),
        F.col(shift).cast("double").alias("_shift"),
        F.col(floor).cast("double").alias("_floor"),
    )
    per_chunk = compose(steps, [*keys, "_chunk"], order)
    per_key = compose(per_chunk, keys, ["_chunk"])
    return per_key.select(*keys, F.greatest("_shift", "_floor").alias("value"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Add each row's place among its key's rows, from 1 on; `order` must leave no ties.

    The rows are sorted by range of key and order, so a hot key lies in many parts; what a key has in earlier parts
    is added to the place in its own.
    """
    names = [f"_o{i}" for i in range(len(order))]
    sorted_rows = df.select("*", *[column.alias(name) for column, name in zip(order, names)])
    ranged = sorted_rows.repartitionByRange(*keys, *names).withColumn("_part", F.spark_partition_id())
    parts = written(ranged, "ranked")
    inside = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*names))
    before = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # Parts are ranges: only the first key of a part can have rows in earlier ones, so there are fewer of these than parts.
    before = F.broadcast(before.where("_before > 0"))
    placed = parts.withColumn("_inside", inside)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = placed.join(before, [F.col("_part") == F.col("_p"), *same], "left")
    return joined.select(*df.columns, (F.coalesce("_before", F.lit(0)) + F.col("_inside")).alias(out))
