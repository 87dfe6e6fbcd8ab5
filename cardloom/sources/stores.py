"""Parquet tables that are replaced whole, and tables in hash buckets of which only touched ones are replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from cardloom.session import written

# Buckets of a bucketed table; fixed for a table once it holds rows.
BUCKETS = 64
# A marker row of a bucket says which batch of which stream it was last replaced by.
STREAM, BATCH = "_stream", "_batch"


def _file_system(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    fs, _ = _file_system(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def save_table(df: DataFrame, base: str) -> None:
    """Replace the whole table. The rows may come from the table itself: they are whole elsewhere before old ones go."""
    spark = df.sparkSession
    fs, _ = _file_system(spark, base)
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    beside = f"{base.rstrip('/')}-next"
    df.write.mode("overwrite").parquet(beside)
    fs.delete(new_path(base), True)
    if not fs.rename(new_path(beside), new_path(base)):
        raise OSError(f"{beside} could not take the place of {base}")


def load_table(spark: SparkSession, base: str, schema: StructType | str) -> DataFrame | None:
    """The stored table, or None where none is whole. One that stopped between old and new is the new one."""
    fs, root = _file_system(spark, base)
    beside = f"{base.rstrip('/')}-next"
    if not fs.exists(root) and is_whole(spark, beside):
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), root)
    return spark.read.schema(schema).parquet(base) if is_whole(spark, base) else None


def load_or_seed(spark: SparkSession, base: str, schema: StructType | str, seed: DataFrame) -> DataFrame:
    """The stored table; where nothing whole is stored, the seed is stored first."""
    stored = load_table(spark, base, schema)
    if stored is None:
        save_table(seed, base)
        stored = load_table(spark, base, schema)
    return stored


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Rows and marker rows of all buckets; a filter on `bucket` reads those folders only."""
    full = StructType([*spark.createDataFrame([], schema).schema, StructField(STREAM, StringType()), StructField(BATCH, LongType()), StructField("bucket", IntegerType())])
    fs, root = _file_system(spark, base)
    if not fs.exists(root):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(base)


def read_buckets(spark: SparkSession, base: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """All rows of a bucketed table, or of some buckets; none where there is no table."""
    rows = _stored(spark, base, schema).where(F.col(STREAM).isNull())
    return (rows if only is None else rows.where(F.col("bucket").isin(only))).drop(STREAM, BATCH, "bucket")


def _replace_buckets(after: DataFrame, base: str, name: str) -> None:
    """Put rows and marker rows in place of those of their buckets.

    A folder cannot be read and replaced by one job: the new rows are whole, in a folder of this name, before old ones go.
    """
    spark, beside = after.sparkSession, f"{base}/_next/{name}"
    after.write.mode("overwrite").parquet(beside)
    whole = spark.read.schema(after.schema).parquet(beside)
    whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(base)
    _file_system(spark, base)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(beside), True)


def _loaded(rows: DataFrame, marked: list[int]) -> DataFrame:
    """Rows with their buckets as a load stores them, and its marker rows."""
    marks = rows.sparkSession.createDataFrame([("load", 0, b) for b in marked], f"{STREAM} string, {BATCH} long, bucket int")
    empty = [F.lit(None).cast("string").alias(STREAM), F.lit(None).cast("long").alias(BATCH)]
    return rows.select(*[c for c in rows.columns if c != "bucket"], *empty, "bucket").unionByName(marks, allowMissingColumns=True)


def unstage(spark: SparkSession, base: str) -> None:
    fs, staged = _file_system(spark, f"{base.rstrip('/')}-staged")
    fs.delete(staged, True)


def stage(rows: DataFrame, base: str, schema: str, keys: list[str], marked: list[int], buckets: int = BUCKETS) -> None:
    """Put rows of the buckets `marked` beside the table, for `load_changed` to set them in place; all others may follow by further calls."""
    columns = rows.sparkSession.createDataFrame([], schema).columns
    placed = _loaded(rows.select(*columns).withColumn("bucket", bucket_of(keys, buckets)), marked)
    placed.repartition("bucket").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{base.rstrip('/')}-staged")


def load_changed(incoming: DataFrame | None, base: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Make the bucketed table hold the incoming rows, rewriting only buckets in which a row is new, changed or gone.

    Returns the keys that differ with ``change``: new, changed or gone. Rows are compared by a hash of their
    content; keys must be unique and not NULL in what comes in. Without `incoming` the rows are those that `stage` put
    beside the table, all buckets of it, whose folders then take the place of the old ones.
    """
    spark = SparkSession.active() if incoming is None else incoming.sparkSession
    beside = f"{base.rstrip('/')}-staged"
    if staged := incoming is None:
        incoming = read_buckets(spark, beside, schema)
    columns = spark.createDataFrame([], schema).columns
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    held = _stored(spark, base, schema).where(F.col(STREAM).isNull())
    old = held.select(*keys, F.col("bucket").alias("_old"), content.alias("_before"))
    new = incoming.select(*keys, bucket_of(keys, buckets).alias("_new"), content.alias("_after"))
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_after").isNull(), "gone").when(F.col("_before") != F.col("_after"), "changed")
    changes = old.join(new, keys, "full").select(*keys, F.coalesce("_old", "_new").alias("bucket"), change.alias("change"))
    # Written first: the table they were found in is about to change.
    changes = written(changes.where("change IS NOT NULL"), "changes")
    touched = sorted(r.bucket for r in changes.select("bucket").distinct().collect())  # `buckets` numbers at most
    if staged:
        fs, root = _file_system(spark, base)
        fs.mkdirs(root)
        for bucket in touched:
            own, place = (spark._jvm.org.apache.hadoop.fs.Path(x, f"bucket={bucket}") for x in (beside, base))
            fs.delete(place, True)
            if not fs.rename(own, place):
                raise OSError(f"{own} could not take the place of {place}")
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(beside), True)
        spark.catalog.refreshByPath(base)
    elif touched:
        rows = incoming.select(*columns).withColumn("bucket", bucket_of(keys, buckets)).where(F.col("bucket").isin(touched))
        _replace_buckets(_loaded(rows, touched), base, "load")
    return changes.drop("bucket")


def update_buckets(
    batch: DataFrame, update: Callable[[DataFrame, DataFrame], DataFrame], base: str, schema: str, keys: list[str], stream: str, number: int,
    buckets: int = BUCKETS,
) -> None:
    """Replace the buckets that a batch touches by what `update(their rows, the batch)` gives.

    Each replaced bucket keeps a marker row for every stream that wrote to it. A bucket that already
    carries this stream's batch is left alone, so a batch that runs again is not applied twice, and
    batch numbers of different streams are never compared.
    """
    spark = batch.sparkSession
    placed = batch.withColumn("bucket", bucket_of(keys, buckets)).persist()
    try:
        touched = {r.bucket for r in placed.select("bucket").distinct().collect()}  # `buckets` numbers at most
        stored = _stored(spark, base, schema).where(F.col("bucket").isin(sorted(touched)))
        marks = stored.where(F.col(STREAM).isNotNull())
        done = {r.bucket for r in marks.where((F.col(STREAM) == stream) & (F.col(BATCH) >= number)).select("bucket").collect()}
        todo = sorted(touched - done)
        if not todo:
            return
        held = stored.where(F.col(STREAM).isNull() & F.col("bucket").isin(todo)).drop(STREAM, BATCH, "bucket")
        rows = update(held, placed.where(F.col("bucket").isin(todo)).drop("bucket")).select(*held.columns)
        rows = rows.withColumn(STREAM, F.lit(None).cast("string")).withColumn(BATCH, F.lit(None).cast("long")).withColumn("bucket", bucket_of(keys, buckets))
        own = spark.createDataFrame([(stream, number, b) for b in todo], f"{STREAM} string, {BATCH} long, bucket int")
        others = marks.where(F.col("bucket").isin(todo) & (F.col(STREAM) != stream)).select(STREAM, BATCH, "bucket")
        after = rows.unionByName(own.unionByName(others), allowMissingColumns=True)
        _replace_buckets(after, base, f"stream={stream}/batch={number}")
    finally:
        placed.unpersist()
