"""Session settings the jobs rely on, and where they may write shared state."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings: adaptive plans, and splitting of hot join keys even when
# that costs an extra exchange further up the plan.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Shuffle files go when their query has ended, not when the driver happens to collect garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # A batch sent to Python is bounded in bytes, not only in rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
# Rows of many megabytes: their sizes are looked at one by one, not a hundred rows later.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}

# Shuffles begin with at least so many partitions, which adaptive plans join up again where they are small: a
# task's share stays near their advisory size, while the session's own number would let it grow with the input.
LEAST_PARTITIONS = 512
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

_LOCAL_ROOT: dict[str, str] = {}
# Where the tables lie that `written` gave.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    initial = str(max(LEAST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if spark.conf.get(INITIAL, None) != initial:
        spark.conf.set(INITIAL, initial)
    return spark


def local_session(cores: str = "*", app: str = "cardloom") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        # No call-site capture for every column expression: plans build faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only where the session names
    none and runs on one machine (tests) is a temporary folder used; it goes when Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL_ROOT.get("path")
        if not root:
            root = _LOCAL_ROOT["path"] = tempfile.mkdtemp(prefix="cardloom-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/cardloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: worked out once, read many times. `large`: rows of megabytes.

    A lost executor costs the reading tasks only, not the work before the table.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.options(**LARGE_ROWS if large else {}).option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that `written` gave, where nothing will read it any more; other rows are left alone."""
    path = _WRITTEN.pop(table, None)
    if path:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
