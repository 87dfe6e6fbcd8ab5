"""Collection files: header and columns can be named by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name STRING, quantity INT, corrupt STRING"


def read_collection_csv(spark: SparkSession, path: str, user: Column, header: bool = True) -> DataFrame:
    """(user_id, name, quantity, corrupt) rows of a ``name,quantity`` file."""
    rows = (
        spark.read.schema(SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt")
        .option("header", header)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    return rows.select(user.alias("user_id"), "name", "quantity", "corrupt")


def parse_collection_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The same for lines that already are in a column; other columns are kept."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    parsed = lines.withColumn("_csv", F.from_csv(line, SCHEMA, options))
    kept = [c for c in lines.columns if c != line]
    return parsed.select(*kept, "_csv.name", "_csv.quantity", "_csv.corrupt")
