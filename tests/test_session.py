from pyspark.sql import functions as F

from cardloom import session


def test_shuffles_begin_with_many_partitions(spark):
    """However few partitions a session asks for, adaptive shuffles begin with enough of them; more are kept."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for asked, expected in (("4", session.LEAST_PARTITIONS), ("3000", 3000)):
            spark.conf.set("spark.sql.shuffle.partitions", asked)
            assert session.tune(spark).conf.get(session.INITIAL) == str(expected)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        counted = session.tune(spark).range(1000).groupBy((F.col("id") % 10).alias("k")).count()
        assert f", {session.LEAST_PARTITIONS})" in counted._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        session.tune(spark)


def test_written_tables_can_be_discarded(spark):
    """Only the folder of the table goes, and the table's shuffle files do not wait for it."""
    held, other = (session.written(spark.range(n), "held") for n in (5, 7))
    session.discard(held)
    session.discard(held)
    session.discard(spark.range(3))
    assert other.count() == 7 and session.tune(spark).conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    try:
        assert spark.read.schema(held.schema).parquet(*held.inputFiles()).count() == 0
    except Exception as gone:
        assert "NOT_EXIST" in str(gone) or "NOT_FOUND" in str(gone)
