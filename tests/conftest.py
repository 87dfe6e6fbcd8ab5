import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from cardloom.functions import columns as C  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from cardloom.session import local_session

    session = local_session("4", "cardloom-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


CARD_SCHEMA = (
    "id string, oracle_id string, name string, mana_cost string, mana_value double, oracle_text string, "
    "colors array<string>, color_identity array<string>, type_line string, keywords array<string>, ordinal bigint"
)


@pytest.fixture(scope="session")
def make_cards(spark):
    """Cards from (id, name, type_line, identity letters[, mana value, cost]); None identity stays NULL."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            cid, name, type_line, letters, *rest = row
            value = float(rest[0]) if rest else 0.0
            cost = rest[1] if len(rest) > 1 else ""
            identity = None if letters is None else list(letters)
            full.append((cid, "o" + cid, name, cost, value, "", identity, identity, type_line, [], i))
        return spark.createDataFrame(full, CARD_SCHEMA).withColumn("ci_mask", C.identity_mask("color_identity"))

    return make


@pytest.fixture(scope="session")
def rows_of():
    def get(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))

    return get
