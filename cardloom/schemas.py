"""Declared table schemas; nothing is inferred from data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fields(*pairs):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in pairs])


_STR = T.StringType()
_STRS = T.ArrayType(T.StringType())

CARD = _fields(
    ("id", _STR),
    ("oracle_id", _STR),
    ("name", _STR),
    ("mana_cost", _STR),
    ("mana_value", T.DoubleType()),
    ("oracle_text", _STR),
    ("colors", _STRS),
    ("color_identity", _STRS),
    ("type_line", _STR),
    ("keywords", _STRS),
    ("image_url", _STR),
)

CARD_METADATA = _fields(
    ("card_id", _STR),
    ("summary", _STR),
    ("roles", _STRS),
    ("themes", _STRS),
    ("game_stage", _STR),
    ("power_rating", T.DoubleType()),
    ("strengths", _STRS),
    ("weaknesses", _STRS),
    ("synergy_tags", _STRS),
)

COLLECTION = _fields(("user_id", _STR), ("card_id", _STR), ("quantity", T.IntegerType()))

DECK = _fields(
    ("id", _STR),
    ("user_id", _STR),
    ("name", _STR),
    ("commander_id", _STR),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
)

DECK_CARD = _fields(
    ("deck_id", _STR),
    ("card_id", _STR),
    ("quantity", T.IntegerType()),
    ("owned", T.BooleanType()),
    ("proxy", T.BooleanType()),
)

REQUEST = _fields(
    ("request_id", _STR),
    ("user_id", _STR),
    ("build_around_card_names", _STRS),
    ("power_level", _STR),
    ("collection_preference", _STR),
)

VECTOR = _fields(
    ("card_id", _STR),
    ("document", _STR),
    (
        "meta",
        _fields(
            ("name", _STR),
            ("colors", _STRS),
            ("roles", _STRS),
            ("themes", _STRS),
            ("mana_value", T.DoubleType()),
        ),
    ),
    ("embedding", T.ArrayType(T.FloatType())),
)

# Child tables of the metadata: one row for each entry of a list, in its order.
CARD_ROLE = _fields(("card_id", _STR), ("position", T.IntegerType()), ("role", _STR))
CARD_THEME = _fields(("card_id", _STR), ("position", T.IntegerType()), ("theme", _STR))
METADATA_FACTS = _fields(
    ("card_id", _STR),
    ("summary", _STR),
    ("game_stage", _STR),
    ("power_rating", T.DoubleType()),
    ("strengths", _STRS),
    ("weaknesses", _STRS),
    ("synergy_tags", _STRS),
)


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in their order and types; columns that are missing are NULL."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


# JSON text shapes, parsed with from_json.
METADATA_JSON = _fields(
    ("summary", _STR),
    ("roles", _STRS),
    ("themes", _STRS),
    ("game_stage", _STR),
    ("power_rating", T.DoubleType()),
    ("strengths", _STRS),
    ("weaknesses", _STRS),
    ("synergy_tags", _STRS),
    ("_corrupt", _STR),
)

DECK_RESPONSE_JSON = _fields(
    ("commander", _STR),
    ("cards", T.ArrayType(_fields(("name", _STR), ("quantity", T.IntegerType())))),
    ("explanation", _STR),
    ("_corrupt", _STR),
)
