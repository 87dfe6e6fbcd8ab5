import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and house river stone winter garden letter music silver paper morning window market bridge forest yellow".split()


def sentence(seed, n):
    return " ".join(WORDS[(seed * 7 + k * k * 3 + k * seed) % len(WORDS)] for k in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with NULLs, empty and long texts, exact and near copies, repeated rows and odd characters."""
    rows = [(k, sentence(k, 30 + k), "en", "src0", 1) for k in range(24)]
    base = " ".join(f"{w}{k}" for k, w in enumerate(WORDS * 6))
    rows += [
        (100, base, "en", "src0", 1),
        (101, base, "en", "src0", 1),
        (102, base + " more", "en", "src1", 1),
        (103, None, None, None, None),
        (104, "", "en", "src0", 0),
        (105, "  \n \t ", "en", "src0", 0),
        (106, "1234 !! 567", "en", "src0", 0),
        (107, "word " * 5000, "en", "src0", 0),
        (108, "x" * 3000, "en", "src0", 0),
        (109, "don't  we'll\n\nsee it <|endoftext|> straße ÉTÉ 中文 👍 İ!\x0bx\ry", "en", "src0", 0),
        (110, "one two", "de", "src0", 0),
        (None, "no id here at all", "en", "src0", 0),
    ]
    rows += [(7, sentence(7, 37), "en", "src0", 1)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(documents):
    """The documents with more columns, named as the operators' own."""
    out = documents
    for name in ("score", "predicted", "lang_pred", "node", "n", "tail", "ids", "token", "part", "label"):
        out = out.withColumn(name, documents.source)
    return out


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
