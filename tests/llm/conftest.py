import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, n_tokens string, key long, part string, code int, score string, held_out int, component_id long, label string"


@pytest.fixture(scope="session")
def given(spark):
    """The documents of the smallest tables and their texts by id."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return docs, {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def odd_rows():
    extra = (1, "x", None, "y", 2, None, 3, None, "z")
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, words, "en", "b"), (4, words, "en", "b"),
        (None, words + " thirteen", "de", None), (None, None, None, "b"), (7, "12 34 %% --", "de", "c"), (8, "é\U0001f600 中文 <|endoftext|> Σ\x00", "fr", "c"),
        (9, "der die das und nicht mit auch " * 40, "de", "a"), (10, "the and of to in is that " * 9000, "en", "a"), (11, "x" * 50_000, "en", "a"),
        (2**62, words, "en", "b"), (-5, words.upper(), "en", "b"), (4, "another text with the same id", "en", "b"),
    ]
    return [(*row[:2], row[2], row[3], 5, *extra) for row in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long, repeated and tied rows, and columns named like those that operators make."""
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(1, 12)] + [(4, 1, 1), (9, 0, 1), (9, 0, 1), (None, 1, 1), (10, None, None), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
