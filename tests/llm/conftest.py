import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard int, fingerprint string, " \
          "rate double, copies long, n_tokens long, p_good double"
LONG = "the thing of another word and more words in it. " * 4000

#: Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, and columns named like results.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs to the hill.\nA second line that repeats here.", "en", "a", 5, "x", 1, "f"),
    (2, "", "en", "a", 0, None, None, None), (3, None, None, None, None, None, None, None), (4, " \t\n \x0b", "de", "b", 3, "x", 2, "f"),
    (5, LONG, "en", "a", len(LONG), "x", 3, "f"), (6, "short", "xx", "b", 5, "x", 4, "f"), (6, "short", "xx", "b", 5, "x", 4, "f"),
    (7, "The quick brown fox jumps over the lazy dog and runs to the hill.\nA second line that repeats here.", "en", "a", 5, "x", 1, "f"),
    (8, "a second LINE that repeats here.  \n\nÉtait-ce une fête à Orléans ?", "fr", "c", 9, "x", 5, "f"), (None, "no id at all", "en", "a", 3, "x", 6, "f"),
    (9, "日本語 テキスト 😀 <|endoftext|> it's I'll 1234", "ja", "c", 9, "x", 7, "f"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*row, -7.0, -7, None, 0.5) for row in ODD], COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (8, 0, 0), (9, None, 1), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
