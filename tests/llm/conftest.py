import pytest

LONG = "word " * 30_000 + "end"
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, None),
    (4, "one two three four", "en", "b", 18),
    (4, "one two three four", "en", "b", 18),
    (5, "12 345 !!", "de", "b", 9),
    (6, LONG, "fr", "c", len(LONG)),
    (None, "no id here", "es", "c", 10),
    (7, "\x00 \x1c <|endoftext|> Σ ﬁ 漢字 é", None, "c", 8),
]
#: Columns that operators use inside, as extra columns of the input.
CLASHES = ["id", "fp", "score", "hit", "spans", "row", "part", "lang_pred", "batch", "token_ids", "x0", "kept", "n_words", "group", "start"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, *range(len(CLASHES))) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHES))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
