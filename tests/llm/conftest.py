import pytest

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None, "", " \n\t ", "one", "one two", "a b c", "A B C", "a  b\nc", "x" * 5000, "é ü ß 😀 " * 40,
    "the same line\nthe same line\nother", "word " * 3000, "İſ password=abcdefghijklmnop", "<|endoftext|> x",
]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (None, "a b c", None, None, None), (7, None, "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for name in ("fp", "id", "anchor", "u", "row", "words", "n", "word", "key", "lines", "line", "terms", "term", "_gone", "_key", "_row", "_target", "_tie", "_told", "_words", "_at", "tie", "target", "told", "row_key", "gone_places", "own_words", "own_at", "site", "place", "band", "text_"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
