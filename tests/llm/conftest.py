import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again"),
    (2, "the QUICK brown fox jumps over the lazy dog again and again"),
    (3, ""),
    (4, None),
    (5, "one two three"),
    (6, "One two THREE"),
    (7, "   \n\t "),
    (8, "word " * 5000),
    (9, "the quick brown fox jumps over the lazy dog again and again today"),
    (1, "The quick brown fox jumps over the lazy dog again and again"),
    (10, "日本語 文字 <|endoftext|> ▁ é 😀"),
    (None, "a text without an id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, with extra columns whose names clash."""
    rows = [(i, t, "en" if t else None, 0.5, "x", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, shingles string, length int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
