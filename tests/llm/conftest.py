import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long one, repeated rows, and columns whose names operators use."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s", 5, "x"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s", 5, "x"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s", 5, "x"),
        (3, "", "de", "s", 0, None),
        (4, None, None, None, None, None),
        (5, " \n\t ", "fr", "s", 4, "x"),
        (None, "no id here", "en", "s", 10, "x"),
        (6, long, "en", "s", len(long), "x"),
        (7, "1234 --- 5678", "en", "s", 13, "x"),
        (8, "ünïcode ßtraße 日本語テキスト😀", "de", "s", 9, "x"),
    ]
    wide = [r + (f"k{r[0]}", 1, 2, 3, 4) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, id string, key string, n int, size int, component int, length int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
