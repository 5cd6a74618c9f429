import pytest

# names that the operators use inside, as extra columns of the input
CLASHING = "lang string, source string, n_chars long, at long, tie long, bucket int, fp long, id long, label int, score double, key long, file string"
LONG = "lorem ipsum dolor sit amet " * 20_000


def rows(pairs):
    return [(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, 6, 0.5, 7, "f") for i, t in pairs]


@pytest.fixture
def table(spark):
    """A documents table from (doc_id, text) pairs, with clashing extra columns."""
    return lambda pairs: spark.createDataFrame(rows(pairs), f"doc_id long, text string, {CLASHING}")


@pytest.fixture
def odd(table):
    """Nulls, empties, ties, repeated rows and a very long text."""
    return table([
        (3, "alpha beta gamma delta"), (1, None), (2, ""), (5, "alpha beta gamma delta"), (5, "alpha beta gamma delta"),
        (4, " \t\n"), (None, "no id here"), (9, LONG), (7, "Ünïcödé 漢字 😀 text"), (8, "1234 !!"),
    ])


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
