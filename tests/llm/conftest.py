import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{k % 700} and, more" for k in range(9000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "alpha beta gamma", None, None, 3), (4, long, "en", "b", 9),
        (5, "one two three four five six seven", "en", "b", 1), (5, "one two three four five six seven", "en", "b", 1), (6, " \n\t\x0b ", "fr", "b", 1),
        (7, "One TWO three four five six seven", "en", None, 1), (8, "<|endoftext|> x  y  z", "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, 1.5, "t", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, id string, size int")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("doc_id < -1")


@pytest.fixture(scope="session")
def real(sf):
    import pandas as pd

    return pd.read_parquet(f"{sf}/documents.parquet")
