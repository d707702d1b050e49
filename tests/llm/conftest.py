import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def clashing():
    """Extra columns whose names an operator might use itself."""

    def add(df):
        names = ["n", "name", "key", "text_", "line", "leaf", "words", "n_tokens", "pivot", "value", "turns", "_text_", "rule"]
        return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})

    return add
