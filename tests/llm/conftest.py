import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import DOCUMENTS, invented  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, long and repeated texts, ties."""
    long = "\n".join(invented(i, 40) for i in range(400))
    rows = [
        (1, invented(1, 120), "en", "a", 5),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t\n ", "en", "a", 5),
        (None, invented(1, 120), "en", "a", 5),
        (None, None, None, None, None),
        (5, invented(1, 120), "en", "b", 5),
        (5, invented(1, 120), "en", "b", 5),
        (6, long, "en", "a", len(long)),
        (7, "one two", "en", "a", 7),
        (8, "one  two\r\n three <|endoftext|> \x00 é.", "fr", "a", 7),
        (9, "same line\n" * 30, "en", "a", 300),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


CLASHING = "key id at w h n node element part block seed item_id hits overlap own text2 size length start".split()


@pytest.fixture
def clashing():
    """Adds columns with names that operators use inside."""
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c not in df.columns})
