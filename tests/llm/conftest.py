import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, score double, digest string, `start` long"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").persist()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and extra columns with names the operators use."""
    base = " ".join(f"word{i % 97} thing{i % 89}" for i in range(150))
    texts = [
        base, base, base + " end", base.upper(), None, "", "   \n\t ", "one", "One two", "x " * 30_000, "é" * 50_000, "😀 \x0b\x0c\r\n a b ", "#*$ | <|im_end|> \\s", "line\nline\nline\n", "don't STOP, naïve Ærø! 12 漢字",
        "".join(chr(c) for c in range(1, 200)),
    ]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 else "s", None, i, True, 0.5, "d", 3) for i, t in enumerate(texts)]
    rows += [(0, base, "en", "s", 1, 1, True, 0.5, "d", 3), (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
