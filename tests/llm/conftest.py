import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def given(spark):
    """Ids and texts of the smallest table, as they are."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [None, "", " \t\n", "a", "A", "a", "Ä", "ä", "x" * 50_000, long, long.upper(), "one two three",
             "one two three", "  double  spaces \n\n and tabs\t\n", "nul\0byte", "日本 🙂🙂 é́", "▁ low ▁▁ bars ▁",
             "<|endoftext|> </s>[INST]", "  \x1c odd \x85 blanks \xa0"]
    return [(k, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same with repeated and missing ids, and columns that clash with those of the operators."""
    rows = [(k, t, None if k % 3 else "en", None if k % 4 else "src", None) for k, t in odd_rows]
    rows += [rows[3], rows[0], (None, None, None, None, None), (None, "a", "en", "src", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    clashes = {c: "lit" for c in ("row", "number", "rank", "key", "fp", "shard", "ids", "content", "group", "x0", "centre",
                                  "spans", "found", "kept", "size", "sequence_id", "n_words", "secret_spans")}
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(v) for c, v in clashes.items()})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
