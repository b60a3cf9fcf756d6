import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("digest", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("score", T.StringType()),
])
FILLER = "the quick brown fox jumps over a lazy dog while seven wizards box and mix their gin with vodka slowly".split()


def messy_rows():
    """Nulls, empty and very long texts, repeats, ties and columns with clashing names."""
    words = lambda seed, n: " ".join(FILLER[(seed * 7 + k * k * (seed + 3) + k // 5) % len(FILLER)] + str((seed * k) % 11) for k in range(n))
    base = words(5, 120)
    texts = [
        (1, base), (2, base), (3, base.upper()), (4, base + " one more"), (5, None), (6, ""), (7, " \n\t "), (8, "four words only here"),
        (9, "Four words ONLY here"), (10, words(9, 30000)), (11, words(2, 60) + "\n" + words(2, 60)), (None, base), (None, None), (1, base),
        (12, "café “curly” 中文 don't <|endoftext|> \x85 é \U0001f600"), (13, "x" * 50000), (14, words(1, 19)), (15, words(1, 20)), (16, words(1, 21)),
    ]
    return [(i, t, "en", "s", len(t or ""), "d", "b", None) for i, t in texts]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
