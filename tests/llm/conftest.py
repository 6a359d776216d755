import random

import pytest
from pyspark.sql import types as T

#: beside the columns of documents: names that operators use inside
CLASHES = ("score", "size", "hash", "print", "root", "stats", "bin_id", "piece", "start", "n_words", "quality_stats", "simhash_print", "Key")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES])


def rows_of_texts():
    """Ids, texts and sources: missing and empty ones, one very long, copies, near copies, repeated rows."""
    rng = random.Random(5)
    words = ["ab", "Bc", "çé", "the", "of", "x1", "naïve", "日本", "end.", "and"] + [f"w{i}" for i in range(200)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = make(60)
    out = [(i, make(rng.randint(1, 80)), f"s{i % 4}") for i in range(60)]
    out += [(100 + i, base, "s0") for i in range(25)]
    out += [(200 + i, base.replace(" the ", " teh ", 1) + f" t{i}", "s1") for i in range(10)]
    out += [(300, None, "s2"), (301, "", None), (302, " \t\n\x0b\x0c\r", "s2"), (303, make(9000), "s3"), (304, "one", None),
            (305, "one two", "s3"), (None, "no id here at all", "s0"), (None, None, None), (306, "a\xa0b c \x1cd", "s1")]
    out += [(400, "same row twice over and over", "s2")] * 3
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), *(["clash"] * len(CLASHES))) for i, t, s in rows_of_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
