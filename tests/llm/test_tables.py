import random

from cohortlens.llm.tables import row_bits, rows_of_bits


def test_rows_of_bits_are_the_rows_of_the_set(spark):
    """Numbers of several partitions, bytes and buckets, the ends of each, and clashing names."""
    rng = random.Random(5)
    numbers = sorted({0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, *((p << 33) + rng.randrange(40000) for p in (0, 1, 5) for _ in range(400))})
    some = [n for n in numbers if rng.random() < 0.5] + [0, 32768]
    df = spark.createDataFrame([(n, n) for n in numbers], "n long, bits long")
    chosen = spark.createDataFrame([(n,) for n in some], "n long")
    assert sorted(r["n"] for r in rows_of_bits(df, "n", row_bits(chosen, "n")).collect()) == sorted(set(some))
    assert rows_of_bits(df, "n", row_bits(chosen.limit(0), "n")).count() == 0
