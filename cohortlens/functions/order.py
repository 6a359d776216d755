"""A reproducible shuffle of rows that does not depend on storage order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(row_id: Column | str, seed: int) -> Column:
    """Text key whose sort order is a seeded permutation of the rows."""
    return F.md5(F.concat_ws("-", F.col(row_id) if isinstance(row_id, str) else row_id, F.lit(str(seed))))


def hash_share(row_id: Column | str, seed: int, parts: int | str) -> Column:
    """Even bucket 0..parts-1 from a 64-bit hash; needs no pass over the data."""
    return F.pmod(F.xxhash64(F.col(row_id) if isinstance(row_id, str) else row_id, F.lit(seed)),
                  F.col(parts) if isinstance(parts, str) else F.lit(parts)).cast("int")
