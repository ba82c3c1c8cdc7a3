"""Joins and lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import broadcast_if_small, cut

HOT_ROWS = 1_000_000
#: Rows of a hot key that one task is given.
ROWS_PER_SALT = 500_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, most: int | None = None) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and their number of salts, or None when there are none.

    ``most`` is a number of rows that no key exceeds, where the caller knows one (all rows of a table, for instance).

    Counting combines map-side. Rows / hot_rows keys can qualify, so the table grows with the data, if slowly: it stays a
    table, and its joins broadcast it only where it measures small.
    """
    if most is not None and most <= hot_rows:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    salts = F.ceil(F.col("_n") / F.lit(min(hot_rows, ROWS_PER_SALT))).cast("int")
    found = cut(counts.select(*keys, salts.alias("_salts")))
    return None if found.isEmpty() else found


def spread_join(
    big: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame | None, salt_by: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join whose ``hot`` keys of ``big`` are salted by the columns ``salt_by`` and replicated on the other side.

    A key has as many salts as its rows fill tasks, so no task grows with the hottest key.
    """
    if hot is None:
        return big.join(other, keys, how)
    flags = broadcast_if_small(hot)
    salts = F.coalesce("_salts", F.lit(1))
    left = big.join(flags, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int")).drop("_salts")
    right = other.join(flags, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
