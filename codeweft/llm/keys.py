"""A bitmap of document keys, so that rows that cannot match need not be shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def maybe_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false if ``(k, tie)`` is surely not in ``wanted``.

    The bitmap has 2**26 bits, so at most 2**20 rows of 64 bits are broadcast whatever the size of ``wanted``; when it fills
    up, more rows are called possible.
    """
    slot = F.pmod(F.xxhash64("k", "tie"), F.lit(1 << 26))
    bit, word = F.expr("shiftleft(1L, cast(slot % 64 as int))"), F.floor(F.col("slot") / 64).cast("int")
    bits = wanted.select(slot.alias("slot")).select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = rows.withColumn("slot", slot).withColumn("word", word)
    hit = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.join(F.broadcast(bits), "word", "left").withColumn("maybe", hit).drop("slot", "word", "bits")
