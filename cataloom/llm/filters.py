"""Joins that send little over the network: a key filter of bounded size, and salted joins for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cataloom.llm.storage import stored

#: 64-bit words of a key filter.  A filter is broadcast; with its row overhead it has at most some 16 MB, whatever the data.
FILTER_WORDS = 1 << 18
#: Parts of a key in a salted join.
SALTS = 16


def _place(key: Column) -> tuple[Column, Column]:
    """The word that a 64-bit key falls on, and the three bits that it sets there."""
    drawn = F.xxhash64(key, F.lit(21))

    def bit(shift: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", drawn, F.lit(shift)).bitwiseAND(F.lit(63)).cast("int"))

    return F.pmod(F.xxhash64(key, F.lit(22)), F.lit(FILTER_WORDS)), bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


class KeyFilter:
    """A Bloom filter of 64-bit keys as a small table (word, bits).

    It lets every key of ``keys`` through, and others the more the fuller it is; beyond a few million keys it is full and lets
    all through.  So it only saves work before a join by the same key, which must follow, and never decides anything.
    """

    def __init__(self, keys: DataFrame):
        word, bits = _place(F.col(keys.columns[0]))
        self.table = stored(keys.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")), "filter")

    def _held(self, key: Column) -> tuple[Column, Column]:
        word, bits = _place(key)
        return self.table["_word"] == word, self.table["_bits"].bitwiseAND(bits) == bits

    def may_hold(self, rows: DataFrame, key: Column) -> DataFrame:
        """The rows whose key may be among the filter's keys; a null key never is."""
        word, bits = self._held(key)
        return rows.where(key.isNotNull()).join(F.broadcast(self.table), word & bits, "left_semi")  # at most FILTER_WORDS rows

    def cannot_hold(self, rows: DataFrame, key: Column) -> DataFrame:
        """The other rows."""
        word, bits = self._held(key)
        return rows.join(F.broadcast(self.table), key.isNotNull() & word & bits, "left_anti")


def salted_join(rows: DataFrame, sizes: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of many rows with a table of one row per key, a key's rows dealt over SALTS tasks by the column ``by``."""
    salt = F.pmod(F.xxhash64(by, F.lit(23)), F.lit(SALTS)).cast("int")
    each = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(each, [key, "_salt"]).drop("_salt")
