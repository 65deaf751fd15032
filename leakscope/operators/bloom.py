"""A Bloom filter as a small table of bit pages, for scans whose keys do not fit a broadcast.

Keys are 64-bit hashes.  Each sets two bits; pages of bits are broadcast, at most
``MAX_BITS`` bits whatever the number of keys, so a scan drops rows whose key is surely
not wanted before anything is shuffled.  With more keys than the bits are meant for it lets more
rows pass, and loses none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.session import settle

BITS_A_KEY = 16
MAX_BITS = 1 << 29  # 64 MB
_PAGE = 1 << 15  # bits of a page: 512 longs
_WORDS = _PAGE // 64


@dataclass(frozen=True)
class Bloom:
    """Pages (bloom_page, bloom_words) of a filter of ``bits`` bits."""

    pages: DataFrame
    bits: int

    def probable(self, df: DataFrame, key: Column, always: Column | None = None) -> DataFrame:
        """Rows whose key may be in the filter, and those where ``always`` holds."""
        pages = F.broadcast(self.pages)
        found = df
        for place in _places(key, self.bits):
            word = F.col("bloom_words")[F.shiftright(place, 6).bitwiseAND(F.lit(_WORDS - 1)).cast("int")]
            bit = F.expr("shiftrightunsigned(bloom_word, bloom_bit) & 1L") == 1
            passed = F.coalesce(bit, F.lit(False))
            found = (
                found.withColumn("bloom_at", F.shiftright(place, 15))
                .join(pages, F.col("bloom_at") == F.col("bloom_page"), "left")
                .withColumns({"bloom_word": word, "bloom_bit": place.bitwiseAND(F.lit(63)).cast("int")})
                .where(passed if always is None else passed | always)
                .select(*df.columns)
            )
        return found


def _places(key: Column, bits: int) -> list[Column]:
    """Two bit numbers from the low and the high half of a hash."""
    mask = F.lit(bits - 1).cast("long")
    return [key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask)]


def bloom_filter(keys: DataFrame, key: Column, max_bits: int | None = None) -> Bloom:
    """The filter of all values of ``key``; nulls set no bits."""
    bits = _PAGE
    wanted = BITS_A_KEY * keys.count()
    while bits < wanted and bits < (max_bits or MAX_BITS):
        bits *= 2
    place = F.col("place")
    pages = (
        keys.where(key.isNotNull())
        .select(F.explode(F.array(*_places(key, bits))).alias("place"))
        .select(
            F.shiftright(place, 15).alias("bloom_page"),
            F.shiftright(place, 6).bitwiseAND(F.lit(_WORDS - 1)).cast("int").alias("word"),
            F.expr("shiftleft(1L, cast(place & 63 as int))").alias("mask"),
        )
        .groupBy("bloom_page", "word")
        .agg(F.bit_or("mask").alias("mask"))
        .groupBy("bloom_page")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words"))
    )
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(_WORDS - 1)),
        lambda w: F.coalesce(F.try_element_at("words", w), F.lit(0).cast("long")),
    )
    return Bloom(settle(pages.select("bloom_page", filled.alias("bloom_words"))), bits)
