"""A Bloom filter of a table's 64-bit keys, of fixed greatest size.

It only spares work: what it lets through is joined exactly afterwards.  Its
size follows the number of keys up to ``MAX_BITS`` (8 MB), which bounds what the
driver gathers and broadcasts; more keys make it less selective, not larger.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 16, 1 << 26
BITS_PER_KEY = 16


def bloom_of(keys: DataFrame, column: str, n_keys: int) -> np.ndarray:
    """64-bit words of the filter of ``keys[column]`` (long)."""
    bits = min(max(1 << (max(n_keys, 1) * BITS_PER_KEY - 1).bit_length(), MIN_BITS), MAX_BITS)
    key = F.col(column)
    places = keys.select(F.explode(F.array(key.bitwiseAND(bits - 1), F.shiftright(key, 32).bitwiseAND(bits - 1))).alias("_bit"))
    words = places.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column("_word").to_numpy()] = words.column("_bits").to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(words) * 64 - 1)
    found = np.ones(len(keys), dtype=bool)
    for place in (keys & bits, ((keys.view(np.int64) >> 32).view(np.uint64)) & bits):
        found &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found
