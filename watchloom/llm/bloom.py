"""Bit filter over 64-bit hashes with a fixed upper size, built by a Spark aggregation.

A false positive never changes a result of the operators that use it: it only lets a few more
rows into a shuffle, or orders some symbols differently.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper size of a filter, and so of what is sent to the driver and broadcast: 8 MB.
MAX_BITS = 2**26


class Bloom:
    """Two probes per hash, both taken from the hash itself."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            found &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found


def build(hashes: DataFrame, column: str, count: int | None = None, max_bits: int = MAX_BITS) -> Bloom:
    """Filter over a bigint column; about 10 bits per value until ``max_bits`` is reached."""
    count = hashes.count() if count is None else count
    bits = 2**12
    while bits < 10 * count and bits < max_bits:
        bits *= 2
    h = F.col(column)
    probe = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))))
    rows = (
        hashes.select(probe.alias("p"))
        .groupBy(F.shiftrightunsigned("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return Bloom(words)
