"""Bitmaps of hashes, which tell tasks what recurs elsewhere without a join; their size is bounded, whatever they hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import U

#: Bits of a bitmap (8 MB).
MARK_BITS = 26


def marks(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the low bits of a column of hashes, folded in the tasks."""
    low = F.pmod(column, F.lit(1 << MARK_BITS))
    bits = hashes.select(F.floor(low / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (low % 64).cast("int")).alias("bit"))
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MARK_BITS - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(U)


def has_mark(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap has."""
    return (filled[(hashes & U((1 << MARK_BITS) - 1)) >> U(6)] >> (hashes & U(63))) & U(1) == 1
