"""Deterministic pseudo-random draws made of plain integer arithmetic.

Every draw is a pure function of (seed, replicate, slot): the same on any
partitioning, after any executor loss, and in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 4_294_967_296
# Odd multiplier below 2**27: a product with a 32-bit word stays inside a bigint.
MULTIPLIER = 73_244_475


def mix32(value: Column) -> Column:
    """Scramble a bigint in [0, 2**32); a bijection."""
    h = value
    for _ in range(2):
        h = (h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(MULTIPLIER)) % F.lit(WORD)
    return h.bitwiseXOR(F.shiftright(h, 16))


def mix_with(state: Column, value: Column) -> Column:
    return mix32((state + value.cast("bigint")) % F.lit(WORD))


def name_seed(seed: int, name: Column) -> Column:
    """Seed for one arm: base seed plus the leading 32 bits of its hash."""
    head = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.pmod(F.lit(seed).cast("bigint") + head, F.lit(WORD))


def hash_key(*parts: "Column | str", separator: str = "|") -> Column:
    """Sort key for hash-ordered sampling."""
    return F.sha2(F.concat_ws(separator, *parts), 256)
