"""Hashes of runs of rows from running sums, so that two runs of one text are compared without gathering them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = (1 << 31) - 1
BASES = (1_103_515_245, 69_069_069)  # two independent polynomials
DIGIT_BITS, DIGITS = 8, 4  # positions are written in base 256; four digits are 2^32 rows


def power(base: int, exponent: Column) -> Column:
    """base ** exponent modulo MODULUS, by a table for each digit of the exponent."""
    out = F.lit(1).cast("bigint")
    for d in range(DIGITS):
        step = pow(base, 1 << (DIGIT_BITS * d), MODULUS)
        table = F.expr("array(" + ", ".join(f"{pow(step, i, MODULUS)}L" for i in range(1 << DIGIT_BITS)) + ")")
        digit = F.shiftrightunsigned(exponent, DIGIT_BITS * d).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")
        out = F.pmod(out * F.get(table, digit), F.lit(MODULUS))
    return out


def terms(value: Column, position: Column) -> list[Column]:
    """What each row adds to the running sums; sums of 2^32 rows still fit a bigint."""
    h = F.pmod(F.xxhash64(value), F.lit(MODULUS))
    return [F.pmod(h * power(b, position), F.lit(MODULUS)) for b in BASES]


def same_run(first: list[Column], second: list[Column], apart: Column) -> Column:
    """Whether two runs of equal length are equal, given the sums of their terms and the distance of their starts."""
    out = F.lit(True)
    for b, x, y in zip(BASES, first, second, strict=True):
        moved = F.pmod(F.pmod(x, F.lit(MODULUS)) * power(b, apart), F.lit(MODULUS))
        out = out & (moved == F.pmod(y, F.lit(MODULUS)))
    return out
