"""Bit and integer utilities: columns for data, plain Python where the value is known when a plan is made."""

from __future__ import annotations

from math import comb, factorial

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def bit_length(x: Column) -> Column:
    """Binary digits of a non-negative number; 1 for 0."""
    return F.length(F.bin(x))


def floor_log2(x: Column) -> Column:
    """Exact for all positive longs; null for others."""
    return F.when(x > 0, F.length(F.bin(x)) - 1)


def to_binary(x: Column, width: int) -> Column:
    return F.lpad(F.bin(x), width, "0")


def from_binary(text: Column) -> Column:
    return F.conv(text, 2, 10).cast("long")


def next_power_of_two(x: Column) -> Column:
    """The least power of two that is not below x; 1 for x <= 1."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1))))


def previous_power_of_two(x: Column) -> Column:
    """The largest power of two that is not above x; null for x < 1."""
    return F.when(x >= 1, F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x)) - 1))


def lowest_one(x: Column) -> Column:
    """Place of the lowest bit that is set; null for 0."""
    return F.when(x != 0, F.bit_count(x.bitwiseAND(-x) - 1))


def set_bit(x: Column, k: int) -> Column:
    return x.bitwiseOR(F.lit(1 << k))


def get_bit(x: Column, k: int) -> Column:
    return F.getbit(x, F.lit(k))


def combinations_up_to(n: int, k: int) -> int:
    """Sum of the binomials of n over 0 .. k."""
    return sum(comb(n, i) for i in range(k + 1))


def odometer(base: int, digits: int) -> list[tuple[int, ...]]:
    """All numbers of so many digits, counted up, least significant digit first."""
    return [tuple(k // base**d % base for d in range(digits)) for k in range(base**digits)]


__all__ = ["comb", "factorial", "is_power_of_two", "bit_length", "floor_log2", "to_binary", "from_binary", "next_power_of_two", "previous_power_of_two", "lowest_one", "set_bit", "get_bit", "combinations_up_to", "odometer"]
