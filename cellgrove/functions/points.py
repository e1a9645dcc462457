"""Points as lists of double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = list[Column]


def add(a: Point, b: Point) -> Point:
    return [x + y for x, y in zip(a, b)]


def subtract(a: Point, b: Point) -> Point:
    return [x - y for x, y in zip(a, b)]


def scale(a: Point, k: Column | float) -> Point:
    return [x * k for x in a]


def divide(a: Point, k: Column | float) -> Point:
    return [x / k for x in a]


def dot(a: Point, b: Point) -> Column:
    return sum((x * y for x, y in zip(a, b)), F.lit(0.0))


def cross(a: Point, b: Point) -> Point:
    """Of three coordinates."""
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def magnitude(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def absolute(a: Point) -> Point:
    return [F.abs(x) for x in a]


def normalised(a: Point) -> Point:
    """Null for the zero vector."""
    m = magnitude(a)
    return [F.when(m > 0, x / m) for x in a]


def grid_to_domain(x: Column, cells: int, low: float, high: float) -> Column:
    """A grid coordinate on [0, cells] as a coordinate of the domain."""
    return F.lit(low) + x * ((high - low) / cells)


def domain_to_grid(x: Column, cells: int, low: float, high: float) -> Column:
    return (x - low) * (cells / (high - low))
