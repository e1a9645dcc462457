"""Space-filling curves as column expressions: Morton by shifts, Hilbert by a fold over levels with literal tables.

A Hilbert curve visits the children of its root in Gray code order. The curve inside the child at each place is the
root's under a signed permutation of the axes. Only those permutations are stated; the states of the curve and their
tables are the closure under composition (4, 24 and 192 states in 2, 3 and 4 dimensions).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgrove.functions.octant import DIGITS, Grid

# For each place on the curve, where each axis goes and which axes are then flipped.
TURNS = {
    2: [("10", 0), ("01", 0), ("01", 0), ("10", 3)],
    3: [("210", 0), ("021", 0), ("201", 0), ("102", 3), ("102", 3), ("201", 6), ("021", 6), ("210", 5)],
    4: [("3210", 0), ("0321", 0), ("3201", 0), ("1032", 3), ("3102", 3), ("2031", 6), ("3021", 6), ("2103", 5), ("2103", 5), ("3021", 12), ("2031", 12), ("3102", 15), ("1032", 15), ("3201", 10), ("0321", 10), ("3210", 9)],
}


def _apply(turn: tuple[tuple[int, ...], int], child: int) -> int:
    axes, flip = turn
    return sum((child >> b & 1) << a for b, a in enumerate(axes)) ^ flip


@lru_cache
def hilbert_tables(dim: int) -> tuple[list[list[int]], list[list[int]]]:
    """(place of each child, next state of each child), by state; state 0 is the root's."""
    turns = [(tuple(map(int, a)), f) for a, f in TURNS[dim]]
    n = 1 << dim
    states = [(tuple(range(dim)), 0)]
    number = {states[0]: 0}
    place, nxt = [], []
    for s in states:
        place.append([0] * n)
        nxt.append([0] * n)
        for i in range(n):
            child = _apply(s, i ^ i >> 1)
            axes, flip = turns[i]
            after = (tuple(s[0][a] for a in axes), _apply(s, flip) if flip else s[1])
            if after not in number:
                number[after] = len(states)
                states.append(after)
            place[-1][child], nxt[-1][child] = i, number[after]
    return place, nxt


def _fold(grid: Grid, start: Column, step, p: str) -> Column:
    """Folds ``step(acc, place)`` over the levels 1 .. lev of the octant, following the curve's state."""
    place, nxt = hilbert_tables(grid.dim)
    n = grid.children
    places, states = (F.array(*(F.lit(v).cast("int") for row in t for v in row)) for t in (place, nxt))

    def one(acc: Column, level: Column) -> Column:
        at = acc["s"] * n + grid.child_number(level, p)
        return F.struct(step(acc["k"], F.get(places, at)).alias("k"), F.get(states, at).alias("s"))

    levels = F.when(grid.lev(p) > 0, F.sequence(F.lit(1), F.greatest(grid.lev(p), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, F.struct(start.alias("k"), F.lit(0).cast("int").alias("s")), one, lambda acc: acc["k"])


def hilbert_key(grid: Grid, p: str = "") -> Column:
    """Places along the curve as one long, padded to the full depth; for at most 62 bits."""
    if grid.dim * grid.depth > 62:
        raise ValueError("too many bits for a long: use hilbert_path()")
    key = _fold(grid, F.lit(0).cast("long"), lambda k, i: k * grid.children + i, p)
    return F.call_function("shiftleft", key, (F.lit(grid.depth) - grid.lev(p)) * grid.dim)


def hilbert_path(grid: Grid, p: str = "") -> Column:
    """Places along the curve, one character a level; sorts like the curve, ancestors first."""
    return _fold(grid, F.lit(""), lambda k, i: F.concat(k, F.substring(F.lit(DIGITS), i + 1, F.lit(1))), p)


def sort_path(grid: Grid, curve: str = "morton", p: str = "") -> Column:
    return grid.path(p, root=False) if curve == "morton" else hilbert_path(grid, p)


def sort_key(grid: Grid, curve: str = "morton", p: str = "") -> Column:
    """One long that sorts like ``sort_path``, where digits and level fit (2-D to depth 29, 3-D to 19, 4-D to 14); else the path."""
    if grid.dim * grid.depth + 5 > 63 or grid.depth > 31:
        return sort_path(grid, curve, p)
    key = grid.morton_key(p) if curve == "morton" else hilbert_key(grid, p)
    return key * 32 + grid.lev(p)
