"""Octants as columns ``lev INT, x0 .. x{D-1} BIGINT`` on a grid of 2^depth cells an axis, and expressions over them.

Everything is arithmetic that stays in generated code. A ``Grid`` names dimension and depth; its methods take an
optional prefix of the columns' names, so that both sides of a join can be told apart. Out-of-domain results are null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of a path, one character a level.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def shl(x: Column | int, n: Column | int) -> Column:
    """x * 2^n as a long, for any column n."""
    return F.call_function("shiftleft", _long(x), _int(n))


def shr(x: Column | int, n: Column | int) -> Column:
    return F.call_function("shiftright", _long(x), _int(n))


def _long(x: Column | int) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")


def _int(x: Column | int) -> Column:
    return x.cast("int") if isinstance(x, Column) else F.lit(x).cast("int")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def exterior_orientations(dim: int, highest_first: bool = True) -> list[int]:
    """The orientations of a cell's open faces but its inside, by the face's dimension; equal dimensions by number."""
    return sorted(range((1 << dim) - 1), key=lambda o: (-o.bit_count() if highest_first else o.bit_count(), o))


@dataclass(frozen=True)
class Grid:
    dim: int
    depth: int

    def __post_init__(self) -> None:
        if not (1 <= self.dim <= 4 and 1 <= self.depth <= 30):
            raise ValueError("dimension 1 to 4 and depth 1 to 30 are supported")

    @property
    def axes(self) -> list[str]:
        return [f"x{d}" for d in range(self.dim)]

    @property
    def keys(self) -> list[str]:
        return ["lev", *self.axes]

    @property
    def children(self) -> int:
        return 1 << self.dim

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("lev", T.IntegerType()), *(T.StructField(a, T.LongType()) for a in self.axes)])

    def x(self, p: str = "") -> list[Column]:
        return [F.col(f"{p}{a}") for a in self.axes]

    def lev(self, p: str = "") -> Column:
        return F.col(f"{p}lev")

    def row(self, lev: Column | int, xs: list[Column]) -> list[Column]:
        """The columns of an octant, named."""
        return [_int(lev).alias("lev"), *(_long(x).alias(a) for a, x in zip(self.axes, xs))]

    # extents
    def side(self, lev: Column | int) -> Column:
        return shl(1, F.lit(self.depth) - _int(lev))

    def mask(self, x: Column, lev: Column | int) -> Column:
        """x truncated to the grid of a level."""
        k = F.lit(self.depth) - _int(lev)
        return shl(shr(x, k), k)

    def lower(self, p: str = "") -> list[Column]:
        return [self.mask(x, self.lev(p)) for x in self.x(p)]

    def upper(self, p: str = "") -> list[Column]:
        return [x + self.side(self.lev(p)) for x in self.lower(p)]

    # numbers of children, and families
    def child_number(self, level: Column | int, p: str = "") -> Column:
        """The digit of the octant at a level: bit d is the level's bit of axis d."""
        k = F.lit(self.depth) - _int(level)
        return sum((shl(shr(x, k).bitwiseAND(F.lit(1).cast("long")), d) for d, x in enumerate(self.x(p))), F.lit(0).cast("long")).cast("int")

    def with_child_number(self, child: Column | int, p: str = "") -> list[Column]:
        """The octant with its last digit replaced; the root has none and stays."""
        k = F.lit(self.depth) - self.lev(p)
        own = [shl(shr(x, k + 1), k + 1) + shl(shr(_long(child), d).bitwiseAND(F.lit(1).cast("long")), k) for d, x in enumerate(self.x(p))]
        return self.row(self.lev(p), [F.when(self.lev(p) > 0, a).otherwise(x) for a, x in zip(own, self.x(p))])

    def child(self, number: Column | int, p: str = "") -> list[Column]:
        half = self.side(self.lev(p) + 1)
        return self.row(self.lev(p) + 1, [x + shr(_long(number), d).bitwiseAND(F.lit(1).cast("long")) * half for d, x in enumerate(self.lower(p))])

    def with_children(self, df: DataFrame, *keep: str) -> DataFrame:
        """Every octant's children; below the finest level there are none."""
        rows = df.filter(self.lev() < self.depth).select(*keep, *self.keys, F.explode(F.array(*map(F.lit, range(self.children)))).alias("_child"))
        return rows.select(*keep, *self.child(F.col("_child")))

    def ancestor(self, level: Column | int, p: str = "") -> list[Column]:
        return self.row(level, [self.mask(x, level) for x in self.x(p)])

    def parent(self, p: str = "") -> list[Column]:
        """The root is its own parent."""
        return self.ancestor(F.greatest(self.lev(p) - 1, F.lit(0)), p)

    def first_descendant(self, p: str = "") -> list[Column]:
        return self.row(self.depth, self.lower(p))

    def last_descendant(self, p: str = "") -> list[Column]:
        return self.row(self.depth, [x - 1 for x in self.upper(p)])

    def common_ancestor_depth(self, a: str, b: str) -> Column:
        """The level of the finest octant that holds both, no finer than either."""
        bits = [F.length(F.bin(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}")))) - F.when(F.col(f"{a}{x}") == F.col(f"{b}{x}"), 1).otherwise(0) for x in self.axes]
        worst = bits[0] if self.dim == 1 else F.greatest(*bits)
        return F.least(F.lit(self.depth) - worst, self.lev(a), self.lev(b)).cast("int")

    def path(self, p: str = "", root: bool = True) -> Column:
        """The digits from the root's (0) to the octant's own level, one character each. Paths sort like the Morton order, ancestors first."""
        digits = F.transform(F.sequence(F.lit(0 if root else 1), F.greatest(self.lev(p), F.lit(0 if root else 1))), lambda k: F.substring(F.lit(DIGITS), self.child_number(k, p) + 1, F.lit(1)))
        return F.array_join(digits, "") if root else F.when(self.lev(p) < 1, "").otherwise(F.array_join(digits, ""))

    def morton_key(self, p: str = "") -> Column:
        """All digits as one long, for at most 62 bits; ties of ancestor and descendant are told by the level."""
        if self.dim * self.depth > 62:
            raise ValueError("too many bits for a long: use path()")
        spread = [shl(shr(x, b).bitwiseAND(F.lit(1).cast("long")), b * self.dim + d) for d, x in enumerate(self.lower(p)) for b in range(self.depth)]
        return reduce(lambda a, b: a.bitwiseOR(b), spread)

    # neighbours
    def neighbour(self, offsets: list[int], p: str = "", boundary: bool = False) -> list[Column]:
        """The octant of the same level so many sides away; null beyond the domain (with ``boundary``, its upper faces belong to it)."""
        side, top = self.side(self.lev(p)), (1 << self.depth) + (1 if boundary else 0)
        xs = [x + side * k for x, k in zip(self.lower(p), offsets)]
        inside = all_of([(x >= 0) & (x < top) for x in xs])
        return [c.alias(n) for c, n in zip([F.when(inside, c) for c in (self.lev(p), *xs)], self.keys)]

    def offsets(self, own: bool = False) -> list[list[int]]:
        all_ = [[k // 3**d % 3 - 1 for d in range(self.dim)] for k in range(3**self.dim)]
        return [o for o in all_ if own or any(o)]

    def with_neighbours(self, df: DataFrame, *keep: str, own: bool = False, boundary: bool = False) -> DataFrame:
        """Every octant's up to 3^D - 1 neighbours of the same level (and itself) inside the domain."""
        shifts = F.array(*(F.array(*map(F.lit, o)) for o in self.offsets(own)))
        rows = df.select(*keep, *self.keys, F.explode(shifts).alias("_o"))
        side, top = self.side(self.lev()), (1 << self.depth) + (1 if boundary else 0)
        xs = [x + F.col("_o")[d] * side for d, x in enumerate(self.lower())]
        out = rows.select(*keep, *self.row(self.lev(), xs))
        return out.filter(all_of([(x >= 0) & (x < top) for x in self.x()]))

    # predicates
    def same(self, a: str, b: str) -> Column:
        return (self.lev(a) == self.lev(b)) & all_of([x == y for x, y in zip(self.lower(a), self.lower(b))])

    def is_ancestor(self, a: str, b: str) -> Column:
        """a is strictly coarser than b and holds it."""
        return (self.lev(a) < self.lev(b)) & all_of([x == self.mask(y, self.lev(a)) for x, y in zip(self.lower(a), self.x(b))])

    def precedes(self, a: str, b: str) -> Column:
        """a before b in Morton order, an ancestor before its descendants."""
        return self.path(a) < self.path(b)

    def is_root(self, p: str = "") -> Column:
        return self.lev(p) == 0

    def touches_boundary(self, p: str = "") -> Column:
        """The closed cell touches a face of the domain."""
        return any_of([(a == 0) | (b == 1 << self.depth) for a, b in zip(self.lower(p), self.upper(p))])

    def on_boundary(self, p: str = "") -> Column:
        """The anchor lies on a face of the domain."""
        return any_of([(x == 0) | (x == 1 << self.depth) for x in self.x(p)])

    def in_slice(self, axis: int, value: Column | int, p: str = "") -> Column:
        """The closed cell holds the plane."""
        v = _long(value)
        return (self.lower(p)[axis] <= v) & (v <= self.upper(p)[axis])

    # nodes and cells
    def aligned_axes(self, level: Column | int, p: str = "") -> Column:
        """How many axes have no bits below a level."""
        return sum((F.when(x == self.mask(x, level), 1).otherwise(0) for x in self.x(p)), F.lit(0)).cast("int")

    def first_hyperplane(self, level: Column | int, p: str = "") -> Column:
        """The first axis that is aligned to a level's grid, or the dimension."""
        return F.coalesce(*(F.when(x == self.mask(x, level), d) for d, x in enumerate(self.x(p))), F.lit(self.dim)).cast("int")

    def orientation(self, level: Column | int, p: str = "") -> Column:
        """The open cell that a point is in at a level: bit d is set if axis d runs through its volume."""
        return sum((F.when(x == self.mask(x, level), 0).otherwise(1 << d) for d, x in enumerate(self.x(p))), F.lit(0)).cast("int")

    def container_level(self, p: str = "") -> Column:
        """The level of the deepest octant that has the point strictly inside; -1 for points on the domain's faces."""
        zeros = [F.bit_count(x.bitwiseAND(-x) - 1) for x in self.x(p)]
        deepest = F.lit(self.depth) - 1 - (zeros[0] if self.dim == 1 else F.greatest(*zeros))
        return F.when(self.on_boundary(p), -1).otherwise(deepest).cast("int")

    def is_crossing(self, p: str = "") -> Column:
        """The node's open cell differs from the one it is in at the parent level."""
        return self.orientation(self.lev(p), p) != self.orientation(F.greatest(self.lev(p) - 1, F.lit(0)), p)

    def clamped(self, p: str = "") -> list[Column]:
        """Points on upper faces, moved into the last cell inside."""
        return [F.least(x, F.lit((1 << self.depth) - 1).cast("long")) for x in self.x(p)]

    def node_rank(self, cell: str, order: int, p: str = "") -> Column:
        """The lexicographic slot of a node in the element ``cell``."""
        side = self.side(self.lev(cell))
        return sum(((F.lit(order) - F.call_function("div", F.lit(order) * (a + side - x), side)) * (order + 1) ** d for d, (a, x) in enumerate(zip(self.lower(cell), self.x(p)))), F.lit(0).cast("long"))
