"""Finite elements on a mesh of an adaptive tree: reference element, incidence with hanging nodes, operators, and conjugate gradients.

A mesh is a tree, its unique nodes with ids, and a relation Q(elem, slot, node_id, w): the value of an element's slot is
the weighted sum of its nodes' values, where a hanging slot takes its parent's nodes with interpolation weights. An
operator is y = Q' A Q x with the element kernel A, so constants are kept and symmetric kernels stay symmetric.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.functions.octant import Grid
from cellgrove.operators import vectors
from cellgrove.operators.nodes import element_nodes, unique_nodes, with_node_ids
from cellgrove.plans.work import materialise


def lagrange(order: int, t: np.ndarray) -> np.ndarray:
    """Values at t of the polynomials that are 1 at one of the order + 1 uniform nodes of [0, 1] and 0 at the others."""
    nodes = np.arange(order + 1) / order
    return np.stack([np.prod([(t - b) / (a - b) for b in nodes if b != a], axis=0) * np.ones_like(t) for a in nodes], -1)


def lagrange_slopes(order: int, t: np.ndarray) -> np.ndarray:
    nodes = np.arange(order + 1) / order
    out = np.zeros((len(t), order + 1))
    for i, a in enumerate(nodes):
        for j, b in enumerate(nodes):
            if j != i:
                rest = [(t - c) / (a - c) for k, c in enumerate(nodes) if k not in (i, j)]
                out[:, i] += np.prod(rest, axis=0) / (a - b) if rest else np.full(len(t), 1 / (a - b))
    return out


def kronecker(factors: list[np.ndarray]) -> np.ndarray:
    """Of one matrix an axis, axis 0 varying fastest."""
    return reduce(lambda a, b: np.kron(b, a), factors)


@lru_cache
def half_interpolation(order: int, bit: int) -> np.ndarray:
    """From an interval's nodes to those of its lower (0) or upper (1) half."""
    return lagrange(order, (bit + np.arange(order + 1) / order) / 2)


@lru_cache
def interpolation(order: int, dim: int, child: int) -> np.ndarray:
    """From an element's nodes to those of its child."""
    return kronecker([half_interpolation(order, child >> d & 1) for d in range(dim)])


@dataclass(frozen=True)
class ReferenceElement:
    """Matrices of the unit interval: quadrature, values and slopes there, mass and stiffness."""

    dim: int
    order: int

    @property
    def gauss(self) -> tuple[np.ndarray, np.ndarray]:
        x, w = np.polynomial.legendre.leggauss(self.order + 1)
        return (x + 1) / 2, w / 2

    @property
    def lobatto(self) -> np.ndarray:
        """Gauss-Lobatto-Legendre points of [0, 1]."""
        inner = np.polynomial.legendre.Legendre.basis(self.order).deriv().roots() if self.order > 1 else np.zeros(0)
        return (np.concatenate([[-1], np.sort(inner.real), [1]]) + 1) / 2

    @property
    def values(self) -> np.ndarray:
        return lagrange(self.order, self.gauss[0])

    @property
    def slopes(self) -> np.ndarray:
        return lagrange_slopes(self.order, self.gauss[0])

    @property
    def mass_1d(self) -> np.ndarray:
        return self.values.T @ (self.gauss[1][:, None] * self.values)

    @property
    def stiffness_1d(self) -> np.ndarray:
        return self.slopes.T @ (self.gauss[1][:, None] * self.slopes)

    def mass(self) -> np.ndarray:
        """Of the unit cube; an element of side h has h^D times it."""
        return kronecker([self.mass_1d] * self.dim)

    def stiffness(self) -> np.ndarray:
        """Of the unit cube; an element of side h has h^(D-2) times it."""
        return sum(kronecker([self.stiffness_1d if e == d else self.mass_1d for e in range(self.dim)]) for d in range(self.dim))

    def contract(self, matrices: list[np.ndarray], u: np.ndarray) -> np.ndarray:
        """The Kronecker product of ``matrices`` times each row of ``u``, one axis at a time: O(p^(D+1)) instead of O(p^2D)."""
        out = u.reshape(len(u), *([self.order + 1] * self.dim))
        for d, m in enumerate(matrices):
            axis = self.dim - d  # axis 0 varies fastest, so it is last
            out = np.moveaxis(np.tensordot(m, out, (1, axis)), 0, axis)
        return out.reshape(len(u), -1)


Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]  # values by element and slot, sides -> values


def identity_kernel(u: np.ndarray, side: np.ndarray) -> np.ndarray:
    return u


def mass_kernel(dim: int, order: int) -> Kernel:
    ref = ReferenceElement(dim, order)
    m = [ref.mass_1d] * dim
    return lambda u, side: ref.contract(m, u) * (side**dim)[:, None]


def stiffness_kernel(dim: int, order: int) -> Kernel:
    ref = ReferenceElement(dim, order)
    parts = [[ref.stiffness_1d if e == d else ref.mass_1d for e in range(dim)] for d in range(dim)]
    return lambda u, side: sum(ref.contract(p, u) for p in parts) * (side ** (dim - 2.0))[:, None]


@dataclass
class Mesh:
    """tree: elem, lev, x..; nodes: node_id, lev, x.., is_bdry; incidence: elem, lev, slot, node_id, w."""

    grid: Grid
    order: int
    tree: DataFrame
    nodes: DataFrame
    incidence: DataFrame

    def sizes(self) -> dict[str, int]:
        return {"elements": self.tree.count(), "nodes": self.nodes.count(), "boundary": self.nodes.filter("is_bdry").count()}

    def elemental(self, value: float) -> DataFrame:
        return self.tree.select("elem", F.lit(float(value)).alias("v"))

    def coordinates(self) -> list:
        """Expressions of the nodes' coordinates in [0, 1]."""
        return [x / float(1 << self.grid.depth) for x in self.grid.x()]

    def boundary(self) -> DataFrame:
        return self.nodes.filter("is_bdry").select("node_id")


def incidence(tree: DataFrame, nodes: DataFrame, grid: Grid, order: int) -> DataFrame:
    """(elem, lev, slot, node_id, w) of every element: its own nodes, or for hanging slots the parent's with their weights."""
    own = element_nodes(tree, grid, order, "elem", *(f"e_{a}" for a in grid.axes)) if "e_x0" in tree.columns else element_nodes(tree.select("*", *(F.col(a).alias(f"e_{a}") for a in grid.axes)), grid, order, "elem", *(f"e_{a}" for a in grid.axes))
    placed = own.join(nodes.select(*grid.axes, "node_id"), grid.axes, "left")
    placed = materialise(placed.select("elem", "lev", "slot", "node_id", *(F.col(f"e_{a}").alias(a) for a in grid.axes)))
    direct = placed.filter("node_id is not null").select("elem", "lev", "slot", "node_id", F.lit(1.0).alias("w"))
    rows = []
    for child in range(grid.children):
        m = interpolation(order, grid.dim, child)
        rows += [(child, int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(np.abs(m) > 1e-14))]
    weights = tree.sparkSession.createDataFrame(rows, "child int, slot int, parent_slot int, w double")  # bounded by order and dimension
    hanging = placed.filter("node_id is null").drop("node_id").withColumn("child", grid.child_number(grid.lev()))
    spread = hanging.join(F.broadcast(weights), ["child", "slot"])
    up = spread.lev - 1
    side = grid.side(up)
    xs = [grid.mask(x, up) + F.call_function("div", side * (F.call_function("div", F.col("parent_slot"), F.lit((order + 1) ** d)) % (order + 1)), F.lit(order)) for d, x in enumerate(grid.x())]
    spread = spread.select("elem", "lev", "slot", "w", *(x.cast("long").alias(f"p{d}") for d, x in enumerate(xs)))
    found = spread.join(nodes.select(*(F.col(a).alias(f"p{d}") for d, a in enumerate(grid.axes)), "node_id"), [f"p{d}" for d in range(grid.dim)])
    return direct.unionByName(found.select("elem", "lev", "slot", "node_id", "w"))


def build_mesh(tree: DataFrame, grid: Grid, order: int) -> Mesh:
    """Nodes, ids, boundary marks and incidence of a balanced complete tree."""
    from cellgrove.operators.order import with_rank

    elements = materialise(with_rank(tree.select(*grid.keys), grid, "elem").drop("part"))
    nodes = materialise(with_node_ids(unique_nodes(elements, grid, order), grid).withColumn("is_bdry", grid.on_boundary()))
    return Mesh(grid, order, elements, nodes, materialise(incidence(elements, nodes, grid, order)))


def uniform_mesh(spark: SparkSession, grid: Grid, level: int, order: int) -> Mesh:
    from cellgrove.sources.generators import uniform_tree

    return build_mesh(uniform_tree(spark, grid, level), grid, order)


def function_mesh(spark: SparkSession, grid: Grid, f: Callable[[np.ndarray], np.ndarray], order: int, tolerance: float, leaf_depth: int | None = None) -> Mesh:
    """A balanced mesh that resolves ``f``."""
    from cellgrove.operators.tree import balance
    from cellgrove.sources.generators import refine_by_function

    return build_mesh(balance(refine_by_function(spark, grid, f, order, tolerance, leaf_depth), grid, constructed=True), grid, order)


def gather(mesh: Mesh, x: DataFrame) -> DataFrame:
    """(elem, lev, slot, v): the elements' own values."""
    return mesh.incidence.join(x.select("node_id", "v"), "node_id").groupBy("elem", "lev", "slot").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def apply_operator(mesh: Mesh, x: DataFrame, kernel: Kernel | None, before: Callable[[DataFrame], DataFrame] | None = None, after: Callable[[DataFrame], DataFrame] | None = None, compat_backinterp: bool = False) -> DataFrame:
    """y = Q' A Q x as (node_id, v). ``kernel`` None is the identity and needs no Python. ``before`` and ``after`` change the vectors.

    With ``compat_backinterp``, results of a hanging slot reach only those parent nodes whose slot of the same number hangs as
    well; totals are then not kept, and the operator is not symmetric.
    """
    x = before(x) if before else x
    own = gather(mesh, x)
    if kernel is not None:
        slots = (mesh.order + 1) ** mesh.grid.dim
        scale = float(1 << mesh.grid.depth)
        depth = mesh.grid.depth
        groups = own.groupBy("elem", "lev").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "v"))), lambda s: s["v"]).alias("u"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, slots)
                y = kernel(u, np.exp2(depth - batch.column(1).to_numpy()) / scale)
                offsets = pa.array(np.arange(len(y) + 1) * slots, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(y).ravel()))], ["elem", "y"])

        own = groups.mapInArrow(run, "elem long, y array<double>").select("elem", F.posexplode("y").alias("slot", "v"))
    q = mesh.incidence.select("elem", "slot", "node_id", "w")
    if compat_backinterp:
        q = _compat(mesh)
    y = q.join(own.select("elem", "slot", "v"), ["elem", "slot"]).groupBy("node_id").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return after(y) if after else y


def _compat(mesh: Mesh) -> DataFrame:
    """The incidence for scattering where a hanging slot's part for a parent slot counts only if the element's slot of that number hangs too."""
    grid, order = mesh.grid, mesh.order
    hangs = mesh.incidence.groupBy("elem", "slot").agg(F.min("w").alias("lw"), F.count("*").alias("n")).filter("n > 1 or lw < 1").select("elem", F.col("slot").alias("parent_slot"))
    parents = mesh.tree.select("elem", "lev", *((F.call_function("div", grid.mask(x, grid.lev() - 1), F.lit(1))).alias(a) for a, x in zip(grid.axes, grid.x())))
    side = grid.side(grid.lev() - 1)
    slots = parents.select("elem", "lev", *grid.axes, F.explode(F.sequence(F.lit(0), F.lit((order + 1) ** grid.dim - 1))).alias("parent_slot"))
    xs = [x + F.call_function("div", side * (F.call_function("div", F.col("parent_slot"), F.lit((order + 1) ** d)) % (order + 1)), F.lit(order)) for d, x in enumerate(grid.x())]
    places = slots.select("elem", "parent_slot", *(x.cast("long").alias(a) for a, x in zip(grid.axes, xs))).join(mesh.nodes.select(*grid.axes, "node_id"), grid.axes).select("elem", "parent_slot", "node_id")
    allowed = places.join(hangs, ["elem", "parent_slot"]).select("elem", "node_id").distinct()
    q = mesh.incidence
    hanging_slots = q.join(hangs.withColumnRenamed("parent_slot", "slot"), ["elem", "slot"], "left_semi")
    direct = q.join(hangs.withColumnRenamed("parent_slot", "slot"), ["elem", "slot"], "left_anti")
    return direct.select("elem", "slot", "node_id", "w").unionByName(hanging_slots.join(allowed, ["elem", "node_id"], "left_semi").select("elem", "slot", "node_id", "w"))


def assembled(mesh: Mesh, matrix: np.ndarray, power: float) -> DataFrame:
    """(row, col, val) of the whole operator, for an element matrix that scales with side^power."""
    rows = [(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    kernel = mesh.incidence.sparkSession.createDataFrame(rows, "slot int, other int, a double")  # bounded by order and dimension
    left = mesh.incidence.select("elem", "lev", "slot", F.col("node_id").alias("row"), F.col("w").alias("wr"))
    right = mesh.incidence.select("elem", F.col("slot").alias("other"), F.col("node_id").alias("col"), F.col("w").alias("wc"))
    scale = F.pow(F.lit(0.5), F.col("lev") * power)
    return left.join(F.broadcast(kernel), "slot").join(right, ["elem", "other"]).groupBy("row", "col").agg(F.sum(F.col("wr") * F.col("a") * scale * F.col("wc")).alias("val"))


def zero_boundary(mesh: Mesh) -> Callable[[DataFrame], DataFrame]:
    """Dirichlet: values on the boundary become 0."""
    return lambda x: x.join(mesh.boundary().withColumn("_b", F.lit(True)), "node_id", "left").select("node_id", F.when(F.col("_b"), 0.0).otherwise(F.col("v")).alias("v"))


class HeatStiffness:
    """The Laplacian with zero boundary values, as an operator."""

    def __init__(self, mesh: Mesh):
        self.mesh, self.kernel, self.clear = mesh, stiffness_kernel(mesh.grid.dim, mesh.order), zero_boundary(mesh)

    def __call__(self, x: DataFrame) -> DataFrame:
        return apply_operator(self.mesh, x, self.kernel, self.clear, self.clear)


class HeatRightSide:
    """The mass operator on a forcing term, zero on the boundary."""

    def __init__(self, mesh: Mesh):
        self.mesh, self.kernel, self.clear = mesh, mass_kernel(mesh.grid.dim, mesh.order), zero_boundary(mesh)

    def __call__(self, f: DataFrame) -> DataFrame:
        return apply_operator(self.mesh, f, self.kernel, None, self.clear)


def conjugate_gradients(operator: Callable[[DataFrame], DataFrame], b: DataFrame, tolerance: float = 1e-6, most: int = 1000) -> tuple[DataFrame, int, float, bool]:
    """Solves A x = b from x = 0: (x, iterations, the last residual's largest entry over b's, converged). Vectors are tables of each step; only sums come to the driver."""
    state = materialise(b.select("node_id", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("p")))
    first = state.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.max(F.abs("r")).alias("top")).first()
    rr, top, residual = first.rr or 0.0, first.top or 0.0, 1.0
    if not top:
        return state.select("node_id", F.col("x").alias("v")), 0, 0.0, True
    for step in range(1, most + 1):
        q = operator(state.select("node_id", F.col("p").alias("v")))
        now = materialise(state.join(q.withColumnRenamed("v", "q"), "node_id", "left").fillna(0.0, ["q"]))
        pq = now.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not pq:
            return state.select("node_id", F.col("x").alias("v")), step, residual, False
        alpha = rr / pq
        now = materialise(now.select("node_id", (F.col("x") + F.col("p") * alpha).alias("x"), (F.col("r") - F.col("q") * alpha).alias("r"), "p"))
        sums = now.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.max(F.abs("r")).alias("top")).first()
        residual, beta, rr = sums.top / top, sums.rr / rr, sums.rr
        state = now.select("node_id", "x", "r", (F.col("r") + F.col("p") * beta).alias("p"))
        if residual <= tolerance:
            return state.select("node_id", F.col("x").alias("v")), step, residual, True
    return state.select("node_id", F.col("x").alias("v")), most, residual, False


__all__ = ["Mesh", "ReferenceElement", "apply_operator", "assembled", "build_mesh", "conjugate_gradients", "function_mesh", "gather", "incidence", "interpolation", "uniform_mesh", "vectors", "HeatStiffness", "HeatRightSide"]
