"""Dense rasters of trees: every cell centre of a regular grid with a value of the leaf that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.octant import Grid


def rasterise(tree: DataFrame, grid: Grid, level: int, value: str) -> DataFrame:
    """(i0 .., value) of 2^level cells an axis: an equi-join of each centre's ancestors with the leaves."""
    n, width = 1 << level, 1 << grid.depth - level
    cells = tree.sparkSession.range(n**grid.dim).select(*((F.expr(f"id div {n**d}") % n).cast("int").alias(f"i{d}") for d in range(grid.dim)))
    centres = cells.select("*", *((F.col(f"i{d}").cast("long") * width + width // 2).alias(f"c{d}") for d in range(grid.dim)), F.explode(F.sequence(F.lit(0), F.lit(grid.depth))).alias("l"))
    names = [f"i{d}" for d in range(grid.dim)]
    keyed = centres.select(*names, F.col("l").alias("lev"), *(grid.mask(F.col(f"c{d}"), F.col("l")).alias(f"x{d}") for d in range(grid.dim)))
    return keyed.join(tree.select(*dict.fromkeys([*grid.keys, value])), grid.keys).select(*names, value)


def rasterise_field(mesh, vector: DataFrame, level: int) -> DataFrame:
    """(i0 .., v) of 2^level cells an axis: a nodal field at cell centres, by the shape functions of the element that holds each."""
    from cellgrove.operators.elements import gather

    grid, order = mesh.grid, mesh.order
    names = [f"i{d}" for d in range(grid.dim)]
    width = 1 << grid.depth - level
    places = rasterise(mesh.tree, grid, level, "elem").join(mesh.tree, "elem")
    local = [(F.col(f"i{d}").cast("long") * width + width // 2 - x) / grid.side(grid.lev()) for d, x in enumerate(grid.x())]
    values = gather(mesh, vector).select("elem", "slot", "v")
    joined = places.select("elem", *names, *(t.alias(f"t{d}") for d, t in enumerate(local))).join(values, "elem")

    def shape(t, i):
        """The value at t of the polynomial that is 1 at node i: a product over the other nodes."""
        out = F.lit(1.0)
        for k in range(order + 1):
            out = out * F.when(i == k, 1.0).otherwise((t * order - k) / (i - k))
        return out

    weight = F.lit(1.0)
    for d in range(grid.dim):
        weight = weight * shape(F.col(f"t{d}"), F.call_function("div", F.col("slot"), F.lit((order + 1) ** d)) % (order + 1))
    return joined.groupBy(*names).agg(F.sum(weight * F.col("v")).alias("v"))
