"""Trees, nodes and vectors on disk, and VTU files for viewers.

Parquet is the form to keep: sorted by the curve within range partitions, so that row groups cover compact regions and
scans of a box read few of them. The readers and writers take any path that Spark can reach.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.functions.octant import DIGITS, Grid


def write_tree(tree: DataFrame, grid: Grid, path: str, by_level: bool = False) -> None:
    ordered = tree.withColumn("_path", grid.path(root=False)).repartitionByRange("_path").sortWithinPartitions("_path").drop("_path")
    (ordered.write.partitionBy("lev") if by_level else ordered.write).parquet(path)


def read_tree(spark: SparkSession, grid: Grid, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("lev").cast("int").alias("lev"), *(F.col(a).cast("long").alias(a) for a in grid.axes))


def write_vector(vector: DataFrame, path: str) -> None:
    vector.repartitionByRange("node_id").sortWithinPartitions("node_id").write.parquet(path)


def read_vectors(spark: SparkSession, *paths: str) -> DataFrame:
    """One vector, or several as v0, v1, .. of one."""
    if len(paths) == 1:
        return spark.read.parquet(paths[0])
    out = None
    for i, path in enumerate(paths):
        one = spark.read.parquet(path).select("node_id", F.col("v").alias(f"v{i}"))
        out = one if out is None else out.join(one, "node_id")
    return out


def as_text(tree: DataFrame, grid: Grid) -> DataFrame:
    """One line an octant: level, coordinates and path."""
    return tree.select(F.format_string("%d " + "%d " * grid.dim + "%s", F.col("lev"), *grid.x(), grid.path()).alias("value"))


def box_ranges(grid: Grid, low: list[int], high: list[int], most: int = 64) -> list[tuple[str, str]]:
    """Ranges [from, to) of Morton paths that cover the closed box, at most about ``most``: a filter on a stored path that row groups can be pruned by."""
    out: list[tuple[str, str]] = []
    todo = [("", [0] * grid.dim, 0)]
    while todo:
        path, at, lev = todo.pop(0)
        width = 1 << grid.depth - lev
        if any(a > h or a + width <= lo for a, lo, h in zip(at, low, high)):
            continue
        if lev == grid.depth or all(lo <= a and a + width - 1 <= h for a, lo, h in zip(at, low, high)) or len(todo) + len(out) >= most:
            out.append((path, path + "~"))
            continue
        half = width >> 1
        todo += [(path + DIGITS[c], [a + half * (c >> d & 1) for d, a in enumerate(at)], lev + 1) for c in range(grid.children)]
    return sorted(out)


def in_ranges(path: str, ranges: list[tuple[str, str]]):
    test = F.lit(False)
    for a, b in ranges:
        test = test | ((F.col(path) >= a) & (F.col(path) < b))
    return test


def _data(kind: str, name: str, values: np.ndarray, encoding: str, components: int = 1) -> str:
    head = f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{components}"'
    if encoding == "ascii":
        return f'{head} format="ascii">{" ".join(map(str, values.ravel().tolist()))}</DataArray>'
    raw = np.ascontiguousarray(values).tobytes()
    if encoding == "binary":
        body = base64.b64encode(np.uint32(len(raw)).tobytes() + raw)
    else:
        block = 1 << 15
        parts = [raw[i : i + block] for i in range(0, len(raw), block)]
        packed = [zlib.compress(x) for x in parts]
        sizes = np.array([len(parts), block if parts else 0, len(parts[-1]) % block if parts else 0, *map(len, packed)], np.uint32)
        body = base64.b64encode(sizes.tobytes()) + base64.b64encode(b"".join(packed))
    return f'{head} format="binary">{body.decode()}</DataArray>'


def _piece(lev: np.ndarray, xs: np.ndarray, depth: int, part: int, encoding: str) -> str:
    """An unstructured grid of hexahedra (quadrilaterals in 2-D), with level and part of each cell."""
    n, dim = xs.shape
    # the order of a cell's corners as viewers want it
    corners = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1], [0, 1, 1]])[: 1 << dim, :dim]
    side = np.exp2(depth - lev)
    points = np.zeros((n * len(corners), 3), np.float32)
    points[:, :dim] = ((xs[:, None, :] + corners[None] * side[:, None, None]) / 2.0**depth).reshape(-1, dim)
    ids = np.arange(n * len(corners), dtype=np.uint32)
    compressor = ' compressor="vtkZLibDataCompressor"' if encoding == "zlib" else ""
    return "".join(
        [
            f'<?xml version="1.0"?><VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian"{compressor}><UnstructuredGrid><Piece NumberOfPoints="{len(points)}" NumberOfCells="{n}">',
            "<Points>" + _data("Float32", "Position", points, encoding, 3) + "</Points>",
            "<Cells>" + _data("UInt32", "connectivity", ids, encoding) + _data("UInt32", "offsets", np.arange(1, n + 1, dtype=np.uint32) * len(corners), encoding) + _data("UInt8", "types", np.full(n, 12 if dim == 3 else 9, np.uint8), encoding) + "</Cells>",
            "<CellData>" + _data("UInt32", "mpi_rank", np.full(n, part, np.uint32), encoding) + _data("UInt32", "cell_level", lev.astype(np.uint32), encoding) + "</CellData>",
            "</Piece></UnstructuredGrid></VTKFile>",
        ]
    )


def vtu_pieces(partitioned: DataFrame, grid: Grid, encoding: str = "zlib", cells: int = 50_000) -> DataFrame:
    """(name, body): VTU files of every part, in pieces of at most ``cells``; ``encoding`` is ascii, binary or zlib."""
    if grid.dim not in (2, 3):
        raise ValueError("viewers take two or three dimensions: slice the tree first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        made: dict[int, int] = {}

        def flush(part: int) -> pa.RecordBatch:
            rows = np.concatenate(held.pop(part))
            made[part] = made.get(part, -1) + 1
            return pa.RecordBatch.from_arrays([pa.array([f"part{part:05d}-{int(rows[0, -1])}-{made[part]:04d}.vtu"]), pa.array([_piece(rows[:, 1], rows[:, 2:-1], grid.depth, part, encoding)])], ["name", "body"])

        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            for part in np.unique(table[:, 0]):
                held.setdefault(int(part), []).append(table[table[:, 0] == part])
                if sum(map(len, held[int(part)])) >= cells:
                    yield flush(int(part))
        for part in list(held):
            yield flush(part)

    rows = partitioned.select("part", *grid.keys).repartitionByRange("part", grid.path(root=False)).withColumn("_task", F.spark_partition_id())
    return rows.mapInArrow(run, "name string, body string")


def write_vtu(partitioned: DataFrame, grid: Grid, path: str, encoding: str = "zlib") -> list[str]:
    """Writes the pieces as text, one row a file's body, under ``path``, and gives the names for ``pvtu_index``; ``partitioned`` has the part of each octant."""
    pieces = vtu_pieces(partitioned, grid, encoding)
    pieces.write.partitionBy("name").text(path)
    names = partitioned.sparkSession.read.text(path).select("name").distinct().orderBy("name")
    return [r.name for r in names.toLocalIterator()]


def pvtu_index(names: list[str]) -> str:
    """The index file over pieces."""
    array = lambda kind, name, n=1: f'<PDataArray type="{kind}" Name="{name}" NumberOfComponents="{n}"/>'
    pieces = "".join(f'<Piece Source="{n}"/>' for n in names)
    return f'<?xml version="1.0"?><VTKFile type="PUnstructuredGrid" version="0.1" byte_order="LittleEndian"><PUnstructuredGrid GhostLevel="0"><PPoints>{array("Float32", "Position", 3)}</PPoints><PCellData>{array("UInt32", "mpi_rank")}{array("UInt32", "cell_level")}</PCellData>{pieces}</PUnstructuredGrid></VTKFile>'


