"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are 64-bit majority votes over the XXH64 of word shingles. Equal fingerprints are folded first. Two
fingerprints that differ in at most ``budget`` bits agree in one of ``budget + 1`` blocks of bits,
so for each block a trie is laid out whose first levels are that block: only node pairs
on the diagonal survive there, which makes the subtrees below independent groups. In a group, pairs of trie nodes are
walked together from the root, a level at a time: the differing bits add up, a pair above the budget is pruned, and the
two leaves of a surviving pair are linked. A group keeps a spanning forest of its links, no list of pairs.

A group with more than ``GROUP`` fingerprints is laid out again by the blocks of its remaining bits, which every link in
it must also agree in, until groups are small; no link is lost and no task gets an unbounded group. Components are found
by alternating large-star and small-star steps over tables in the shared folder; nothing of them reaches the driver.

Defined results: null texts and texts without words have fingerprint 0 and are linked with one another like any other;
rows with the same id and text are one vertex; the component is the smallest non-null id reachable (null if all are
null). Extra columns pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import small_batches, texts_of, written

BITS, BUDGET, SHINGLE = 64, 4, 4
GROUP = 1024
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the hashes of the shingles, repeats included."""
    words = text.translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        votes += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` without ``text``, with the fingerprint as a long in ``name``."""
    small_batches(df.sparkSession)
    rest = df.drop(text)
    keep = [df.columns.index(c) for c in rest.columns]
    at = df.columns.index(text)
    schema = rest.withColumn(name, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in texts_of(batch.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(values)], schema.names)

    return df.mapInArrow(run, schema)


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """Bits dealt into so many blocks: (first bit, bits) of each."""
    edge = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def trie_links(values: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (place, place of its root), of the links among distinct ``values``: the self-join of their binary trie.

    Nodes of a level are runs of the sorted values. Each step takes every surviving pair of nodes to the pairs of their
    children; children on different bits add one to the differences. Pairs with few leaves are compared leaf by leaf.
    """
    order = np.argsort(values.view(np.uint64), kind="stable")
    v = values.view(np.uint64)[order]
    n = len(v)
    root = np.arange(n)

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            y = root[x]
            z = root[y]
            if (y == z).all():
                return y
            root[x] = z

    def link(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = find(a), find(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))

    def leaves(pairs: np.ndarray) -> None:
        """Compares all leaves of node pairs that are small, a slice of them at a time."""
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        for i in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 20))) + 1):
            p, s = pairs[i], sizes[i]
            which = np.repeat(np.arange(len(i)), s)
            k = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
            wide = (p[:, 3] - p[:, 2])[which]
            a, b = p[which, 0] + k // wide, p[which, 2] + k % wide
            near = (a < b) & (np.bitwise_count(v[a] ^ v[b]) <= budget)
            link(a[near], b[near])

    pairs = np.array([[0, n, 0, n, 0]], np.int64)  # begin and end of either node, differing bits
    for level in range(BITS):
        if not len(pairs):
            break
        small = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 64) if level else np.zeros(1, bool)
        leaves(pairs[small])
        pairs = pairs[~small]
        bit = np.uint64(1) << np.uint64(BITS - 1 - level)
        ones = np.concatenate([[0], np.cumsum((v & bit) != 0)])
        half = lambda lo, hi: hi - (ones[hi] - ones[lo])  # noqa: E731  where the ones of a node begin
        a0, a1, b0, b1, d = pairs.T
        am, bm = half(a0, a1), half(b0, b1)
        same = (a0 == b0) & (a1 == b1)
        nxt = [np.stack(x, 1) for x in ((a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1))]
        nxt.append(np.stack((am, a1, b0, bm, d + 1), 1)[~same])
        pairs = np.concatenate(nxt)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget)]
    leaves(pairs)
    ends = find(np.arange(n))
    out = np.flatnonzero(ends != np.arange(n))
    return order[out], order[ends[out]]


def _group_links(groups: DataFrame, budget: int) -> DataFrame:
    """(a, b): the forests of all groups; ``groups`` has g and fp and at most ``GROUP`` rows a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(parts: list[np.ndarray]) -> pa.RecordBatch:
            v = np.concatenate(parts)
            a, b = trie_links(v, budget)
            return pa.RecordBatch.from_arrays([pa.array(v[a]), pa.array(v[b])], ["a", "b"])

        at, parts = None, []
        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False)
            for i in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1):
                if not len(i):
                    continue
                if parts and g[i[0]] != at:
                    yield forest(parts)
                    parts = []
                at = g[i[0]]
                parts.append(fp[i])
        if parts:
            yield forest(parts)

    return groups.repartition("g").sortWithinPartitions("g").select("g", "fp").mapInArrow(run, "a long, b long")


def _open_cuts(taken: int, parts: int) -> list[int]:
    """The bits that are not in ``taken``, dealt into ``parts`` masks."""
    free = [i for i in range(BITS) if not taken >> i & 1]
    return [sum(1 << i for i in free[a : a + n]) for a, n in _cuts(len(free), parts)]


def _lay(now: DataFrame, budget: int) -> DataFrame:
    """Every row (g, fp, taken) once for each block of its open bits: the new g tells group, block and the block's bits."""

    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, fp, taken = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            masks, which = np.unique(taken, return_inverse=True)
            cuts = np.array([_open_cuts(int(m), budget + 1) for m in masks], np.uint64).reshape(-1, budget + 1)
            for part in range(budget + 1):
                mask = cuts[which, part]
                key = mix(mix(mix(g + np.uint64(part + 1)) ^ mask) ^ fp & mask)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, fp, taken | mask)], ["g", "fp", "taken"])

    return now.select("g", "fp", "taken").mapInArrow(run, "g long, fp long, taken long")


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): links that join the same fingerprints as all links within ``budget`` bits would. ``distinct`` has the one column fp."""
    zero = F.lit(0).cast("long")
    now, out = distinct.select(zero.alias("g"), "fp", zero.alias("taken")), None
    while True:
        laid = written(_lay(now, budget))
        sizes = written(laid.groupBy("g").count().filter("count > 1"))
        found = written(_group_links(laid.join(sizes.filter(f"count <= {GROUP}").select("g"), "g", "left_semi"), budget))
        out = found if out is None else out.unionByName(found)
        large = sizes.filter(f"count > {GROUP}").select("g")
        if large.isEmpty():
            return out.distinct()
        now = laid.join(large, "g", "left_semi")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``, by alternating large-star and small-star; ``root`` is the smallest node reachable. Each step is a table in the shared folder, and joins are of tables, so that adaptive execution can split a node with very many neighbours."""

    def hung(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        return least, pairs.join(least, "u")

    def digest(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())

    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = digest(now)
    while True:
        # large star: every larger neighbour of a node is hung on the least of the node and its neighbours
        _, large = hung(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = written(large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours are hung on the least of these
        low, small = hung(large)
        now = written(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        was, seen = seen, digest(now)
        if was == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _named(rows: DataFrame, key: str, text: str, shingle: int, budget: int) -> DataFrame:
    """``rows`` without ``text``, with _fp, _root (which tells the component) and component_id."""
    prints = written(fingerprints(rows, text, "_fp", shingle))
    least = written(prints.groupBy("_fp").agg(F.min(key).alias("_least")))
    group = written(components(links(least.select(F.col("_fp").alias("fp")), budget)))
    smallest = written(group.join(least, group.node == least._fp).groupBy("root").agg(F.min("_least").alias("_component")))
    named = written(group.join(smallest, "root").select(F.col("node").alias("_fp"), F.col("root").alias("_root"), "_component"))
    ids = written(least.join(named, "_fp", "left").select("_fp", F.coalesce("_root", "_fp").alias("_root"), F.coalesce("_component", "_least").alias("component_id")))
    return prints.join(ids, "_fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(key, fingerprint as a long, component_id) of every row."""
    return _named(df.select(key, text), key, text, shingle, budget).select(key, F.col("_fp").alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of ``df`` of each component: of the smallest id (null only if all are), then of the least text hash. It is decided by row: other texts under an id that is dropped in one component stay if they are their own component's. Of rows with the same id and text the one with the least hash of all columns stays."""
    hashes = {"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), F.col(text))}
    found = written(_named(df.select(key, text, *(c.alias(n) for n, c in hashes.items())), key, text, shingle, budget).select("_root", F.col(key).alias("_id"), *hashes))
    rank = F.struct(F.col("_id").isNull().alias("_none"), "_id", *hashes)
    best = written(found.groupBy("_root").agg(F.min(rank).alias("_best")).select("_root", "_best.*"))
    chosen = best.select("_root", F.col("_id").alias("_b"), F.col("_h1").alias("_b1"), F.col("_h2").alias("_b2"))
    each = found.join(chosen, "_root").withColumn("_stays", F.col("_id").eqNullSafe(F.col("_b")) & (F.col("_h1") == F.col("_b1")) & (F.col("_h2") == F.col("_b2")))
    gone = written(each.filter("not _stays").select("_id", *hashes).distinct())
    again = written(each.filter("_stays").groupBy("_id", *hashes).count().filter("count > 1").select("_id", *hashes))

    def same(other: DataFrame) -> Column:
        return F.col(key).eqNullSafe(other["_id"]) & (hashes["_h1"] == other["_h1"]) & (hashes["_h2"] == other["_h2"])

    # by shuffle at every size: the rows to drop grow with the input
    kept = df.join(gone.hint("merge"), same(gone), "left_anti")
    if again.isEmpty():
        return kept.select(*df.columns)
    row = F.struct(*(F.col(c) for c in df.columns))
    order = F.struct(F.xxhash64(F.to_json(row)), F.xxhash64(F.lit(1), F.to_json(row)))
    one = kept.join(again, same(again), "left_semi").groupBy(F.col(key).alias("_id"), *(c.alias(n) for n, c in hashes.items())).agg(F.min_by(row, order).alias("_row"))
    return kept.join(again, same(again), "left_anti").select(*df.columns).unionByName(one.select("_row.*"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

