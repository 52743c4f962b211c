"""Exact pairs above a cosine threshold: cover tree and dual traversal.

On the unit sphere a cosine of t is a distance of sqrt(2 - 2t), so links are pairs within
that reach. Distinct vectors are grouped by a cover tree:

1. Levels: nets with radii 2, 1, 1/2, .. are chosen among a bounded sample of vectors. They
   are nested: a node of one level is also a node of the next, below itself. The tree has a
   bounded number of nodes, whatever the table holds.
2. Insertion: every vector descends to the nearest child at each level. Below the last one,
   vectors part by the radius that still covers them, so that what no sampled vector is
   near to does not widen the node of near copies. The real radii of each node are the largest
   and the smallest distance of a vector below it, so bounds hold for all of them.
3. Dual traversal: pairs of nodes, from (root, root) on. A pair is dropped if its centres
   are farther apart than the reach and both radii; it is linked as a whole if even the
   farthest members are within reach; else its children's pairs come next, level by level.
   Undecided pairs of leaves are compared vector by vector.

A node that is linked as a whole gives every member the other's number of rows, so near
copies cost no pairs, however many there are. Equal vectors are one vector with a number of
rows. Comparisons are done by tiles: a tile is a bounded number of vectors of near leaves,
and a vector travels to a tile pair only if an undecided leaf pair needs it there. What
single precision leaves open is decided in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leakloom.llm import common
from leakloom.llm.components import components


class Settings(NamedTuple):
    sample: int = 4_096  # vectors that nodes are chosen among, at most
    per_node: int = 512  # vectors for each sampled one, if the table is small
    levels: int = 6  # radii 2, 1, .. 1/16
    tile: int = 8_192  # vectors


# Vectors

VECTORS = "uid long, n long, vec binary"


def _dtype(rows: DataFrame, column: str) -> str:
    """Components travel as they are stored: in single precision if that is what the table holds."""
    return "<f4" if rows.schema[column].dataType.simpleString() == "array<float>" else "<f8"


def usable(column: str) -> F.Column:
    """Vectors that take part: not null, not empty, with finite components that are not all zero."""
    vector = F.col(column)
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # not-a-number is larger
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def distinct(rows: DataFrame) -> DataFrame:
    """uid, vector, n (rows that hold it) and first (their smallest id) of the distinct vectors; written once.

    rows has id and vector. -0.0 counts as 0.0.
    """
    groups = rows.groupBy("vector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return common.saved(groups.select(F.monotonically_increasing_id().alias("uid"), "vector", "n", "first"), "distinct-vectors")


def compact(vectors: DataFrame, dtype: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [np.array(x, dtype).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vecs, pa.binary())], names=["uid", "n", "vec"])

    return vectors.select("uid", "n", "vector").mapInArrow(pack, VECTORS)


def unit(vecs: list[bytes], dtype: str) -> np.ndarray:
    """Rows of unit length in double precision; all of one length."""
    x = np.frombuffer(b"".join(vecs), dtype).reshape(len(vecs), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# 1. Levels


class Tree(NamedTuple):
    """Nodes are numbered level by level; the children of a node are a stretch of the next level.

    The last level has a child for each radius below every node of the one before, with its centre.
    """

    centers: np.ndarray  # of the nodes, unit vectors
    levels: list[tuple[int, int]]  # first node and number of nodes
    child: np.ndarray  # first child of a node; its last level has none
    children: np.ndarray  # their number

    @property
    def leaves(self) -> int:
        return self.levels[-1][1]


def _net(x: np.ndarray, fixed: int, radius: float) -> np.ndarray:
    """Rows of x that keep a distance of radius: the first `fixed` rows, then greedily."""
    near = np.zeros(len(x), bool)
    picked = []
    for i in range(len(x)):
        if i >= fixed and near[i]:
            continue
        picked.append(i)
        near |= 2 - 2 * (x @ x[i]) <= radius * radius
    return np.array(picked, np.int64)


def fit(x: np.ndarray, s: Settings) -> Tree:
    """A tree over sampled unit vectors (one at least)."""
    order = np.arange(1)  # the root
    parents: list[np.ndarray] = [np.zeros(1, np.int64)]
    members = [order]
    for level in range(1, s.levels):
        before = members[-1]
        rest = np.setdiff1d(np.arange(len(x)), before)
        candidates = np.r_[before, rest]
        net = candidates[_net(x[candidates], len(before), 2.0 / 2**level)]
        # Everything goes below the nearest node of the level before; a node is below itself.
        up = np.concatenate([(x[net[i : i + 1024]] @ x[before].T).argmax(axis=1) for i in range(0, len(net), 1024)])
        up[: len(before)] = np.arange(len(before))
        by = np.argsort(up, kind="stable")
        members.append(net[by])
        parents.append(up[by])
    members.append(np.repeat(members[-1], s.levels))
    parents.append(np.repeat(np.arange(len(members[-2])), s.levels))
    firsts = np.cumsum([0, *map(len, members)])
    child, children = np.zeros(firsts[-1], np.int64), np.zeros(firsts[-1], np.int64)
    for level in range(len(members) - 1):
        counts = np.bincount(parents[level + 1], minlength=len(members[level]))
        low = firsts[level]
        children[low : low + len(counts)] = counts
        child[low : low + len(counts)] = firsts[level + 1] + np.cumsum(counts) - counts
    return Tree(x[np.concatenate(members)], [(int(a), len(m)) for a, m in zip(firsts, members)], child, children)


# 2. Insertion


def descended(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes from the root to a leaf of each row of x, and its distances to their centres."""
    if len(x) > 1024:  # bounds the table of rows and children
        found = [descended(tree, x[i : i + 1024]) for i in range(0, len(x), 1024)]
        return np.concatenate([p for p, _ in found]), np.concatenate([d for _, d in found])
    path = np.zeros((len(x), len(tree.levels)), np.int64)
    for level in range(1, len(tree.levels) - 1):
        up = path[:, level - 1]
        order = np.argsort(up, kind="stable")
        starts = np.flatnonzero(np.r_[True, up[order][1:] != up[order][:-1]])
        for i, j in zip(starts, [*starts[1:], len(order)]):
            rows, node = order[i:j], up[order[i]]
            low, n = tree.child[node], tree.children[node]
            path[rows, level] = low + ((x[rows] @ tree.centers[low : low + n].T).argmax(axis=1) if n > 1 else 0)
    apart = np.stack([np.sqrt(((x - tree.centers[path[:, k]]) ** 2).sum(axis=1)) for k in range(path.shape[1])], axis=1)
    # The smallest radius 2, 1, 1/2, .. that covers the row.
    covering = np.floor(1 - np.log2(np.maximum(apart[:, -2], 2.0**-60))).astype(np.int64)
    path[:, -1] = tree.child[path[:, -2]] + np.clip(covering, 0, tree.children[path[:, -2]] - 1)
    apart[:, -1] = apart[:, -2]
    return path, apart


def inserted(vectors: DataFrame, tree: Tree, dtype: str) -> DataFrame:
    """uid, n, vec, leaf (its number among the leaves) and apart (distances to the nodes above); written once."""
    first = tree.levels[-1][0]

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                path, apart = descended(tree, unit(batch.column(2).to_pylist(), dtype))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array((path[:, -1] - first).astype(np.int32)), pa.array(apart.tolist(), pa.list_(pa.float64()))],
                    names=["uid", "n", "vec", "leaf", "apart"],
                )

    return common.saved(vectors.mapInArrow(insert, f"{VECTORS}, leaf int, apart array<double>"), "inserted")


class Measured(NamedTuple):
    """Of each node: the largest distance (negative if nothing is below it), the smallest (known of leaves), and the rows below it."""

    radius: np.ndarray
    inner: np.ndarray
    rows: np.ndarray
    vectors: np.ndarray  # distinct ones in each leaf


def measured(points: DataFrame, tree: Tree) -> Measured:
    """One row for each leaf comes back."""
    depth = len(tree.levels)
    found = points.groupBy("leaf").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("vectors"), F.min(F.col("apart")[depth - 1]).alias("inner"), *(F.max(F.col("apart")[k]).alias(f"r{k}") for k in range(depth))
    ).collect()
    radius, inner = np.full(len(tree.centers), -1.0), np.zeros(len(tree.centers))
    rows, vectors = np.zeros(len(tree.centers), np.int64), np.zeros(tree.leaves, np.int64)
    parent = np.zeros(len(tree.centers), np.int64)
    for node in range(tree.levels[-1][0]):
        parent[tree.child[node] : tree.child[node] + tree.children[node]] = node
    for row in found:
        vectors[row["leaf"]] = row["vectors"]
        node = tree.levels[-1][0] + row["leaf"]
        inner[node] = row["inner"]
        for k in range(depth - 1, -1, -1):
            radius[node] = max(radius[node], row[f"r{k}"])
            rows[node] += row["rows"]
            node = parent[node]
    return Measured(radius, inner, rows, vectors)


# 3. Dual traversal


def _kinds(tree: Tree, m: Measured, reach: float, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which node pairs are undecided, and which are linked as a whole. Bounds have room for rounding."""
    between = np.sqrt(((tree.centers[a] - tree.centers[b]) ** 2).sum(axis=1))
    whole = between + m.radius[a] + m.radius[b] <= reach - 1e-7
    least = np.maximum(between - m.radius[a], m.inner[a] - between) - m.radius[b]
    least = np.maximum(least, m.inner[b] - between - m.radius[a])
    return (least <= reach + 1e-7) & ~whole, whole


def traversed(spark, tree: Tree, m: Measured, reach: float) -> tuple[DataFrame, DataFrame]:
    """Undecided pairs of leaves, and pairs of nodes that are linked as a whole: a, b with a <= b."""
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    whole = []

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            todo, linked = _kinds(tree, m, reach, a, b)
            keep = todo | linked
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(linked[keep])], names=["a", "b", "whole"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                of_a = np.arange(tree.child[a], tree.child[a] + tree.children[a])
                of_b = np.arange(tree.child[b], tree.child[b] + tree.children[b])
                of_a, of_b = of_a[m.radius[of_a] >= 0], of_b[m.radius[of_b] >= 0]
                for low in range(0, len(of_a), 64):  # a bounded number of pairs at a time
                    x, y = (z.ravel() for z in np.meshgrid(of_a[low : low + 64], of_b, indexing="ij"))
                    keep = (x <= y) if a == b else np.ones(len(x), bool)
                    todo, linked = _kinds(tree, m, reach, x[keep], y[keep])
                    x, y = x[keep], y[keep]
                    some = todo | linked
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]), pa.array(y[some]), pa.array(linked[some])], names=["a", "b", "whole"])

    schema = "a long, b long, whole boolean"
    decided = common.saved(pairs.mapInArrow(decide, schema), "node-pairs")
    for _ in range(len(tree.levels) - 1):
        whole.append(decided.where("whole").select("a", "b"))
        todo = decided.where("NOT whole").select("a", "b").repartition("a", "b")
        decided = common.saved(todo.mapInArrow(expand, schema), "node-pairs")
    linked = decided.where("whole").select("a", "b")
    for w in whole:
        linked = linked.union(w)
    return decided.where("NOT whole").select("a", "b"), linked


# Tiles


class Tiles(NamedTuple):
    """Leaves share a tile, or a leaf has several of its own: tiles of a leaf are first .. first + number - 1."""

    first: np.ndarray
    number: np.ndarray


def tiles(m: Measured, size: int) -> Tiles:
    """Leaves in the order of the tree, so that those of a tile are near each other."""
    first, number = np.zeros(len(m.vectors), np.int64), np.ones(len(m.vectors), np.int64)
    at, filled = 0, 0
    for leaf, n in enumerate(m.vectors.tolist()):
        if n > size or filled + n > size:
            at, filled = at + (filled > 0), 0
        first[leaf] = at
        if n > size:
            number[leaf] = -(-n // size)
            at += int(number[leaf])
        else:
            filled += n
    return Tiles(first, number)


CELLS = "tile long, leaf int, uids binary, ns binary, vecs binary"


def cells(points: DataFrame, t: Tiles) -> DataFrame:
    """The vectors of a leaf in a tile as one row; written once."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, leaf = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "leaf"))
            mixed = uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            tile = t.first[leaf] + (mixed % t.number[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tile), *(batch.column(c) for c in ("leaf", "uid", "n", "vec"))], names=["tile", "leaf", "uid", "n", "vec"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    yield cell(held)
                    held = []
                held.append(row)
        if held:
            yield cell(held)

    def cell(rows: list[tuple]) -> pa.RecordBatch:
        tile, leaf, uid, n, vec = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(tile[:1], pa.int64()), pa.array(leaf[:1], pa.int32()), pa.array([np.array(uid, np.int64).tobytes()], pa.binary()),
             pa.array([np.array(n, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vec)], pa.binary())],
            names=["tile", "leaf", "uids", "ns", "vecs"],
        )

    placed = points.select("leaf", "uid", "n", "vec").mapInArrow(place, f"tile long, leaf int, {VECTORS}")
    ordered = placed.repartition("tile", "leaf").sortWithinPartitions("tile", "leaf", "uid")
    return common.saved(ordered.mapInArrow(gather, CELLS), "cells")


def needs(undecided: DataFrame, tree: Tree, t: Tiles) -> DataFrame:
    """Which cells each tile pair needs, and the leaves that a cell is compared with there: ta, tb, tile, leaf, partners."""
    first = tree.levels[-1][0]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = a - first, b - first
                for x in range(t.first[a], t.first[a] + t.number[a]):
                    for y in range(t.first[b], t.first[b] + t.number[b]):
                        if a == b and x > y:
                            continue
                        # The cell with the smaller (tile, leaf) has the other as its partner.
                        (p, i), (q, j) = sorted([(x, a), (y, b)])
                        out += [(p, q, p, i, q, j), (p, q, q, j, None, None)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["ta", "tb", "tile", "leaf", "with_tile", "with_leaf"])

    flat = undecided.mapInArrow(spread, "ta long, tb long, tile long, leaf int, with_tile long, with_leaf int")
    # At most the leaves of one tile are gathered.
    return flat.groupBy("ta", "tb", "tile", "leaf").agg(F.collect_set(F.when(F.col("with_leaf").isNotNull(), F.struct("with_tile", "with_leaf"))).alias("partners"))


class _Cells:
    """The cells of a tile pair, with the counts and the links found between their vectors."""

    def __init__(self, rows: list[tuple], dtype: str):
        self.at, self.partners, low = {}, [], 0
        uids, ns, vecs = [], [], []
        for tile, leaf, partners, uid, n, vec in rows:
            uid = np.frombuffer(uid, np.int64)
            self.at[tile, leaf] = (low, low + len(uid))
            self.partners.append(((tile, leaf), [(p["with_tile"], p["with_leaf"]) for p in partners]))
            low += len(uid)
            uids.append(uid)
            ns.append(np.frombuffer(n, np.int64))
            size = len(vec) // len(uid)
            vecs += [vec[i : i + size] for i in range(0, len(vec), size)]
        self.uid, self.n = np.concatenate(uids), np.concatenate(ns)
        self.x = unit(vecs, dtype)
        self.slim = self.x.astype(np.float32)
        self.count, self.label = np.zeros(low, np.int64), np.arange(low)

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            i, j = i[differ], j[differ]
            np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while (label != label[label]).any():
                label[:] = label[label]

    def compare(self, threshold: float, rows: int = 512) -> None:
        for own, partners in self.partners:
            low, high = self.at[own]
            for other in partners:
                start, end = self.at.get(other, (0, 0))  # a tile of a leaf may hold none of its vectors
                for i in range(low, high, rows):
                    top = min(i + rows, high)
                    for j in range(start if own != other else i, end, 4 * rows):
                        self._block(i, top, j, min(j + 4 * rows, end), own == other, threshold)

    def _block(self, i: int, top: int, j: int, end: int, same: bool, threshold: float) -> None:
        margin = max(1e-5, self.x.shape[1] * 1.2e-7)  # above the rounding of single precision
        cosine = self.slim[i:top] @ self.slim[j:end].T
        row, col = np.nonzero(cosine >= threshold - margin)
        clear = cosine[row, col] >= threshold + margin
        row, col = row + i, col + j
        if same:  # every pair of a cell once, and each vector with itself
            once = row <= col
            row, col, clear = row[once], col[once], clear[once]
        for at in range(0, len(row), 65_536):
            a, b, good = row[at : at + 65_536], col[at : at + 65_536], clear[at : at + 65_536] | (row[at : at + 65_536] == col[at : at + 65_536])
            close = np.flatnonzero(~good)
            good[close] = (self.x[a[close]] * self.x[b[close]]).sum(axis=1) >= threshold
            a, b = a[good], b[good]
            np.add.at(self.count, a, self.n[b])
            apart = a != b
            np.add.at(self.count, b[apart], self.n[a[apart]])
            self._link(a[apart], b[apart])


def compared(undecided: DataFrame, points: DataFrame, tree: Tree, m: Measured, threshold: float, dtype: str, s: Settings) -> DataFrame:
    """uid, count, root: rows that hold a vector linked to uid in a tile pair (its own with itself), and a uid it hangs together with; written once."""
    t = tiles(m, s.tile)
    joined = needs(undecided, tree, t).join(cells(points, t), ["tile", "leaf"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != now and rows:
                    yield result(rows)
                    rows = []
                now = row[:2]
                rows.append(row[2:])
        if rows:
            yield result(rows)

    def result(rows: list[tuple]) -> pa.RecordBatch:
        c = _Cells(rows, dtype)
        c.compare(threshold)
        some = np.flatnonzero(c.count)
        return pa.RecordBatch.from_arrays([pa.array(c.uid[some]), pa.array(c.count[some]), pa.array(c.uid[c.label[some]])], names=["uid", "count", "root"])

    ordered = joined.select("ta", "tb", "tile", "leaf", "partners", "uids", "ns", "vecs").repartition("ta", "tb").sortWithinPartitions("ta", "tb")
    return common.saved(ordered.mapInArrow(compare, "uid long, count long, root long"), "compared")


def wholly(spark, linked: DataFrame, points: DataFrame, tree: Tree, m: Measured) -> tuple[DataFrame, DataFrame]:
    """What node pairs linked as a whole give: uid and count of vectors, and links a, b of nodes with their members and each other.

    Nodes are named -1 - node among the uids. The node pairs are added up by node first; what
    comes to the driver is one row for each node.
    """
    both = linked.select("a", "b").union(linked.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.rows[batch.column(1).to_numpy(zero_copy_only=False)])], names=["node", "count"])

    sums = both.mapInArrow(weigh, "node long, count long").groupBy("node").agg(F.sum("count").alias("count")).collect()
    gain = np.zeros(len(tree.centers), np.int64)
    for row in sums:
        gain[row["node"]] = row["count"]
    # A leaf gets what the nodes above it get; its members hang on each of those.
    above = np.zeros((tree.leaves, len(tree.levels)), np.int64)
    for k in range(len(tree.levels) - 2, -1, -1):
        parent = np.zeros(len(tree.centers), np.int64)
        low, n = tree.levels[k]
        for node in range(low, low + n):
            parent[tree.child[node] : tree.child[node] + tree.children[node]] = node
        if k == len(tree.levels) - 2:
            above[:, -1] = tree.levels[-1][0] + np.arange(tree.leaves)
        above[:, k] = parent[above[:, k + 1]]
    total = gain[above].sum(axis=1)
    # Nodes of one path overlap in all their members, so one hold for each leaf and path link is enough.
    lowest = np.array([max((a for a in path if gain[a]), default=-1) for path in above.tolist()], np.int64)
    chain = {(int(a), int(b)) for path in above.tolist() for hung in [[x for x in path if gain[x]]] for a, b in zip(hung, hung[1:])}

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = batch.column(1).to_numpy(zero_copy_only=False)
            some = total[leaf] > 0
            uid = batch.column(0).to_numpy(zero_copy_only=False)[some]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(total[leaf[some]]), pa.array(-1 - lowest[leaf[some]])], names=["uid", "count", "root"])

    given = points.select("uid", "leaf").mapInArrow(give, "uid long, count long, root long")
    name = lambda c: (F.lit(-1) - F.col(c)).alias(c)
    links = linked.where("a <> b").select(name("a"), name("b"))
    if chain:
        links = links.union(spark.createDataFrame([(-1 - a, -1 - b) for a, b in sorted(chain)], "a long, b long"))
    return given, links


# All


def linked(rows: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """doc (the columns of rows), n_links, component_id and kept of each row.

    Links are all pairs of rows with a cosine of threshold or more, in double precision.
    Null vectors, empty ones, zero vectors and those with null or non-finite components link
    with nothing, and vectors of different lengths not with each other: each length has its own
    tree. Rows with equal ids are different vectors. component_id is the smallest id that links
    reach, the row's own included; null ids take part, and their component_id is null only if
    nothing they reach has an id. kept tells whether that is the row's own id (false for null).
    An empty table gives no rows.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    spark, dtype = rows.sparkSession, _dtype(rows, column)
    tagged = rows.select(
        F.struct("*").alias("doc"), F.col(key).cast("long").alias("id"),
        # Adding 0 makes -0.0 to 0.0, so that equal vectors are equal keys.
        F.when(usable(column), F.transform(column, lambda x: x + F.lit(0).cast("float" if dtype == "<f4" else "double"))).alias("vector"),
    )
    vectors = distinct(tagged.where("vector IS NOT NULL").select("id", "vector"))
    counts, edges = [], []
    lengths = [r["length"] for r in vectors.select(F.size("vector").alias("length")).distinct().orderBy("length").collect()]
    reach = float(np.sqrt(2 - 2 * threshold))
    for length in lengths:
        own = vectors.where(F.size("vector") == length)
        n = own.count()
        size = min(s.sample, max(1, n // s.per_node))
        sample = own.orderBy(F.xxhash64("vector"), "uid").limit(size).select("uid", "n", "vector")
        tree = fit(unit([r["vec"] for r in compact(sample, dtype).collect()], dtype), s)
        points = inserted(compact(own, dtype), tree, dtype)
        m = measured(points, tree)
        undecided, whole = traversed(spark, tree, m, reach)
        near = compared(undecided, points, tree, m, threshold, dtype, s)
        given, node_links = wholly(spark, whole, points, tree, m)
        counts += [near.select("uid", "count"), given.select("uid", "count")]
        # Names of nodes are apart for each length.
        base = F.lit(len(edges) * (1 << 40))
        apart = lambda c: F.when(F.col(c) < 0, F.col(c) - base).otherwise(F.col(c))  # noqa: B023, E731
        hold = near.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b"))
        hang = given.select(F.col("uid").alias("a"), apart("root").alias("b"))
        edges.append(hold.union(hang).union(node_links.select(apart("a").alias("a"), apart("b").alias("b"))))
    none = spark.createDataFrame([], "uid long, count long")
    number = _all(counts, none).groupBy("uid").agg(F.sum("count").alias("count"))
    roots = components(_all(edges, spark.createDataFrame([], "a long, b long"))).select(F.col("a").alias("uid"), "root")
    rooted = vectors.join(roots, "uid", "left").join(number, "uid", "left")
    rooted = rooted.select("vector", "first", F.coalesce("root", "uid").alias("root"), F.coalesce("count", "n").alias("count"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    of = common.saved(rooted.join(least, "root").select("vector", "count", "least"), "classes")
    out = tagged.join(of, "vector", "left")
    component = F.when(F.col("count").isNull(), F.col("id")).otherwise(F.col("least"))
    out = out.select("doc", "id", F.coalesce(F.col("count") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.select("doc", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _all(frames: list[DataFrame], none: DataFrame) -> DataFrame:
    for f in frames:
        none = none.union(f)
    return none
