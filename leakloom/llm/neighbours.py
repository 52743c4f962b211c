"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node, named by their smallest id; what is found is a node, and its ids,
smallest first, take the ranks. So ties are exact and copies never fill a list.

Vectors are divided by the largest norm and get one more component that makes them unit
vectors; nearness among those is nearness by inner product for queries with 0 there. The
graph works on copies with 8 bits for each original component under a scale of their own,
so that one long vector takes nothing from the others. Each copy knows how far it is from its
original; all that this leaves open is scored in double precision on the originals.

1. Start: rows sorted by the signs of random hyperplanes are cut into leaves of LEAF rows,
   once for each tree; every row takes its nearest rows in its leaf.
2. NN-descent: each node meets its neighbours and a sample of those that list it (a join),
   and introduces them to each other where one of them is new to it since its last round; a
   pair counts where it beats a node's worst neighbour. The lists of all nodes are reduced
   and joined to the graph. Rounds end when few lists change, or after ROUNDS.
3. Search: a query starts from its own node. In each round, the best EXPAND nodes found that
   were not expanded yet meet their neighbours (a join); better ones enter the beam.

A vector travels once to each task that needs it, not once for each edge, and the table that
the search joins again and again is bucketed, so that only the queries move. Sorting by range
splits near vectors, lists are bounded by parameters, a node that many list passes on a
sample of them before it moves, and no table of vectors is ever sent to all tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from leakloom.llm import common


class Settings(NamedTuple):
    trees: int = 6
    leaf: int = 768
    seeds: int = 16  # neighbours of a row in a leaf
    degree: int = 28  # neighbours of a node
    reverse: int = 20  # nodes that list it and take part, at most
    rounds: int = 4  # at most
    least_change: float = 0.02  # part of all list entries that a round has to change for another
    beam: int = 240
    expand: int = 40  # nodes of a beam that a search round expands
    search_rounds: int = 10  # at most
    planes: int = 16
    nodes: int = 20_000  # nodes whose neighbours' vectors meet in a task


LISTS = "id long, near binary, sims binary"
_LISTS = ["id", "near", "sims"]
#: Bytes before the components of a copy: its scale, its additional component, and its distance from the original.
_HEAD = 12


def _arrays(column: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def encoded(x: np.ndarray, rest: np.ndarray) -> list[bytes]:
    """Each row as a 4-byte scale, its 4-byte additional component, its 4-byte error and one signed byte per component."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30).astype(np.float32) / np.float32(127)
    cells = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - cells * scale[:, None].astype(np.float64)) ** 2).sum(axis=1)).astype(np.float32)
    head = zip(scale, rest.astype(np.float32), np.nextafter(error, np.float32(9)), cells)
    return [s.tobytes() + r.tobytes() + e.tobytes() + c.tobytes() for s, r, e, c in head]


def decoded(column: list[bytes]) -> np.ndarray:
    """The components of each row, the additional one last."""
    if not column:
        return np.empty((0, 0), np.float32)
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    scale, rest = (np.ascontiguousarray(raw[:, i : i + 4]).view(np.float32) for i in (0, 4))
    return np.c_[np.ascontiguousarray(raw[:, _HEAD:]).view(np.int8) * scale, rest]


def nearness(x: np.ndarray) -> np.ndarray:
    """Inner products of decoded rows less 1, as half squared distances: short vectors differ far below 1."""
    product, rest = x[:, :-1] @ x[:, :-1].T, x[:, -1]
    own = np.diag(product) / 2
    return product - own[:, None] - own - (rest[:, None] - rest) ** 2 / 2


def best(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k distinct b with the largest s of each a, sorted by a, then from the largest s (ties: smaller b)."""
    order = np.lexsort((-s, b, a))
    a, b, s = a[order], b[order], s[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s = a[first], b[first], s[first]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], s[keep]


def _packed(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """One row for each run of equal a."""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(a)].astype(np.int64)
    b, s = b.astype(np.int64), s.astype(np.float32)
    return pa.RecordBatch.from_arrays(
        [pa.array(a[starts].astype(np.int64)), pa.array([b[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()),
         pa.array([s[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())],
        names=_LISTS,
    )


def reduced(lists: DataFrame, k: int) -> DataFrame:
    """The best k of all lists of each id; memory holds a batch and the last id's best."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        for batch in batches:
            near, sims = _arrays(batch.column(1), np.int64), _arrays(batch.column(2), np.float32)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in near])
            a, b, s = best(np.r_[held[0], ids], np.concatenate([held[1], *near]), np.concatenate([held[2], *sims]), k)
            last = a == a[-1] if len(a) else np.empty(0, bool)
            held = (a[last], b[last], s[last])
            yield _packed(a[~last], b[~last], s[~last])
        yield _packed(*held)

    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(reduce, LISTS)


def usable(rows: DataFrame, key: str, column: str) -> DataFrame:
    """id and vector (array<double>) of the rows that take part, one for each id; written once.

    Null ids, null or empty vectors, zero vectors and those with null or non-finite
    components take no part, nor do vectors of another length than the commonest (ties: the
    longer). Of several rows with one id, the smallest vector counts.
    """
    vector = F.col(column).cast("array<double>")
    slim = rows.select(F.col(key).cast("long").alias("id"), vector.alias("vector"))
    slim = slim.where(F.col("id").isNotNull() & (F.size("vector") > 0))
    # Not-a-number is larger than any number here.
    slim = slim.where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    slim = slim.where(F.exists("vector", lambda x: x != 0))
    one = common.saved(slim.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    lengths = one.groupBy(F.size("vector").alias("length")).count()
    common_one = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return one.where(F.size("vector") == (common_one["length"] if common_one else 0))


def prepared(vectors: DataFrame) -> DataFrame:
    """id and vec: the 8-bit copy of the vector, of length 1 at most, with its additional component; written once."""
    norm2 = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
    largest = (vectors.agg(F.max(norm2)).first()[0] or 1.0) ** 0.5

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1) / largest
            rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(encoded(x, rest), pa.binary())], names=["id", "vec"]
            )

    return common.saved(vectors.select("id", "vector").mapInArrow(prepare, "id long, vec binary"), "unit-vectors")


def _leaves(points: DataFrame, s: Settings) -> DataFrame:
    """Rows once for each tree, with the signs of its hyperplanes and a place along one more direction, both of the direction only."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = decoded(batch.column(1).to_pylist())[:, :-1]
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)
            for tree in range(s.trees if len(x) else 0):
                planes = np.random.Generator(np.random.PCG64([8, tree])).normal(size=(x.shape[1], s.planes + 1))
                at = x @ planes.astype(np.float32)
                sides = (at[:, : s.planes] > 0) @ (1 << np.arange(s.planes)[::-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), tree, np.int32)), pa.array(sides.astype(np.int64)),
                     pa.array(at[:, s.planes].astype(np.float64)), batch.column(0), batch.column(1)],
                    names=["tree", "sides", "along", "id", "vec"],
                )

    return points.mapInArrow(place, "tree int, sides long, along double, id long, vec binary")


def started(points: DataFrame, s: Settings) -> DataFrame:
    """First lists: each row's nearest rows in its leaf of each tree."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = np.empty(0, np.int64), []
        for batch in batches:
            ids, vecs = np.r_[ids, batch.column("id").to_numpy(zero_copy_only=False)], vecs + batch.column("vec").to_pylist()
            # Keep at least one leaf, so that the last is not too short.
            while len(ids) >= 2 * s.leaf:
                yield within(ids[: s.leaf], vecs[: s.leaf])
                ids, vecs = ids[s.leaf :], vecs[s.leaf :]
        if len(ids):
            yield within(ids, vecs)

    def within(ids: np.ndarray, vecs: list[bytes]) -> pa.RecordBatch:
        x = decoded(vecs)
        sims = nearness(x)
        # A leaf's rows may hold an id twice where trees meet.
        sims[ids[:, None] == ids[None, :]] = -9
        k = min(s.seeds, len(ids) - 1)
        at = np.argpartition(-sims, k, axis=1)[:, :k] if k else np.empty((len(ids), 0), np.int64)
        found = np.take_along_axis(sims, at, 1).ravel()
        a, b = np.repeat(ids, k), ids[at].ravel()
        order = np.argsort(a, kind="stable")
        real = found[order] > -9
        return _packed(a[order][real], b[order][real], found[order][real])

    rows = _leaves(points, s).repartitionByRange("tree", "sides", "along").sortWithinPartitions("tree", "sides", "along")
    lists = reduced(rows.mapInArrow(meet, LISTS), s.degree)
    joined = points.join(lists, "id", "left").withColumnsRenamed({"near": "near2", "sims": "sims2"})
    none = F.lit(None).cast("binary")
    return common.saved(_merged(joined.withColumns({"near": none, "sims": none}), s), "graph")


def _edges(graph: DataFrame, s: Settings, seed: int) -> DataFrame:
    """id meets other, which is on its list or lists it; fresh if that is new since the last round."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x or b"", np.int64) for x in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in lists])
            other = np.concatenate([np.empty(0, np.int64), *lists])
            fresh = np.frombuffer(b"".join(x or b"" for x in batch.column(2).to_pylist()), bool)
            yield edge_batch(ids, other, fresh)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges the other way, of those into a node the first few by chance: a batch passes on no more than are kept in the end."""
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        for batch in batches:
            held = few(*(np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)))
            if len(held[0]) > 1_000_000:
                yield edge_batch(*held)
                held = [h[:0] for h in held]
        yield edge_batch(*held)

    def few(node: np.ndarray, who: np.ndarray, fresh: np.ndarray) -> list[np.ndarray]:
        chance = (who.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        chance = (chance ^ (chance >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.lexsort((chance, node))
        node, who, fresh = node[order], who[order], fresh[order]
        keep = np.arange(len(node)) - np.searchsorted(node, node) < s.reverse
        return [node[keep], who[keep], fresh[keep]]

    def edge_batch(ids: np.ndarray, other: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(other), pa.array(fresh)], names=["id", "other", "fresh"])

    schema = "id long, other long, fresh boolean"
    out = graph.select("id", "near", "fresh").mapInArrow(flat, schema)
    back = out.select(F.col("other").alias("id"), F.col("id").alias("other"), "fresh").mapInArrow(turned, schema)
    return out.union(back.repartition("id").mapInArrow(turned, schema))


def _tasks(graph: DataFrame, s: Settings) -> int:
    return max(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-graph.count() // s.nodes))


VISITS = "task int, other long, vec binary, worst float, ids binary, fresh binary"


def _visits(edges: DataFrame, graph: DataFrame, s: Settings, tasks: int) -> DataFrame:
    """The vector of other, and the nodes of a task that meet it, in partitions by task."""
    joined = edges.join(_slim(graph, s.degree), "other")
    joined = joined.select("other", F.pmod(F.hash("id"), F.lit(tasks)).alias("task"), "id", "fresh", "vec", "worst")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other, task, ids, fresh = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            order = np.lexsort((task, other))
            key_o, key_t = other[order], task[order]
            starts = np.flatnonzero(np.r_[True, (key_o[1:] != key_o[:-1]) | (key_t[1:] != key_t[:-1])]) if len(order) else order
            ends = [*starts[1:], len(order)]
            first = pa.array(order[starts])
            ids, fresh = ids[order].astype(np.int64), fresh[order].astype(bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("task").take(first), batch.column("other").take(first), batch.column("vec").take(first), batch.column("worst").take(first),
                 pa.array([ids[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()),
                 pa.array([fresh[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())],
                names=["task", "other", "vec", "worst", "ids", "fresh"],
            )

    # Equal others come one after another, so that a batch holds nearly all of each.
    return joined.sortWithinPartitions("other").mapInArrow(bundle, VISITS).repartition(tasks, "task").sortWithinPartitions("task")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Of each task in a partition: its edges sorted by node (node, place of other, fresh), and others, vectors and worsts."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield _meeting(held)
                held = []
            held.append(row)
    if held:
        yield _meeting(held)


def _meeting(rows: list[tuple]) -> tuple:
    _, other, vecs, worst, ids, fresh = zip(*rows)
    other, at = np.unique(np.array(other, np.int64), return_inverse=True)
    first = np.zeros(len(other), np.int64)
    first[at] = np.arange(len(at))
    ids = [np.frombuffer(x, np.int64) for x in ids]
    node, place = np.concatenate(ids), np.repeat(at, [len(x) for x in ids])
    fresh = np.frombuffer(b"".join(fresh), bool)
    order = np.lexsort((~fresh, place, node))  # a node that lists and is listed comes twice
    node, place, fresh = node[order], place[order], fresh[order]
    once = np.r_[True, (node[1:] != node[:-1]) | (place[1:] != place[:-1])]
    return node[once], place[once], fresh[once], other, [vecs[i] for i in first], np.array(worst, np.float32)[first]


def _worst(sims: list[bytes | None], k: int) -> np.ndarray:
    """The similarity that a new neighbour has to beat."""
    found = [np.frombuffer(x or b"", np.float32) for x in sims]
    return np.array([x[-1] if len(x) >= k else -9 for x in found], np.float32)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return zip(starts.tolist(), [*starts[1:].tolist(), len(keys)])


def _slim(graph: DataFrame, k: int) -> DataFrame:
    """other, vec, worst of each node."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst = pa.array(_worst(batch.column(2).to_pylist(), k))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), worst], names=["other", "vec", "worst"])

    return graph.select("id", "vec", "sims").mapInArrow(cut, "other long, vec binary, worst float")


def _introduced(graph: DataFrame, s: Settings, seed: int) -> DataFrame:
    """Pairs that met at a node, one of them new to it, and beat the worst neighbour of one of them, as lists."""

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, place, fresh, other, vecs, worst in _meetings(batches):
            x = decoded(vecs)
            a, b, c, size = [], [], [], 0
            for i, j in _runs(node):
                if not fresh[i:j].any():
                    continue
                who = place[i:j]
                sims = nearness(x[who])
                np.fill_diagonal(sims, -9)
                row, col = np.nonzero((sims > worst[who, None]) & (fresh[i:j, None] | fresh[None, i:j]))
                a.append(who[row])
                b.append(who[col])
                c.append(sims[row, col])
                size += len(row)
                if size > 4_000_000:  # reduced now and then, so that memory is bounded
                    kept = best(np.concatenate(a), np.concatenate(b), np.concatenate(c), s.degree)
                    a, b, c = ([k] for k in kept)
                    size = len(kept[0])
            if a:
                i, j, k = best(np.concatenate(a), np.concatenate(b), np.concatenate(c), s.degree)
                yield _packed(other[i], other[j], k)

    edges = _edges(graph, s, seed)
    return _visits(edges, graph, s, _tasks(graph, s)).mapInArrow(introduce, LISTS)


GRAPH = "id long, vec binary, near binary, sims binary, fresh binary, changed int"


def _merged(joined: DataFrame, s: Settings) -> DataFrame:
    """The best of near and near2; fresh marks those that were not in near, changed is their number."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            a, b, c, old = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)], []
            for near, sims in (("near", "sims"), ("near2", "sims2")):
                lists = [np.frombuffer(x or b"", np.int64) for x in batch.column(near).to_pylist()]
                old = old or lists
                a.append(np.repeat(np.arange(len(ids)), [len(x) for x in lists]))
                b += lists
                c += [np.frombuffer(x or b"", np.float32) for x in batch.column(sims).to_pylist()]
            row, b, c = best(np.concatenate(a), np.concatenate(b), np.concatenate(c), s.degree)
            low, high = np.searchsorted(row, np.arange(len(ids))), np.searchsorted(row, np.arange(len(ids)), "right")
            marks = [~np.isin(b[i:j], o) for i, j, o in zip(low, high, old)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"),
                 pa.array([b[i:j].astype(np.int64).tobytes() for i, j in zip(low, high)], pa.binary()),
                 pa.array([c[i:j].astype(np.float32).tobytes() for i, j in zip(low, high)], pa.binary()),
                 pa.array([m.tobytes() for m in marks], pa.binary()), pa.array([int(m.sum()) for m in marks], pa.int32())],
                names=["id", "vec", "near", "sims", "fresh", "changed"],
            )

    return joined.select("id", "vec", "near", "sims", "near2", "sims2").mapInArrow(merge, GRAPH)


def descend(points: DataFrame, s: Settings) -> DataFrame:
    """The neighbour graph: id, vec, near, sims, fresh, changed; every round is written."""
    graph = started(points, s)
    for i in range(s.rounds):
        found = reduced(_introduced(graph, s, i), s.degree).withColumnsRenamed({"near": "near2", "sims": "sims2"})
        after = common.saved(_merged(graph.join(found, "id", "left"), s), "graph")
        common.discard(graph)
        graph = after
        changed, nodes = graph.agg(F.sum("changed"), F.count(F.lit(1))).first()
        if (changed or 0) <= s.least_change * nodes * s.degree:
            break
    return graph


def _adjacency(graph: DataFrame, s: Settings) -> tuple[DataFrame, str]:
    """id, near, vecs: each node's company with their vectors, bucketed by id, and the table's name."""
    tasks = _tasks(graph, s)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, place, _, other, vecs, _ in _meetings(batches):
            raw = np.frombuffer(b"".join(vecs), np.uint8).reshape(len(vecs), -1)
            runs = list(_runs(node))
            for low in range(0, len(runs), 512):
                some = runs[low : low + 512]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node[i] for i, _ in some], pa.int64()),
                     pa.array([other[place[i:j]].tobytes() for i, j in some], pa.binary()),
                     pa.array([raw[place[i:j]].tobytes() for i, j in some], pa.binary())],
                    names=["id", "near", "vecs"],
                )

    name = f"adjacency_{uuid.uuid4().hex}"
    rows = _visits(_edges(graph, s, -1 & 0xFFFF), graph, s, tasks).mapInArrow(gather, "id long, near binary, vecs binary")
    path = common.work_path(graph.sparkSession, "adjacency")
    rows.write.format("parquet").bucketBy(tasks, "id").sortBy("id").option("path", path).saveAsTable(name)
    return graph.sparkSession.table(name), name


BEAM = "id long, vec binary, near binary, sims binary, done binary"


def _begun(nodes: DataFrame) -> DataFrame:
    """Beams that hold the query's own node, to be expanded; the query's additional component is 0."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v[:4] + bytes(4) + v[8:] for v in batch.column(1).to_pylist()], pa.binary()),
                 pa.array([np.int64(i).tobytes() for i in ids], pa.binary()),
                 pa.array([np.float32(-9).tobytes()] * n, pa.binary()), pa.array([b"\0"] * n, pa.binary())],
                names=["id", "vec", "near", "sims", "done"],
            )

    return nodes.select("id", "vec").mapInArrow(begin, BEAM)


def _next(done: np.ndarray, s: Settings) -> np.ndarray:
    """Places in a beam, best first, that its next round expands."""
    return np.flatnonzero(~done)[: s.expand]


def _beamed(state: DataFrame, s: Settings) -> DataFrame:
    """The next beams: the best of the old beam and what was found; done marks nodes that were expanded."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for own, vec, near, sims, done, near2, sims2 in zip(*(c.to_pylist() for c in batch.columns)):
                near, sims, done = np.frombuffer(near, np.int64), np.frombuffer(sims, np.float32), np.frombuffer(done, bool).copy()
                done[_next(done, s)] = True
                expanded = near[done]
                b = np.r_[near, np.frombuffer(near2 or b"", np.int64)]
                c = np.r_[sims, np.frombuffer(sims2 or b"", np.float32)]
                keep = b != own
                _, b, c = best(np.zeros(keep.sum(), np.int64), b[keep], c[keep], s.beam)
                out.append((own, vec, b.astype(np.int64).tobytes(), c.astype(np.float32).tobytes(), np.isin(b, expanded).tobytes()))
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "vec", "near", "sims", "done"])

    return state.select("id", "vec", "near", "sims", "done", "near2", "sims2").mapInArrow(merge, BEAM)


def _frontier(beams: DataFrame, s: Settings) -> DataFrame:
    """id, node, vec, worst: the nodes that each query expands next."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, vecs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            worst = _worst(batch.column(3).to_pylist(), s.beam).tolist()
            q, n, v, w = [], [], [], []
            for own, vec, near, done, low in zip(queries, vecs, batch.column(2).to_pylist(), batch.column(4).to_pylist(), worst):
                todo = np.frombuffer(near, np.int64)[_next(np.frombuffer(done, bool), s)].tolist()
                q += [own] * len(todo)
                n += todo
                v += [vec] * len(todo)
                w += [low] * len(todo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(n, pa.int64()), pa.array(v, pa.binary()), pa.array(w, pa.float32())],
                names=["query", "id", "vec", "worst"],
            )

    return beams.select("id", "vec", "near", "sims", "done").mapInArrow(flat, "query long, id long, vec binary, worst float")


def _expanded(frontier: DataFrame, adjacency: DataFrame, s: Settings) -> DataFrame:
    """Neighbours of expanded nodes that beat the worst of a query's beam, as lists by query."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = decoded(batch.column("vec").to_pylist())[:, :-1]
            own, worst = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("query", "worst"))
            a, b, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
            for i, (near, vecs) in enumerate(zip(batch.column("near").to_pylist(), batch.column("vecs").to_pylist())):
                who = np.frombuffer(near, np.int64)
                raw = np.frombuffer(vecs, np.uint8).reshape(len(who), -1)
                cells = np.ascontiguousarray(raw[:, _HEAD:]).view(np.int8).astype(np.float32)
                sims = cells @ queries[i] * np.ascontiguousarray(raw[:, :4]).view(np.float32)[:, 0]
                hit = sims > worst[i]
                a.append(np.full(hit.sum(), own[i]))
                b.append(who[hit])
                c.append(sims[hit])
            yield _packed(*best(np.concatenate(a), np.concatenate(b), np.concatenate(c), s.beam))

    joined = adjacency.join(frontier, "id").select("query", "vec", "worst", "near", "vecs")
    return reduced(joined.mapInArrow(expand, LISTS), s.beam)


def search(graph: DataFrame, queries: DataFrame, s: Settings) -> DataFrame:
    """Beams of the queries (a frame of ids of nodes): id, vec, near, sims, done, best first."""
    adjacency, name = _adjacency(graph, s)
    first = graph.join(queries.select("id").distinct(), "id", "left_semi")
    beams = common.saved(_begun(first), "beams")
    for _ in range(s.search_rounds):
        frontier = common.saved(_frontier(beams, s), "frontier")
        if frontier.isEmpty():
            break
        found = _expanded(frontier, adjacency, s).withColumnsRenamed({"near": "near2", "sims": "sims2"})
        after = common.saved(_beamed(beams.join(found, "id", "left"), s), "beams")
        common.discard(beams)
        common.discard(frontier)
        beams = after
    graph.sparkSession.sql(f"DROP TABLE {name}")
    return beams


def _open(beams: DataFrame, errors: DataFrame, k: int) -> DataFrame:
    """query, node: of each beam all that may be among the k nearest, as far as the copies tell, and the query's own node."""

    def errors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, vec, near, sims in zip(*(c.to_pylist() for c in batch.columns)):
                near, sims = np.frombuffer(near, np.int64), np.frombuffer(sims, np.float32).astype(np.float64)
                scale, error = np.frombuffer(vec[:4], np.float32), np.frombuffer(vec[8:_HEAD], np.float32)
                length = float(np.linalg.norm(np.frombuffer(vec[_HEAD:], np.int8) * scale.astype(np.float64)))
                # Of two copies within their errors of vectors of length 1 at most, products differ by no more than this.
                slack = float(error[0]) + errors * (length + float(error[0])) + 1e-6
                low = sims[k - 1] - 2 * slack if len(sims) >= k else -np.inf
                some = near[sims >= low]
                out.append((np.full(len(some) + 1, own), np.r_[own, some]))
            q, n = (np.concatenate([np.empty(0, np.int64), *(x[i] for x in out)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(n.astype(np.int64))], names=["query", "node"])

    return beams.select("id", "vec", "near", "sims").mapInArrow(errors_of, "query long, node long")


def _largest_error(points: DataFrame) -> float:
    """How far any copy is from its original."""

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [float(np.frombuffer(v[8:_HEAD], np.float32)[0]) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.float64())], names=["error"])

    return points.select("vec").mapInArrow(errors, "error double").agg(F.max("error")).first()[0] or 0.0


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", s: Settings = Settings()
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query (a row of `queries`, by key).

    A query's own row is no candidate. Ties go to the smaller id, also among any number of
    equal vectors; fewer candidates than k give fewer rows; ids of queries that take no part
    (see usable) give none, and an empty table gives no rows. Other columns are not used.
    """
    taking = usable(rows, key, column)
    same = F.transform("vector", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    named = taking.select("id", same.alias("vector"))
    vectors = common.saved(named.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"), "nodes")
    members = common.saved(named.join(vectors.withColumnRenamed("id", "node"), "vector").select("node", "id"), "members")
    asked = queries.select(F.col(key).cast("long").alias("id")).distinct().join(members, "id")
    points = prepared(vectors)
    graph = descend(points, s)
    beams = search(graph, asked.select(F.col("node").alias("id")), s)
    pairs = _open(beams, _largest_error(points), k)
    own = vectors.select(F.col("id").alias("query"), F.col("vector").alias("q"))
    other = vectors.select(F.col("id").alias("node"), F.col("vector").alias("x"))
    product = F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    scored = pairs.join(other, "node").join(own, "query").select("query", "node", product.alias("score"))
    # The smallest ids of a node that any query can need: k, and one that may be the query itself.
    place = F.row_number().over(W.partitionBy("node").orderBy("id"))
    firsts = members.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    order = [F.desc("score"), F.col("id")]
    best_ids = scored.join(firsts, "node").withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(*order)))
    best_ids = common.saved(best_ids.where(F.col("place") <= k + 1).select("query", "id", "score"), "ranked")
    of = asked.select(F.col("id").alias("query_id"), F.col("node").alias("query")).join(best_ids, "query").where(F.col("id") != F.col("query_id"))
    ranked = of.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
