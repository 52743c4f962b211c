"""Near duplicates by SimHash, with pivot distance tables.

Fingerprints link when they differ in LIMIT bits or fewer. For every distinct fingerprint
the Hamming distances to PIVOTS fixed reference fingerprints are computed once. By the
triangle inequality no coordinate of two linked fingerprints differs by more than LIMIT,
so a pair whose largest coordinate difference is above that is discarded; the survivors
are verified on the fingerprints.

Coordinates alone leave a fixed share of all pairs, so rows of the table meet by place:
LIMIT differing bits leave at least BLOCKS - LIMIT of BLOCKS bit ranges equal, and only rows
that agree on some choice of that many ranges are compared. That loses no link. A place
compares in blocks and passes on a spanning tree of its links, not all pairs. Places that a
sample shows to be hot are cut into chunks, and every pair of chunks is a task's of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from leakloom.llm import common
from leakloom.llm.components import components

SHINGLE = 3
LIMIT = 3
BLOCKS = 6
PIVOTS = np.random.Generator(np.random.PCG64(2)).integers(0, 2**64, size=16, dtype=np.uint64)

#: Rows of a place that are compared at a time.
BLOCK = 512
#: Rows of a chunk of a hot place, and one in how many rows is counted to find them.
HOT, COUNTED = 20_000, 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's word triples: a bit is set if it is in over half the hashes."""
    words = text.translate(common.LOWER).split()
    n = len(words)
    if not n:
        return 0
    data = b" ".join(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(data, 42)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join(
        [digest(data[a:b], 42) for a, b in zip((ends - sizes)[: n - 2].tolist(), ends[2:].tolist())]
    )
    lanes = np.frombuffer(hashes, np.uint8).reshape(-1, 8) + _LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > n - 2).tobytes(), "big")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (a hash of id and text) and fp (as signed 64 bits) of each document; written once."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _signed([fingerprint(t or b"") for t in texts])],
                names=["doc_id", "row", "fp"],
            )

    doc, words = F.col(key).cast("long"), F.col(text).cast("string")
    slim = docs.select(doc.alias("doc_id"), F.xxhash64(doc, words).alias("row"), words.alias("text"))
    return common.saved(slim.mapInArrow(compute, "doc_id long, row long, fp long"), "fingerprints")


def distance_table(fps: DataFrame) -> DataFrame:
    """fp and table, the distances to the pivots in one byte each."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows = np.bitwise_count(fp[:, None] ^ PIVOTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["fp", "table"]
            )

    return fps.select("fp").mapInArrow(measure, "fp long, table binary")


def _masks() -> list[int]:
    """One mask for each choice of bit ranges that may have to be equal."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    ranges = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(ranges, BLOCKS - LIMIT)]


def _signed_int(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def places(table: DataFrame) -> DataFrame:
    """Every row once for each choice of ranges: choice, place (the bits in them), fp, table."""
    masks = F.array(*(F.lit(_signed_int(m)).cast("long") for m in _masks()))
    spread = table.select("fp", "table", F.posexplode(masks).alias("choice", "mask"))
    return spread.select(F.col("choice").cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("place"), "fp", "table")


def chunked(spread: DataFrame) -> DataFrame:
    """Adds chunks: null in ordinary places, else once for each pair of chunks that the row's chunk is in."""
    counted = spread.where(F.pmod(F.xxhash64("fp"), F.lit(COUNTED)) == 0).groupBy("choice", "place").count()
    hot = counted.where(F.col("count") * COUNTED > HOT).select("choice", "place", F.ceil(F.col("count") * COUNTED / HOT).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("n")).cast("int")
    pair = lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"))
    pairs = F.when(F.col("n").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("n") - 1), pair))
    found = spread.join(hot, ["choice", "place"], "left").withColumn("own", own)
    return found.select("choice", "place", "fp", "table", F.explode_outer(pairs).alias("chunks"))


class _Forest:
    """Component labels of the rows of a batch; the label is the smallest row reachable."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                return
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label[:] = label[label]


def linked(fp: np.ndarray, table: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the rows that stand for their components, for rows sorted by group."""
    n = len(fp)
    forest = _Forest(n)
    table = table.astype(np.int8)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, n])

    def test(i: np.ndarray, j: np.ndarray) -> None:
        near = np.abs(table[i] - table[j]).max(axis=1) <= LIMIT
        i, j = i[near], j[near]
        same = np.bitwise_count(fp[i] ^ fp[j]) <= LIMIT
        forest.link(i[same], j[same])

    small = np.repeat(sizes <= BLOCK, sizes)
    for step in range(1, int(sizes[sizes <= BLOCK].max(initial=1))):
        i = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]))
        test(i, i + step)
    for start, size in zip(starts[sizes > BLOCK], sizes[sizes > BLOCK]):
        # In order of the first coordinate, a row only meets those within LIMIT of it.
        order = start + np.argsort(table[start : start + size, 0], kind="stable")
        first = table[order, 0]
        for low in range(0, size, BLOCK):
            rows = order[low : low + BLOCK]
            end = np.searchsorted(first, first[min(low + BLOCK, size) - 1] + LIMIT, side="right")
            for other in range(low, end, BLOCK):
                cols = order[other : min(other + BLOCK, end)]
                near = np.ones((len(rows), len(cols)), bool)
                for c in range(table.shape[1]):
                    near &= np.abs(table[rows, c][:, None] - table[cols, c][None, :]) <= LIMIT
                i, j = np.nonzero(near)
                same = np.bitwise_count(fp[rows[i]] ^ fp[cols[j]]) <= LIMIT
                forest.link(rows[i[same]], cols[j[same]])
    moved = np.flatnonzero(forest.label != np.arange(n))
    return moved, forest.label[moved]


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect the distinct fingerprints (fp) as all links within LIMIT do."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of a group that may go on in the next batch
        for batch in chain(batches, [None]):
            ready = None
            if batch is None:
                ready, held = held, []
            elif batch.num_rows:
                keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "place", "i", "j")]
                fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                table = np.frombuffer(b"".join(batch.column("table").to_pylist()), np.uint8).reshape(len(fp), -1)
                rows = (*keys, fp, table)
                other = np.zeros(len(fp), bool)
                for k in keys:
                    other |= k != k[-1]
                cut = int(np.flatnonzero(other).max(initial=-1)) + 1
                if cut or held and any(h[-1] != k[0] for h, k in zip(held[-1], keys)):
                    ready, held = [*held, tuple(x[:cut] for x in rows)], []
                held.append(tuple(x[cut:] for x in rows))
            if ready:
                yield result(*(np.concatenate(x) for x in zip(*ready)))

    def result(choice, place, i, j, fp, table) -> pa.RecordBatch:
        new = np.zeros(len(fp), bool)
        for k in (choice, place, i, j):
            new[1:] |= k[1:] != k[:-1]
        moved, to = linked(fp, table, np.cumsum(new))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[to].view(np.int64))], names=["a", "b"])

    keys = ["choice", "place", "i", "j"]
    none = F.lit(-1)
    met = chunked(places(distance_table(fps))).select(
        "choice", "place", F.coalesce("chunks.i", none).alias("i"), F.coalesce("chunks.j", none).alias("j"), "fp", "table"
    )
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, fp, root, component_id of each row of docs.

    fp is the fingerprint as a signed number, root the component's smallest fp and
    component_id its smallest doc_id (null only if no row in it has an id). Null, empty and
    blank texts have fingerprint 0; repeated rows share all columns; an empty table gives no
    rows. Other columns of docs are not carried.
    """
    rows = fingerprints(docs, key, text)
    distinct = common.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct)).withColumnRenamed("a", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.select("fp", "root").join(least, "root")
    return rows.join(of, "fp").select("doc_id", "row", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest id stays (then smallest row hash)."""
    found = near_duplicates(docs, key, text)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    first = found.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.row").alias("_row"), F.col("x.id").alias("_id"))
    own = F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string"))
    packed = docs.select(F.struct("*").alias("doc"), own.alias("_row"), F.col(key).cast("long").alias("_own"))
    kept = packed.join(first, ["_row"]).where(F.col("_own").eqNullSafe(F.col("_id")))
    return kept.dropDuplicates(["_row"]).select("doc.*")
