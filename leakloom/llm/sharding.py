"""Placing rows in shards by a hierarchical weighted hash tree, and numbering them there.

A row descends region, rack and shard. At each node every child draws ``-ln(u) / weight``
with ``u`` hashed from the row's key and the child's name, and the smallest draw takes the
row. A child's weight is the sum of its shards' weights, so shares follow the weights.

Draws depend on a child's own name and weight only. When one weight changes, only rows won
or lost by that child move at that level, and only subtrees on the path to the change see
any movement. A subtree of its own for a new shard therefore takes rows into itself only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leakloom.llm import common

#: Rows of one partition that are numbered together; bounds a numbering group for any key.
CHUNK = 65_536


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, racks: int = 2, per_rack: int = 4, base: int = 24) -> list[Leaf]:
    """Equal shards: the first `base` fill regions of racks, every later one opens a region.

    With that, `layout(n + 1)` moves rows into shard n only, for n >= base.
    """
    leaves = []
    for s in range(min(shards, base)):
        region, rest = divmod(s, racks * per_rack)
        leaves.append(Leaf(f"g{region}", f"g{region}/r{rest // per_rack}", s))
    return leaves + [Leaf(f"x{s}", f"x{s}/r0", s) for s in range(base, shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(2**53))) / F.lit(float(weight))


def _descend(key: Column, level: int, leaves: Sequence[Leaf]) -> Column:
    """The shard that the row reaches below a node; level 0 chooses the region."""
    if level == 3:
        return F.lit(leaves[0].shard)
    children: dict[object, list[Leaf]] = {}
    for leaf in leaves:
        children.setdefault(leaf[level], []).append(leaf)
    names = sorted(children, key=str)
    if len(names) == 1:
        return _descend(key, level + 1, children[names[0]])
    draws = [
        F.struct(_draw(key, f"{level}:{n}", sum(x.weight for x in children[n])).alias("draw"), F.lit(i).alias("child"))
        for i, n in enumerate(names)
    ]
    below = [_descend(key, level + 1, children[n]) for n in names]

    def choose(winner: Column) -> Column:
        out = F.when(winner == 0, below[0])
        for i in range(1, len(below)):
            out = out.when(winner == i, below[i])
        return out

    return common.bind(F.array_min(F.array(*draws))["child"], choose)


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of a key (null is a key like any other). No shuffle; leaves describe the cluster.

    Weights are positive; a drained shard is left out of the leaves.
    """
    if not leaves:
        raise ValueError("a tree needs at least one leaf")
    if len({x.shard for x in leaves}) < len(leaves) or any(x.weight <= 0 for x in leaves):
        raise ValueError("shards are distinct and weights positive")
    return _descend(F.coalesce(key.cast("string"), F.lit("\0")), 0, leaves)


def numbered(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with a gapless number from 0 within each shard, by two passes of prefix sums.

    Rows are written once with their place (partition and running number) and counted per
    shard and chunk of CHUNK places; offsets are running sums of those counts. No group
    holds more than CHUNK rows, whatever the shares of shards and keys are. Pass slim rows.
    """
    at = F.monotonically_increasing_id()
    placed = common.saved(df.withColumn("_at", at), "slots").withColumn("_chunk", F.floor(F.col("_at") / CHUNK))
    counts = placed.groupBy(shard, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(shard).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(shard, "_chunk").orderBy("_at")
    rows = placed.withColumn("_row", F.row_number().over(within))
    return (
        rows.join(offsets, [shard, "_chunk"])
        .withColumn(slot, (F.col("_before") + F.col("_row") - 1).cast("long"))
        .select(*df.columns, slot)
    )


def assign(
    docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf] | None = None,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Placement of each document: doc_id, size, text_crc32, shard, slot, grown_shard.

    size is the UTF-8 length plus 8. Null text: no bytes; null key: one key of its own.
    Repeated rows get the same shard and slots of their own; an empty table gives no rows.
    Other columns of docs are not carried; texts are never shuffled.
    """
    data = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(data) + F.lit(8)).cast("long").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), leaves).cast("int").alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    return numbered(slim)


def write_shards(docs: DataFrame, leaves: Sequence[Leaf], path: str, key: str = "doc_id") -> None:
    """Write the documents as Parquet, one folder per shard. No shuffle: tasks write what they read."""
    docs.withColumn("shard", shard_of(F.col(key), leaves)).write.partitionBy("shard").parquet(path)
