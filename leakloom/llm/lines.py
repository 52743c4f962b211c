"""Dropping lines that many documents share, by probing sharded minimal perfect hashes.

1. Every task reduces its documents to line hashes (128 bits) with a count and the largest
   doc_id; Spark adds those up and keeps hashes found in enough documents.
2. Those distinct hashes are sharded by value. Each shard becomes one row of arrays: the
   bit levels of a minimal perfect hash, and at the index it gives, a fingerprint (the
   other half of the line hash), the count and the largest doc_id.
3. Documents probe the arrays with the hashes of their lines. Hashes travel to the shards,
   lines never do; what comes back is the drops of each document.

The few hashes found in more than HEAVY documents are probed where documents are read, so
no shard gets an unbounded number of probes of one line. There are at most (number of
lines) / HEAVY of them, which bounds what is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, functions as F

from leakloom.llm import common

#: Hashes indexed by one shard and probes that it gets, on average.
SHARD_KEYS, SHARD_PROBES = 65_536, 500_000
#: Documents from which a line counts as heavy.
HEAVY = 1_000_000
#: Bits of a level for each hash that is still without a place.
GAMMA = 2
LEVELS = 48

_BLANKS = common.BLANKS.encode()


def keys_of(text: bytes, min_chars: int) -> Iterator[bytes | None]:
    """The hash of each line's key, None for lines whose key is too short to count."""
    for line in text.translate(common.LOWER).split(b"\n"):
        key = line.strip(_BLANKS)
        n = len(key)
        # A code point has four bytes at most.
        if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            yield xxhash.xxh3_128_digest(key)
        else:
            yield None


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())


def _counts(min_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc, text in _documents(batch):
                for key in set(keys_of(text or b"", min_chars)) - {None}:
                    if (entry := found.get(key)) is None:
                        found[key] = [1, doc]
                    else:
                        entry[0] += 1
                        if entry[1] is None or (doc is not None and doc > entry[1]):
                            entry[1] = doc
            halves = _halves(list(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([n for n, _ in found.values()], pa.int64()),
                 pa.array([last for _, last in found.values()], pa.int64())],
                names=["h1", "h2", "n", "last"],
            )

    return count


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = (h1 ^ (h2 + seed)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit numbers: bit levels and their ranks.

    At each level, a pair alone at its place sets that place's bit; the others go on to the
    next level. A pair's index is the number of set bits before its own. Pairs that reach
    no level of LEVELS (in theory only) come last, sorted.
    """

    def __init__(self, sizes: list[int], bits: bytes, left: np.ndarray):
        self.sizes, self.left = sizes, left
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        self.bits = np.split(flat, np.cumsum(sizes)[:-1]) if sizes else []
        ranks = np.cumsum(flat) - flat
        self.ranks = np.split(ranks, np.cumsum(sizes)[:-1]) if sizes else []
        self.placed = int(flat.sum())

    @staticmethod
    def levels(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
        sizes, bits = [], []
        while len(h1) and len(sizes) < LEVELS:
            size = max(64, GAMMA * len(h1))
            at = _place(h1, h2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        packed = np.packbits(np.concatenate(bits)).tobytes() if bits else b""
        return sizes, packed, np.sort(h1 ^ h2)

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Index of each pair; of a pair that was not built in: any index, or -1."""
        out = np.full(len(h1), -1, np.int64)
        todo = np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            at = _place(h1[todo], h2[todo], level, size)
            hit = self.bits[level][at]
            out[todo[hit]] = self.ranks[level][at[hit]]
            todo = todo[~hit]
        if len(self.left):
            rest = h1[todo] ^ h2[todo]
            at = np.minimum(np.searchsorted(self.left, rest), len(self.left) - 1)
            out[todo] = np.where(self.left[at] == rest, self.placed + at, -1)
        return out


INDEX = "shard int, sizes array<long>, bits binary, left_over binary, prints binary, counts binary, lasts binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's arrays. A largest doc_id of null is stored as the smallest number."""
    h1, h2 = pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64)
    sizes, bits, left = PerfectHash.levels(h1, h2)
    at = PerfectHash(sizes, bits, left).index(h1, h2)
    prints, counts, lasts = np.empty(len(at), np.uint64), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    prints[at], counts[at], lasts[at] = h2, pdf.n.to_numpy(), pdf["last"].to_numpy()
    return pd.DataFrame({
        "shard": [int(pdf["shard"].iloc[0])], "sizes": [sizes], "bits": [bits], "left_over": [left.tobytes()],
        "prints": [prints.tobytes()], "counts": [counts.tobytes()], "lasts": [lasts.tobytes()],
    })


NULL_ID = -(2**63)


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> tuple[DataFrame, int]:
    """h1, h2, n, last of the line keys found in at least min_docs documents, written once; and all lines' number."""
    counted = docs.select("doc_id", "text").mapInArrow(_counts(min_chars), "h1 long, h2 long, n long, last long")
    seen = Observation()
    total = counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    total = total.observe(seen, F.sum("n").alias("lines"))
    shared = common.saved(total.where(F.col("n") >= min_docs).fillna(NULL_ID, ["last"]), "shared-lines")
    return shared, seen.get["lines"] or 0


def index_of(shared: DataFrame, shards: int) -> DataFrame:
    """One row of arrays for each shard (INDEX); written once."""
    spread = shared.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return common.saved(spread.groupBy("shard").applyInPandas(_build, INDEX), "line-index")


PROBES = "shard int, row long, own long, key binary"


def _probes(min_chars: int, shards: int, heavy: dict[bytes, int]):
    """Keys of each document's lines with the shard to ask; drops of heavy lines right away (shard -1)."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owns, keys, done = [], [], [], []
            for row, (doc, text) in zip(batch.column("row").to_pylist(), _documents(batch)):
                own = NULL_ID if doc is None else doc
                for key in set(keys_of(text or b"", min_chars)) - {None}:
                    last = heavy.get(key)
                    if last is None or last != own:
                        rows.append(row)
                        owns.append(own)
                        keys.append(key)
                        done.append(last is not None)
            shard = np.where(np.array(done, bool), -1, _halves(keys)[:, 0] % shards)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(rows, pa.int64()), pa.array(owns, pa.int64()),
                 pa.array(keys, pa.binary())],
                names=["shard", "row", "own", "key"],
            )

    return probe


HITS = "row long, own long, key binary"


def _answer(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Probes of one shard that hit a line whose largest doc_id is another document's."""
    if index.empty or probes.empty:
        return probes[["row", "own", "key"]].iloc[:0]
    shard = index.iloc[0]
    perfect = PerfectHash([int(x) for x in shard.sizes], shard.bits, np.frombuffer(shard.left_over, np.uint64))
    halves = _halves(probes.key.to_list()).view(np.uint64)
    h1, h2 = halves[:, 0].copy(), halves[:, 1].copy()
    at = perfect.index(h1, h2)
    known = (at >= 0) & (np.frombuffer(shard.prints, np.uint64)[at] == h2)
    others = np.frombuffer(shard.lasts, np.int64)[at] != probes.own.to_numpy()
    return probes.loc[known & others, ["row", "own", "key"]]


def _rewriter(min_chars: int):
    @F.arrow_udf("kept string, n_lines long, n_dropped long")
    def rewrite(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, counts, dropped = [], [], []
        for text, drop in zip(texts.cast(pa.binary()).to_pylist(), drops.to_pylist()):
            text = text or b""
            n, gone = text.count(b"\n") + 1, 0
            if drop:
                left = [x for x, k in zip(text.split(b"\n"), keys_of(text, min_chars)) if k is None or k not in drop]
                text, gone = b"\n".join(left), n - len(left)
            kept.append(text)
            counts.append(n)
            dropped.append(gone)
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
            names=["kept", "n_lines", "n_dropped"],
        )

    return rewrite


def dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc (a struct of the columns of docs), kept (the text without shared lines), n_lines, n_dropped.

    A line's key is the line without ASCII blanks at both ends, A-Z in lower case. Keys of
    min_chars code points or more, found in min_docs rows or more, lose all their lines
    except in the largest doc_id that holds them. Rows are documents: repeated rows count
    each, and all rows with that doc_id keep the line; a null doc_id is smaller than any.
    Null or empty text is one empty line and becomes "". An empty table gives no rows.
    docs needs doc_id and text; other columns, whatever their names, stay in doc.
    """
    slim = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    shared, lines = shared_lines(slim, min_chars, min_docs)
    heavy = {
        np.array([r["h1"], r["h2"]], "<i8").tobytes(): r["last"]
        for r in shared.where(F.col("n") > HEAVY).toLocalIterator()
    }
    shards = max(1, -(-shared.count() // SHARD_KEYS), -(-lines // SHARD_PROBES))
    index = index_of(shared, shards)
    # Rows with the same id and text have the same drops, so that pair stands for the row.
    rows = slim.withColumn("row", F.xxhash64("doc_id", "text"))
    probes = rows.select("row", "doc_id", "text").mapInArrow(_probes(min_chars, shards, heavy), PROBES)
    asked = probes.where("shard >= 0").groupBy("shard").cogroup(index.groupBy("shard"))
    hits = asked.applyInPandas(_answer, HITS)
    if heavy:
        hits = hits.union(probes.where("shard < 0").drop("shard"))
    drops = hits.groupBy("row", "own").agg(F.collect_set("key").alias("drops")).hint("shuffle_hash")
    joined = rows.withColumn("own", F.coalesce("doc_id", F.lit(NULL_ID))).join(drops, ["row", "own"], "left")
    return joined.select("doc", _rewriter(min_chars)("text", "drops").alias("new")).select("doc", "new.*")
