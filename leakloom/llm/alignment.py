"""Cross-tokenizer alignment with external spill counting of linked id pairs.

Tokens of two tokenizers over the same bytes are cut into groups where both end, and every
A token links with every B token of its group. How many documents hold an id pair linked is
counted outside memory:

1. Spill: each task aligns its documents, gathers records (pair, document, times), and writes
   them as runs of RECORDS records, sorted by pair and radix-partitioned by A id. A piece of a
   run holds its pairs with their numbers of documents, in blocks, and apart from them the
   documents; both are zstd-compressed columns.
2. Count: the pieces of a partition are merged by a heap over their blocks. Order is by A id,
   then B id, so all pairs of an A id come out together, and with them its maximum.
3. Contribute: the counted pairs of a partition stream past the documents of its pieces, which
   adds up each document's part in the run; a partition with many bytes is dealt to several
   tasks that each get the counted pairs. The parts of a run are added up and meet its rows.

Counts travel pre-aggregated (one number per pair and run), documents stay in packed columns,
and texts are read once. Runs, counted pairs and sums are tables in the shared folder, so a
lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from leakloom.llm import common

#: Records of a run; its columns take 16 bytes a record in memory.
RECORDS = 1_000_000
#: Radix partitions by A id.
RADIX = 64
#: Pairs of a compressed block.
BLOCK = 8_192
#: Compressed bytes of documents that one task contributes to; partitions with more are dealt out.
DEALT = 4 << 20
#: Bounds of a worker's memory of aligned words: entries and characters.
CACHE_WORDS, CACHE_CHARS = 400_000, 12_000_000
#: Documents aligned together, and new words in one string for the tokenizers.
SLICE, STRING = 256, 2_000
#: Links of a group up to which they are listed one by one.
WIDE = 65_536


# Columns


def packed(column: np.ndarray) -> bytes:
    """A column of integers, zstd-compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def steps(column: np.ndarray) -> np.ndarray:
    """A rising column as differences, which compress well."""
    return np.diff(column, prepend=column.dtype.type(0))


# Alignment


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def a_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    of = _byte_of()
    out = [b""] * (max(vocabulary.values()) + 1)
    for word, i in vocabulary.items():
        out[i] = bytes(of[c] for c in word) if all(c in of for c in word) else word.encode()
    return out


def b_bytes(model) -> list[bytes]:
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Part(NamedTuple):
    """Aligned tokens of a word or text."""

    text: bytes  # the groups written out, each closed by ";"
    pairs: bytes  # A id above B id of every link, or of distinct ones if times are given
    sizes: bytes  # numbers of A tokens, of B tokens and of groups
    times: bytes = b""


class Aligner:
    """Alignment of whole texts, word by word where that gives the same.

    Both vocabularies begin a token at a blank or line end that stands alone between other
    characters, so texts without other white space are aligned as their words, each with the
    blank or line end before it; words are aligned once, many in one string, and kept. All
    other texts are aligned whole. Strings of special tokens are ordinary text.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_file=b_path)
        self._bytes = a_bytes(self._a.get_vocab()), b_bytes(self._b)
        self._size = [np.array([len(x) for x in side], np.int64) for side in self._bytes]
        # Each id as it is written before a token of its side, and as the last of them in its group.
        numbers = [[b"%d" % i for i in range(len(side))] for side in self._bytes]
        signs = ((numbers[0], b","), (numbers[0], b"|"), (numbers[1], b","), (numbers[1], b";"))
        self._written = [x + sign for of, sign in signs for x in of]
        self._written_size = np.array([len(x) for x in self._written], np.int64)
        self._places = np.cumsum([0, *(len(of) for of, _ in signs)])[:4]
        self._known: dict[str, Part | None] = {}
        self._chars = 0

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides for a blank and the text; B puts the blank there itself."""
        a = self._a.encode(f" {text}", add_special_tokens=False).ids
        return np.array(a, np.int64), np.array(self._b.encode(text, num_threads=1), np.int64)

    def _same(self, ids: tuple[np.ndarray, np.ndarray], data: bytes) -> bool:
        return all(b"".join([of[i] for i in side.tolist()]) == data for of, side in zip(self._bytes, ids))

    def _parts(self, ids: tuple[np.ndarray, np.ndarray], sizes: list[int]) -> list[Part]:
        """Parts of consecutive stretches of so many bytes. Both sides cover the same bytes and end a token where a stretch ends."""
        ends = [np.cumsum(size[i]) for size, i in zip(self._size, ids)]
        cuts = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        n = [np.bincount(g, minlength=len(cuts)) for g in group]
        last = np.searchsorted(cuts, np.cumsum(sizes)) + 1  # groups up to the end of each stretch
        # Written out: by group, A before B, the last of a side with its own sign.
        at = [np.cumsum(m) for m in n]  # tokens up to the end of each group
        shown = []
        for side in (0, 1):
            closing = np.zeros(len(ids[side]), np.int64)
            closing[at[side] - 1] = 1
            shown.append(ids[side] + self._places[2 * side + closing])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        shown = np.concatenate(shown)[order]
        text = b"".join([self._written[i] for i in shown.tolist()])
        tokens = np.r_[0, at[0] + at[1]]  # of both sides up to each group
        letters = np.r_[0, np.cumsum(self._written_size[shown])][tokens[np.r_[0, last]]].tolist()
        counts = np.diff(np.stack([np.r_[0, at[0]], np.r_[0, at[1]], np.arange(len(cuts) + 1)], axis=1)[np.r_[0, last]], axis=0)
        if (n[0] * n[1] > WIDE).any():
            links = [self._wide(*(ids[k][np.r_[0, at[k]][i] : at[k][j - 1]] for k in (0, 1)), n[0][i:j], n[1][i:j]) for i, j in zip(np.r_[0, last], last)]
            return [Part(text[i:j], p, c.tobytes(), t) for i, j, (p, t), c in zip(letters, letters[1:], links, counts)]
        times = n[1][group[0]]  # links of each A token
        upto = np.cumsum(times)
        other = np.arange(int(times.sum())) + np.repeat((at[1] - n[1])[group[0]] - (upto - times), times)
        pairs = (np.repeat(ids[0], times) << 32 | ids[1][other]).tobytes()
        linked = (8 * np.r_[0, np.cumsum(n[0] * n[1])][np.r_[0, last]]).tolist()
        data, row = counts.tobytes(), counts.itemsize * 3
        return [
            Part(text[i:j], pairs[x:y], data[k : k + row])
            for i, j, x, y, k in zip(letters, letters[1:], linked, linked[1:], range(0, len(data), row))
        ]

    @staticmethod
    def _wide(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[bytes, bytes]:
        """Distinct pairs and their links, group by group, where a group has too many links to list."""
        found: Counter = Counter()
        for x, y in zip(np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1])):
            of_b = Counter(y.tolist()).items()
            for i, n in Counter(x.tolist()).items():
                for j, m in of_b:
                    found[i << 32 | j] += n * m
        return np.array(list(found), np.int64).tobytes(), np.array(list(found.values()), np.int64).tobytes()

    def whole(self, text: str) -> Part | None:
        """None if the text is empty or the tokens of a side are not the text."""
        if not text:
            return None
        ids, data = self._encode(text), f" {text}".encode()
        return self._parts(ids, [len(data)])[0] if self._same(ids, data) else None

    def _learn(self, words: set[str]) -> None:
        """None for words with other white space or the blank's sign in them, and those that a vocabulary changes."""
        new = words.difference(self._known)
        if len(self._known) + len(new) > CACHE_WORDS or self._chars > CACHE_CHARS:
            self._known.clear()
            self._chars, new = 0, words
        plain = [w for w in new if "▁" not in w and [w[1:] if w[:1] == "\n" else w] == w.split()]
        self._known.update(dict.fromkeys(new))
        self._chars += sum(map(len, new))
        for low in range(0, len(plain), STRING):
            self._learn_some(plain[low : low + STRING])

    def _learn_some(self, words: list[str]) -> None:
        some = [w if w[0] == "\n" else f" {w}" for w in words]
        joined = "x" + "".join(some)  # B puts a blank before the first word
        ids, data = self._encode(joined), f" {joined}".encode()
        if self._same(ids, data):
            sizes = [2, *(len(w.encode()) for w in some)]
            self._known.update(zip(words, self._parts(ids, sizes)[1:]))
        elif len(words) > 1:  # a word among them is changed
            half = len(words) // 2
            self._learn_some(words[:half])
            self._learn_some(words[half:])

    def __call__(self, texts: list[str | None]) -> list[list[Part] | None]:
        """The parts of each text; None for texts that have no tokens."""
        split = [f" {t}".replace("\n", " \n").split(" ")[1:] if t else [] for t in texts]
        self._learn(set().union(*split))
        out, known = [], self._known
        for text, words in zip(texts, split):
            parts = list(map(known.__getitem__, words))
            if not parts or any(p is None for p in parts):
                part = self.whole(text) if text else None
                parts = None if part is None else [part]
            out.append(parts)
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner for two vocabularies; its memory serves all tasks of the worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


# 1. Spill

DOCS = "run long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PIECES = "run long, bucket int, n_docs int, keys array<binary>, held binary, docs binary, links binary"

_DOCS_SCHEMA = [
    ("run", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
]
_SPILL = pa.schema([
    *_DOCS_SCHEMA, ("bucket", pa.int32()), ("n_docs", pa.int32()), ("keys", pa.list_(pa.binary())),
    ("held", pa.binary()), ("docs", pa.binary()), ("links", pa.binary()),
])


class _Run:
    """The records of consecutive documents of a task, up to RECORDS and one document's."""

    def __init__(self, number: int):
        self.number = number
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, parts: list[Part] | None) -> None:
        if parts is None:
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            pairs = links = np.empty(0, np.int64)
        else:
            text, pairs, sizes, times = zip(*parts)
            if any(times):
                links = [np.frombuffer(t, np.int64) if t else np.ones(len(p) // 8, np.int64) for p, t in zip(pairs, times)]
                pairs, at = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_inverse=True)
                of, links = np.concatenate(links), np.zeros(len(pairs), np.int64)
                np.add.at(links, at, of)
            else:
                pairs, links = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
            sums = np.frombuffer(b"".join(sizes), np.int64).reshape(-1, 3).sum(axis=0).tolist()
            digest = hashlib.sha256(b"".join(text)[:-1]).hexdigest()
            self.rows.append((doc_id, *sums, int(links.sum()), digest))
        self.pairs.append(pairs)
        self.links.append(links)
        self.size += len(pairs)

    def written(self) -> Iterator[pa.RecordBatch]:
        n = len(self.rows)
        nulls = lambda m, kinds: [pa.nulls(m, f.type) for f in kinds]
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*self.rows), _DOCS_SCHEMA[2:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([self.number] * n, pa.int64()), pa.array(range(n), pa.int32()), *columns, *nulls(n, list(_SPILL)[8:])], schema=_SPILL
        )
        keys = np.concatenate(self.pairs)
        docs = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in self.pairs])
        links = np.concatenate(self.links)
        order = np.lexsort((docs, keys, (keys >> 32) % RADIX))
        keys, docs, links = keys[order], docs[order], links[order]
        ends = np.searchsorted((keys >> 32) % RADIX, np.arange(RADIX + 1))
        out = [
            (b, *_piece(keys[i:j], docs[i:j], links[i:j])) for b, (i, j) in enumerate(zip(ends, ends[1:])) if j > i
        ]
        m = len(out)
        if m:
            bucket, blocks, held, doc, link = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.number] * m, pa.int64()), *nulls(m, list(_SPILL)[1:8]), pa.array(bucket, pa.int32()),
                 pa.array([n] * m, pa.int32()), pa.array(blocks, pa.list_(pa.binary())), pa.array(held, pa.binary()),
                 pa.array(doc, pa.binary()), pa.array(link, pa.binary())],
                schema=_SPILL,
            )


def _piece(keys: np.ndarray, docs: np.ndarray, links: np.ndarray) -> tuple[list[bytes], bytes, bytes, bytes]:
    """Blocks of distinct pairs, the number of documents of each, and each record's document and links."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    held = np.diff(np.r_[starts, len(keys)]).astype(np.int32)
    distinct = keys[starts]
    blocks = [packed(steps(distinct[i : i + BLOCK])) for i in range(0, len(distinct), BLOCK)]
    return blocks, packed(held), packed(np.diff(docs, prepend=np.int32(0))), packed(links)


def spilled(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of documents (DOCS) and pieces of runs (PIECES); written once."""

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, seq = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        run = _Run(part << 32)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                rows = batch.slice(low, SLICE)
                for doc_id, parts in zip(rows.column(0).to_pylist(), of(rows.column(1).to_pylist())):
                    run.add(doc_id, parts)
                    if run.size >= RECORDS:
                        yield from run.written()
                        seq += 1
                        run = _Run(part << 32 | seq)
        if run.rows:
            yield from run.written()

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"{DOCS}, {PIECES.removeprefix('run long, ')}"
    both = common.saved(slim.mapInArrow(spill, schema), "spill")
    names = lambda s: [c.split()[0] for c in s.split(", ")]
    return both.where("at IS NOT NULL").select(*names(DOCS)), both.where("bucket IS NOT NULL").select(*names(PIECES))


# 2. Count


class _Cursor:
    """The pairs of a piece and their numbers of documents, one block at a time."""

    def __init__(self, blocks: list[bytes], held: bytes):
        self._blocks, self._at = iter(blocks), 0
        self._held = held
        self.keys = np.empty(0, np.int64)
        self.next()

    def next(self) -> bool:
        block = next(self._blocks, None)
        if block is None:
            return False
        self.keys = np.cumsum(unpacked(block, np.int64))
        if isinstance(self._held, bytes):
            self._held = unpacked(self._held, np.int32)
        self.counts = self._held[self._at : self._at + len(self.keys)].astype(np.int64)
        self._at += len(self.keys)
        return True

    def take(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs up to bound, which leave the block."""
        n = int(np.searchsorted(self.keys, bound, "right"))
        out = self.keys[:n], self.counts[:n]
        self.keys, self.counts = self.keys[n:], self.counts[n:]
        return out


def merged(pieces: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rising stretches of distinct pairs and their summed numbers, by a heap over the pieces' blocks.

    The stretch up to the smallest last pair of all open blocks is complete: no piece has an
    earlier pair still to come.
    """
    cursors = [_Cursor(*p) for p in pieces]
    first = [(int(c.keys[0]), i) for i, c in enumerate(cursors)]
    last = [(int(c.keys[-1]), i) for i, c in enumerate(cursors)]
    heapq.heapify(first)
    heapq.heapify(last)
    while first:
        bound = last[0][0]
        taken = []
        while first and first[0][0] <= bound:
            _, i = heapq.heappop(first)
            c = cursors[i]
            taken.append(c.take(bound))
            if len(c.keys):
                heapq.heappush(first, (int(c.keys[0]), i))
        while last and last[0][0] <= bound:
            _, i = heapq.heappop(last)
            if cursors[i].next():
                heapq.heappush(first, (int(cursors[i].keys[0]), i))
                heapq.heappush(last, (int(cursors[i].keys[-1]), i))
        keys = np.concatenate([k for k, _ in taken])
        counts = np.concatenate([n for _, n in taken])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield keys[starts], np.add.reduceat(counts, starts)


def judged(stretches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of whole A ids, with a mark where the number is the A id's highest."""
    rest = (np.empty(0, np.int64), np.empty(0, np.int64))
    for stretch in stretches:
        keys, counts = (np.concatenate(x) for x in zip(rest, stretch))
        cut = int(np.searchsorted(keys, keys[-1] >> 32 << 32))  # the last A id may go on
        rest = keys[cut:], counts[cut:]
        if cut:
            yield keys[:cut], counts[:cut], _highest(keys[:cut], counts[:cut])
    if len(rest[0]):
        yield *rest, _highest(*rest)


def _highest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    a = keys >> 32
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    most = np.maximum.reduceat(counts, starts)
    return counts == np.repeat(most, np.diff(np.r_[starts, len(a)]))


COUNTED = "bucket int, seq int, keys binary, counts binary, best binary"


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list]]:
    """Each bucket with the rows of it, of batches sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield now, rows


def counted(pieces: DataFrame) -> DataFrame:
    """The pairs of each bucket with their numbers of documents and marks, packed in rising stretches; written once.

    A task holds the compressed pairs of a bucket's pieces, at most the distinct pairs of a
    run each, and of every piece one open block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches, ["bucket", "keys", "held"]):
            for seq, (keys, counts, best) in enumerate(judged(merged(rows))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([seq], pa.int32()), pa.array([packed(steps(keys))], pa.binary()),
                     pa.array([packed(counts)], pa.binary()), pa.array([packed(best.astype(np.uint8))], pa.binary())],
                    names=["bucket", "seq", "keys", "counts", "best"],
                )

    slim = pieces.select("bucket", "keys", "held").repartition("bucket").sortWithinPartitions("bucket")
    return common.saved(slim.mapInArrow(count, COUNTED), "counted-pairs")


def pairs(count: DataFrame) -> DataFrame:
    """The counted pairs as rows: a, b, docs, best."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts, best in zip(*(batch.column(n).to_pylist() for n in ("keys", "counts", "best"))):
                keys = np.cumsum(unpacked(keys, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(unpacked(counts, np.int64)), pa.array(unpacked(best, np.uint8) > 0)],
                    names=["a", "b", "docs", "best"],
                )

    return count.mapInArrow(flat, "a long, b long, docs long, best boolean")


# 3. Contribute

SUMS = "run long, best binary, total binary"


def contributions(pieces: DataFrame, count: DataFrame) -> DataFrame:
    """Of each piece, its documents' links with a highest number and sums of numbers over links, packed by place in the run.

    The counted pairs of a bucket go to each of its tasks, and the pieces one by one past them.
    """
    sizes = pieces.groupBy("bucket").agg(F.sum(F.octet_length("docs") + F.octet_length("links")).alias("bytes"))
    dealt = sizes.select("bucket", F.ceil(F.col("bytes") / DEALT).cast("int").alias("tasks"))
    own = pieces.join(F.broadcast(dealt), "bucket")  # RADIX rows
    own = own.select(
        "bucket", F.pmod(F.xxhash64("run"), F.col("tasks")).cast("int").alias("task"), F.lit(-1).alias("seq"),
        "run", "n_docs", "keys", "held", "docs", "links",
    )
    none = lambda kind: F.lit(None).cast(kind)
    shared = count.join(F.broadcast(dealt), "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "seq",
        none("long").alias("run"), none("int").alias("n_docs"), F.array("keys").alias("keys"),
        F.col("counts").alias("held"), F.col("best").alias("docs"), none("binary").alias("links"),
    )

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "task", "seq", "run", "n_docs", "keys", "held", "docs", "links"]
        now, known, table = None, [], None
        for batch in batches:
            for bucket, task, seq, run, n_docs, keys, held, docs, links in zip(*(batch.column(n).to_pylist() for n in names)):
                if (bucket, task) != now:
                    now, known, table = (bucket, task), [], None
                if seq >= 0:  # stretches of counted pairs come first, in order
                    known.append((np.cumsum(unpacked(keys[0], np.int64)), unpacked(held, np.int64), unpacked(docs, np.uint8)))
                    continue
                if table is None:
                    table, known = [np.concatenate(x) for x in zip(*known)], []
                of = np.concatenate([np.cumsum(unpacked(k, np.int64)) for k in keys])
                at = np.repeat(np.searchsorted(table[0], of), unpacked(held, np.int32))
                doc, times = np.cumsum(unpacked(docs, np.int32)), unpacked(links, np.int64)
                best, total = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
                np.add.at(best, doc, times * table[2][at])
                np.add.at(total, doc, times * table[1][at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run], pa.int64()), pa.array([packed(best)], pa.binary()), pa.array([packed(total)], pa.binary())],
                    names=["run", "best", "total"],
                )

    both = shared.unionByName(own).repartition("bucket", "task")
    ordered = both.sortWithinPartitions("bucket", "task", F.col("seq") < 0, "seq")
    return common.saved(ordered.mapInArrow(contribute, SUMS), "contributions")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs.

    Paths of vocabularies that every worker can open. Texts that are null or empty, or that
    a vocabulary changes, have no tokens: zeros and an empty digest. Each row is a document,
    also rows with equal or null ids; ties for an A id's highest number all count; a very long
    text is one document of one run, aligned whole; an empty table gives no rows. Other
    columns of docs are not used.
    """
    rows, pieces = spilled(docs, a_path, b_path, key, text)
    sums = contributions(pieces, counted(pieces))
    names = [c.split()[0] for c in DOCS.split(", ")]
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select(*names, none("binary").alias("best"), none("binary").alias("total")).unionByName(
        sums.select("run", "best", "total"), allowMissingColumns=True
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, best, total = None, None, None
        for batch in batches:
            out = []
            of = [batch.column(n).to_pylist() for n in (*names, "best", "total")]
            for this, at, doc_id, n_a, n_b, n_groups, n_links, digest, some, more in zip(*of):
                if this != run:
                    run, best, total = this, None, None
                if at is None:  # sums come first
                    some, more = unpacked(some, np.int64), unpacked(more, np.int64)
                    best, total = (some, more) if best is None else (best + some, total + more)
                else:
                    sums = (0, 0) if best is None else (int(best[at]), int(total[at]))
                    out.append((doc_id, n_a, n_b, n_groups, n_links, *sums, digest))
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    ordered = both.repartition("run").sortWithinPartitions("run", F.col("at").isNotNull(), "at")
    return ordered.mapInArrow(finish, RESULT)
