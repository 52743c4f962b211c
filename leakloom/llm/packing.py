"""Packing documents into token sequences: concatenate and cut.

Two passes of prefix sums place every document in one endless row of tokens. The first
pass tokenizes and writes the ids, with each document's start inside its partition. The
second adds the running sum of the partition totals, which gives global starts, and cuts
the row into fixed windows; a document becomes one boundary record (piece) for each window
that it touches. Only the last window has padding.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from leakloom.llm import common

#: Bounds of the word cache of a Python worker: entries, and characters in their keys.
CACHE_WORDS, CACHE_CHARS = 700_000, 16_000_000
#: Documents encoded together, and new words in one string for the tokenizer.
SLICE, STRING = 512, 2_000


class CachedEncoder:
    """Token ids of texts as little-endian 32-bit integers, the same as encoding each whole.

    A byte-level vocabulary never joins characters across a single blank or line end that
    stands between other characters, so the ids of a text are those of its words, each with
    the blank or line end before it. Words are encoded once and kept; new words are encoded
    many at a time, and cut where a token begins with a blank or line end. Texts with other
    white space are encoded whole, and so are those that hold the string of an added token,
    which becomes that token, as the library has it by default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = [t.content for t in added]
        words = self._tokenizer.get_vocab()
        self._begins = np.zeros(max(words.values()) + 1, bool)
        # Byte-level vocabularies write a blank as U+0120 and a line end as U+010A.
        self._begins[[i for w, i in words.items() if w[0] in "\u0120\u010a"]] = True
        self._known: dict[str, bytes | None] = {}
        self._chars = 0
        self._line_end = len(self._encode(["\n"])[0])

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, words: set[str]) -> None:
        """None for a word with white space in it, or none but that: its text is encoded whole."""
        new = words.difference(self._known)
        if len(self._known) + len(new) > CACHE_WORDS or self._chars > CACHE_CHARS:
            self._known.clear()
            self._chars = 0
            new = words
        plain = [w for w in new if [w[1:] if w[:1] == "\n" else w] == w.split()]
        self._known.update(dict.fromkeys(new))
        self._chars += sum(map(len, new))
        strings = [plain[i : i + STRING] for i in range(0, len(plain), STRING)]
        joined = ["".join([w if w[0] == "\n" else f" {w}" for w in x]) for x in strings]
        for some, data in zip(strings, self._encode(joined)):
            cuts = (np.flatnonzero(self._begins[np.frombuffer(data, "<u4")]) * 4).tolist()
            assert len(cuts) == len(some)
            self._known.update(zip(some, [data[i:j] for i, j in zip(cuts, [*cuts[1:], len(data)])]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        # Every line begins with its "\n"; other words stand for themselves after a blank.
        plain = [not any(a in t for a in self._added) for t in texts]
        split = [f"\n{t}".replace("\n", " \n").split(" ")[1:] if p else [] for t, p in zip(texts, plain)]
        self._learn(set().union(*split))
        out, known = [], self._known
        for text, words in zip(texts, split):
            try:
                if not words:
                    raise TypeError
                out.append(b"".join(map(known.__getitem__, words))[self._line_end :])
            except TypeError:  # a word that is None, or an added token in the text
                out.append(self._encode([text])[0])
        return out


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """The worker's encoder for a vocabulary; its cache serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


TOKENS = "doc_id long, part int, start long, n long, ids binary"


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each document (closed by end_id), its partition and its start there; written once.

    vocabulary is a path that every worker can open. Null text counts as empty.
    """
    end = array("I", [end_id]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        schema = pa.schema([
            ("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
        ])
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                rows = batch.slice(low, SLICE)
                ids = [x + end for x in of([t or "" for t in rows.column(1).to_pylist()])]
                counts, starts = [len(x) // 4 for x in ids], []
                for c in counts:
                    starts.append(at)
                    at += c
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    schema=schema,
                )

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.saved(slim.mapInArrow(encode, TOKENS), "tokens")


def pieces(tokens: DataFrame, window: int = 2048) -> DataFrame:
    """The pieces of a frame made by tokenized(): doc_id, doc_tokens, sequence_id, offset, start, length, ids.

    start counts the document's ids before the piece, offset the ids before it in its
    sequence. Every id lies in one piece, and offsets leave no gap. What is broadcast has
    one row of two numbers for each partition that was read, whatever the rows hold.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("at", F.col("before") + F.col("start"))

    def piece(sequence):
        low = F.greatest(F.lit(0), sequence * window - F.col("at"))
        high = F.least(F.col("n"), (sequence + 1) * window - F.col("at"))
        return F.struct(
            sequence.alias("sequence_id"),
            (F.col("at") + low - sequence * window).alias("offset"),
            low.alias("start"),
            (high - low).alias("length"),
            F.substring(F.col("ids"), (low * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("ids"),
        )

    # Cut inside the row, then one row per piece: a long document is copied once, not once per piece.
    numbers = F.sequence(F.expr(f"at div {window}"), F.expr(f"(at + n - 1) div {window}"))
    cut = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.transform(numbers, piece).alias("pieces"))
    return cut.select("doc_id", "doc_tokens", F.inline("pieces"))


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = 2048, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents, packed into sequences of `window` tokens.

    Null and empty texts give their end id alone; repeated rows are packed each; an empty
    table gives no pieces. The order of documents is that in which Spark reads them.
    """
    return pieces(tokenized(docs, vocabulary, end_id, key, text), window)


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """What a model is trained on: sequence_id, n_tokens, input_ids (array<int> of `window` ids, padded) and pieces.

    pieces tells which part of which document stands where: doc_id, offset, start, length. A
    group holds `window` ids at most, in as many pieces.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def padded(ids: pa.Array) -> pa.Array:
        rows = [np.frombuffer(x, "<i4") for x in ids.to_pylist()]
        return pa.array([np.r_[x, np.full(window - len(x), pad_id, "<i4")] for x in rows], pa.list_(pa.int32()))

    of = F.struct("offset", "doc_id", "start", "length", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(of)).alias("x"))
    joined = F.aggregate("x", F.lit(b""), lambda row, piece: F.concat(row, piece["ids"]))
    pieces = F.transform("x", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["offset"].alias("offset"), p["start"].alias("start"), p["length"].alias("length")))
    return grouped.select("sequence_id", "n_tokens", padded(joined).alias("input_ids"), pieces.alias("pieces"))
