"""Aligned tokens and counts of linked pairs against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from edgecases import edges, nothing  # noqa: F401
from leakloom.llm import alignment, queries

SF_TINY = "/root/testdata/sf0.001"
A, B = queries.vocabulary(), queries.vocabulary(queries.PIECES)


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in visible}
    table.update({chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)})

    def groups(text):
        """Groups of (A ids, B ids) by byte offsets of the whole text; None without tokens."""
        if not text:
            return None
        x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        xb = [bytes(table[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        if not b"".join(xb) == b"".join(yb) == f" {text}".encode():
            return None
        xe, ye = np.cumsum([len(t) for t in xb]), np.cumsum([len(t) for t in yb])
        ends = np.intersect1d(xe, ye)
        xg, yg = np.searchsorted(ends, xe), np.searchsorted(ends, ye)
        out = [([], []) for _ in ends]
        for side, (ids, of) in enumerate(((x, xg), (y, yg))):
            for i, g in zip(ids, of):
                out[g][side].append(i)
        return out

    def result(texts):
        """The columns of the query but doc_id, for each text."""
        all_groups = [groups(t) for t in texts]
        links = [Counter((i, j) for p, q in g or [] for i in p for j in q) for g in all_groups]
        held = Counter(pair for found in links for pair in found)
        most = defaultdict(int)
        for (i, _), n in held.items():
            most[i] = max(most[i], n)
        out = []
        for g, found in zip(all_groups, links):
            written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g or [])
            out.append((
                sum(len(p) for p, _ in g or []), sum(len(q) for _, q in g or []), len(g or []), sum(found.values()),
                sum(n for pair, n in found.items() if held[pair] == most[pair[0]]), sum(n * held[pair] for pair, n in found.items()),
                hashlib.sha256(written.encode()).hexdigest() if g else "",
            ))
        return out, held, most

    return result


def check(plain, docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, plain([r.text for r in rows])[0]))
    assert Counter(map(tuple, alignment.aligned(docs, A, B).collect())) == want


PARTS = [" ", " ", " ", "\n", "  ", "\n\n", "\t", "a", "B", "é", "1", "12", "'s", ".", "!!", "\xa0", "\x1c", "\x85", "\U0001f600", "</s>", "<unk>", "<0x0A>",
         "<|endoftext|>", "Ġ", "Ċ", "\r\n", "word", " the", "-", "​", "　", "中文", "\x00", "▁", "ﬁ", "½", "straße", "hello", "=" * 37]


def test_words_give_what_whole_texts_give():
    rng = random.Random(13)
    of = alignment.Aligner(A, B)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)] + [None, "", "\n", " ", "a b\nc", "\na b", "a b\n"]
    cores = [p for p in PARTS if p == p.strip() and "\x85" not in p and p not in ("\x1c", "\xa0", "\n")]
    texts += ["".join(rng.choice([" ", " ", " ", "\n"]) + "".join(rng.choices(cores, k=rng.randint(1, 3))) for _ in range(9))[1:] for _ in range(1500)]
    fast = 0
    for text, parts in zip(texts, of(texts)):
        whole = of.whole(text) if text else None
        assert (parts is None) == (whole is None)
        if parts is not None:
            fast += len(parts) > 1
            assert b"".join(p.text for p in parts) == whole.text
            assert sum(np.frombuffer(p.sizes, np.int64) for p in parts).tolist() == np.frombuffer(whole.sizes, np.int64).tolist()
            assert Counter(np.frombuffer(b"".join(p.pairs for p in parts), np.int64).tolist()) == Counter(np.frombuffer(whole.pairs, np.int64).tolist())
    assert fast > 800


def test_groups_with_many_links(plain, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 1)
    rng = random.Random(14)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(300)]
    run, of = alignment._Run(0), alignment.Aligner(A, B)
    for parts in of(texts):
        run.add(1, parts)
    assert any(p.times for x in of(texts) for p in x or [])
    assert [r[1:5] for r in run.rows] == [x[:4] for x in plain(texts)[0]]
    links = [sum(Counter(dict(zip(p.tolist(), n.tolist()))).values()) for p, n in zip(run.pairs, run.links)]
    assert links == [x[3] for x in plain(texts)[0]]


def test_alignment_of_edge_rows(plain, edges, nothing):
    check(plain, edges)
    assert alignment.aligned(nothing, A, B).count() == 0


@pytest.mark.parametrize("records,dealt", [(50, 64), (7, 1), (10_000, 1 << 20)])
def test_alignment_over_many_runs(spark, plain, monkeypatch, records, dealt):
    """Small runs and small shares of a partition change nothing."""
    for name, value in (("RECORDS", records), ("DEALT", dealt)):
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(records)
    rows = [(i // 2, "".join(rng.choices(PARTS, k=rng.randint(0, 30)))) for i in range(160)]
    check(plain, spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_counted_pairs(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "RECORDS", 500)
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").repartition(4)
    _, held, most = plain([r.text for r in docs.collect()])
    found = alignment.pairs(alignment.counted(alignment.spilled(docs, A, B)[1])).collect()
    assert {(r.a, r.b): (r.docs, r.best) for r in found} == {k: (n, n == most[k[0]]) for k, n in held.items()}
    assert len(found) == len(held)


def test_merge_of_pieces(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 4)
    rng = np.random.default_rng(3)
    pieces, want = [], Counter()
    for _ in range(40):
        keys = np.sort(rng.choice(300, rng.integers(1, 60))).astype(np.int64) * 0x50000001
        docs = rng.integers(0, 9, len(keys)).astype(np.int32)
        pieces.append(alignment._piece(keys, docs, np.ones(len(keys), np.int64))[:2])
        want.update(keys.tolist())
    found = list(alignment.merged(pieces))
    assert {k: n for keys, counts in found for k, n in zip(keys.tolist(), counts.tolist())} == dict(want)
    flat = np.concatenate([k for k, _ in found])
    assert len(found) > 10 and (np.diff(flat) > 0).all()
    whole = [k >> 32 for k, _, _ in alignment.judged(iter(found))]
    assert all(x[-1] < y[0] for x, y in zip(whole, whole[1:]))


def test_query_alignment(spark, plain):
    rows = spark.read.parquet(f"{SF_TINY}/documents.parquet").collect()
    want = {(r.doc_id, *x) for r, x in zip(rows, plain([r.text for r in rows])[0])}
    assert {tuple(r) for r in queries.op13_alignment(spark, SF_TINY).collect()} == want
