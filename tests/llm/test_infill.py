"""Fill-in-the-middle forms against a plain version."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from edgecases import CLASHES, edges, nothing  # noqa: F401
from leakloom.llm import infill, queries
from registry.compare import compare, duck

SF_TINY = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc, text, changed=50):
    t = text or ""
    u = UNIT.findall(t)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= changed:
        return doc, len(u), "plain", None, None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 80:
        return doc, len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return doc, len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def rows(docs, **settings):
    cut = infill.transform(docs, infill.Settings(**settings))
    back = cut.withColumn("back", infill.restored(F.col("output"), F.col("form")))
    return back.select("doc.doc_id", "n", "form", "prefix", "middle", "suffix", "output", "doc.text", "back").collect()


def check(docs, **settings):
    found = rows(docs, **settings)
    want = Counter(plain_infill(r.doc_id, r.text, **settings) for r in docs.select("doc_id", "text").collect())
    assert Counter(tuple(r)[:7] for r in found) == want
    assert all(r.back == (r.text or "") for r in found)
    return Counter(r.form for r in found)


def test_infill_of_edge_rows(edges, nothing):
    assert check(edges, changed=100)["spm"] > 3
    check(edges)
    assert infill.transform(edges).select("doc.*").columns == edges.columns
    assert infill.transform(nothing).count() == 0


def test_infill_of_random_texts(spark):
    rng = random.Random(12)
    parts = [" ", "\n", "\t\x0b", "a", "word", "\x1c", "\x85", "\xa0", "\U0001f600", "<", ">", "<M", "S>", "$1", "\\", "é", "<P", "{2}", "\r\n"]
    data = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(3000)]
    data += [(9000 + i, x) for i, x in enumerate(["<P>", "a <S> b", "x<M>", " ", "\n\n", " a", "a ", "<<P", "<S", "M>"] * 20)]
    forms = check(spark.createDataFrame(data, "doc_id long, text string"), changed=100)
    assert forms["psm"] > 300 and forms["spm"] > 1500 and forms["plain"] > 50


def test_infill_of_very_long_texts(spark):
    long = [(i, t) for i in range(6) for t in ("w " * 1_000_000, "x" * 3_000_000, " \n" * 1_500_000 + "end")]
    check(spark.createDataFrame(long, "doc_id long, text string").repartition(6), changed=100)


def test_query_infill(spark):
    assert compare(spark, duck(SF_TINY), queries.op12_infill, queries.ORACLES["op12_infill"], SF_TINY) is None
    found = {r.doc_id: r for r in queries.op12_infill(spark, SF_TINY).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in spark.read.parquet(f"{SF_TINY}/documents.parquet").collect():
        _, n, form, p, m, _, out = plain_infill(r.doc_id, r.text)
        want = (r.doc_id, n, form, p if p is None else len(p), m if m is None else len(m), sha(out), sha(r.text or ""))
        assert tuple(found[r.doc_id])[:7] == want
