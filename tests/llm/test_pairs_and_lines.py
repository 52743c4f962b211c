"""Line dedup, near duplicates, components, sharding and licences against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from edgecases import edges, nothing  # noqa: F401
SF_TINY = "/root/testdata/sf0.001"
from leakloom.llm import components, licenses, lines, queries, sharding, simhash


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# Lines


def dedup_rows(df):
    done = lines.dedup(df).select("doc.doc_id", "doc.text", "doc.kept", "n_lines", "n_dropped", F.col("kept").alias("new"))
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.new) for r in done.collect()), key=repr)


def plain_rows(df):
    rows = pairs(df)
    return sorted(((d, t, *x) for (d, t), x in zip(rows, plain.line_dedup(rows))), key=repr)


def test_lines_of_edge_rows(edges, nothing):
    got = dedup_rows(edges)
    assert got == plain_rows(edges) and any(r[3] for r in got)
    assert dedup_rows(nothing) == []


def test_heavy_lines_are_the_same(edges, monkeypatch):
    monkeypatch.setattr(lines, "HEAVY", 2)
    assert dedup_rows(edges) == plain_rows(edges)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    rng = random.Random(3)
    pool = [f"shared line number {i} of the pool" for i in range(60)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 6)) + [f"own line of document {i}"])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dedup_rows(df.withColumn("kept", F.lit(1))) == plain_rows(df)


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
    h1[: n // 2] = 7  # pairs may share a half
    sizes, bits, left = lines.PerfectHash.levels(h1, h2)
    index = lines.PerfectHash(sizes, bits, left).index(h1, h2)
    assert sorted(index.tolist()) == list(range(n))


# Near duplicates


def test_near_duplicates_of_edge_rows(edges, nothing):
    rows = pairs(edges)
    fps, groups = plain.near_groups(rows)
    smallest = defaultdict(list)
    for (doc, _), g in zip(rows, groups):
        smallest[g].append(doc)
    least = {g: min((d for d in v if d is not None), default=None) for g, v in smallest.items()}
    want = Counter((d, f, least[g]) for (d, _), f, g in zip(rows, fps, groups))
    found = simhash.near_duplicates(edges).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_of_each(edges):
    kept = simhash.one_of_each(edges)
    assert kept.columns == edges.columns
    _, groups = plain.near_groups(pairs(edges))
    assert kept.count() == len(set(groups))
    _, groups = plain.near_groups(pairs(kept))
    assert len(set(groups)) == len(groups)


def test_query_simhash(spark):
    rows = pairs(spark.read.parquet(f"{SF_TINY}/documents.parquet"))
    fps, groups = plain.near_groups(rows)
    want = {(d, f"{f:016x}", min(rows[j][0] for j in range(len(rows)) if groups[j] == g)) for (d, _), f, g in zip(rows, fps, groups)}
    assert {tuple(r) for r in queries.op2_simhash(spark, SF_TINY).collect()} == want


@pytest.mark.parametrize("block", [4, 512])
def test_places_lose_no_link(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(block)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 5), dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *np.bitwise_xor.accumulate(np.c_[base, flips], axis=1).T, base ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2]]))
    table = np.bitwise_count(fp[:, None] ^ simhash.PIVOTS)
    found = []
    for mask in simhash._masks():
        place = fp & np.uint64(mask)
        order = np.argsort(place, kind="stable")
        group = np.cumsum(np.r_[True, place[order][1:] != place[order][:-1]])
        moved, to = simhash.linked(fp[order], table[order], group)
        found += list(zip(order[moved].tolist(), order[to].tolist()))
    n = len(fp)
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 3]
    assert plain.components(n, found) == plain.components(n, links)


def test_a_hot_place_is_many_tasks(spark, monkeypatch):
    """Fingerprints that agree on most ranges: the same components, compared in pairs of chunks."""
    monkeypatch.setattr(simhash, "HOT", 300)
    monkeypatch.setattr(simhash, "COUNTED", 2)
    rng = np.random.default_rng(11)
    hot = rng.integers(0, 2**22, 1500, dtype=np.uint64)  # the upper four ranges are equal
    fp = np.unique(np.r_[hot, rng.integers(0, 2**64, 200, dtype=np.uint64)])
    fps = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    spread = simhash.chunked(simhash.places(simhash.distance_table(fps)))
    most = spread.groupBy("choice", "place", "chunks").count().agg(F.max("count")).first()[0]
    assert most < 1100 and spread.where("chunks IS NOT NULL").select("choice", "place", "chunks").distinct().count() > 20
    found = {r.a: r.root for r in components.components(simhash.links(fps)).collect()}
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    links = [(i, i + 1 + int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3)]
    want = plain.components(len(fp), links)
    got = plain.components(len(fp), [(at[a], at[b]) for a, b in found.items()])
    assert got == want and len(set(want)) < len(fp)


@pytest.mark.parametrize("n,m", [(300, 200), (200, 400), (60, 59)])
def test_components(spark, n, m):
    rng = random.Random(n)
    links = [(i, i + 1) for i in range(m)] if n == 60 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    links += [(0, j) for j in range(n // 2, n, 7)]  # a hub
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    want = {i: g for i, g in enumerate(plain.components(n, links)) if i != g}
    assert {r.a: r.root for r in found.collect()} == want


# Sharding


def test_sharding_of_edge_rows(edges, nothing):
    rows = sharding.assign(edges, sharding.layout(24), sharding.layout(25)).collect()
    assert len(rows) == edges.count()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    assert all(len({r.shard for r in rows if r.doc_id == d}) == 1 for d in {r.doc_id for r in rows})
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d, len((t or "").encode()) + 8) for d, t in pairs(edges))
    assert sharding.assign(nothing, sharding.layout(24)).count() == 0


def test_numbers_do_not_depend_on_the_chunk(edges, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 2)
    rows = sharding.assign(edges, sharding.layout(3)).collect()
    for shard in range(3):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_weights_and_confinement(spark):
    ids = spark.range(20_000)
    leaves = sharding.layout(24)
    heavier = [x._replace(weight=3.0) if x.shard == 2 else x for x in leaves]
    rows = ids.select(
        sharding.shard_of(F.col("id"), leaves).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b"),
        *(sharding.shard_of(F.col("id"), sharding.layout(n)).alias(f"n{n}") for n in (25, 26)),
    ).collect()
    before, after = Counter(r.a for r in rows), Counter(r.b for r in rows)
    assert all(abs(before[s] - 20_000 / 24) < 150 for s in range(24))
    assert abs(after[2] - 20_000 * 3 / 26) < 250
    region = {x.shard: x.region for x in leaves}
    # A region whose weight did not change only loses rows, and what stays keeps its shard.
    assert all(r.a == r.b or region[r.b] == region[2] for r in rows)
    assert all(r.n25 in (r.a, 24) and r.n26 in (r.n25, 25) for r in rows)


def test_tree_needs_sound_leaves(edges):
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [])
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [sharding.Leaf("a", "a", 0), sharding.Leaf("b", "b", 0)])


def test_shards_on_disk(edges, tmp_path):
    sharding.write_shards(edges, sharding.layout(3), str(tmp_path / "out"))
    back = edges.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == edges.count() and {r.shard for r in back.select("shard").collect()} <= {0, 1, 2}


# Licences


def plain_licenses(rows, templates, threshold=0.8):
    """Every stretch of each document, without windows or hashes."""
    out = []
    for t in licenses.prepared(templates, threshold):
        for doc, text in rows:
            words, places = licenses.words_of((text or "").encode())
            shingles = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
            good = [i for i in range(len(shingles)) if len(set(shingles[i : i + t.stretch]) & t.shingles) >= t.need]
            spans = []
            for i in good:
                hits = [j for j in range(i, min(i + t.stretch, len(shingles))) if shingles[j] in t.shingles]
                if spans and hits[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hits[-1])
                else:
                    spans.append([hits[0], hits[-1]])
            for a, b in spans:
                share = len(set(shingles[a : b + 1]) & t.shingles) / len(t.shingles)
                out.append((doc, t.name, places[a], places[b + 4] - places[a] + 1, share))
    return sorted(out, key=repr)


def licensed_rows():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        body = [f"x{rng.randrange(50)}" for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["changed", "*", "words of mine"])
            at = rng.randrange(len(body) + 1)
            body[at:at] = words
        rows.append((i, " ".join(body)))
    return rows


def test_licenses(spark, edges, nothing):
    rows = licensed_rows()
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_licenses(rows, licenses.TEMPLATES) and len(got) > 50
    assert licenses.scan(edges).count() == 0 and licenses.scan(nothing).count() == 0


def test_notices_with_insertions_and_comment_marks(spark, tmp_path):
    """A run of words inside a notice, and any comment marks before its lines, do not hide it; null ids and repeated rows have their matches."""
    rows, names = [], {}
    for name, text in licenses.TEMPLATES:
        words = text.split()
        if len(words) < 40:
            continue
        half = len(words) // 2
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        for k, body in enumerate([
            " ".join([*words[:half], *(f"w{i}" for i in range(20)), *words[half:]]),
            "\n".join(f"-- {x}" for x in lines), "\n".join(f"%% {x}" for x in lines), "\n".join(f";; {x} ;;" for x in lines),
            "\n".join(f" * {x}" for x in lines), "\n".join(f"// {x}" for x in lines),
        ]):
            names[f"{name} {k}"] = name
            rows.append((f"{name} {k}", "before the notice\n" + body + "\nafter it"))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert all((i, names[n]) in found for i, (n, _) in enumerate(rows))
    twice = spark.createDataFrame([(None, rows[0][1])] * 2 + [(7, rows[0][1])], "doc_id long, text string, license string".replace(", license string", ""))
    got = Counter((r.doc_id, r.license) for r in licenses.scan(twice).collect())
    assert got[None, names[rows[0][0]]] == 2 and got[7, names[rows[0][0]]] == 1
    for name, text in licenses.TEMPLATES[:3]:
        (tmp_path / f"{name}.txt").write_text(text)
    assert licenses.read_templates(spark, str(tmp_path)) == sorted(licenses.TEMPLATES[:3])


def test_query_licenses(spark):
    rows = pairs(spark.read.parquet(f"{SF_TINY}/documents.parquet"))
    got = sorted(map(tuple, queries.op10_licenses(spark, SF_TINY).collect()), key=repr)
    assert got == plain_licenses(rows, licenses.TEMPLATES)


def test_bands_keep_their_promise():
    for t in licenses.prepared(licenses.TEMPLATES, 0.8):
        window = t.stride * t.blocks
        assert window >= t.stretch + t.stride - 1
        assert len(t.bands) == 1 or (1 - t.need / (window + len(t.shingles) - t.need)) ** len(t.bands) <= licenses.MISS
    with pytest.raises(ValueError):
        licenses.prepared([("short", "four words are here")], 0.8)
