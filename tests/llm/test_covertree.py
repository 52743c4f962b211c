"""Exact threshold pairs by the cover tree against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import plain
from leakloom.llm import covertree, queries

SF_TINY = "/root/testdata/sf0.001"
SMALL = covertree.Settings(sample=64, per_node=4, levels=6, tile=32)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, threshold=0.9):
    """(id, n_links, component_id, kept) of each (id, vector)."""
    number, links = [0] * len(rows), []
    good = [i for i, (_, v) in enumerate(rows) if usable(v)]
    scaled = {i: np.array(rows[i][1], float) / max(map(abs, rows[i][1])) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    for length in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == length]
        x = np.array([unit[i] for i in own])
        for k, i in enumerate(own):
            for j in np.flatnonzero(x[k] @ x.T >= threshold):
                if own[j] != i:
                    number[i] += 1
                    links.append((i, own[j]))
    least = defaultdict(list)
    groups = plain.components(len(rows), links)
    for g, (doc, _) in zip(groups, rows):
        least[g].append(doc)
    smallest = {g: min((d for d in v if d is not None), default=None) for g, v in least.items()}
    return Counter((d, n, smallest[g], d is not None and d == smallest[g]) for (d, _), n, g in zip(rows, number, groups))


def check(spark, rows, s=SMALL, threshold=0.9, kind="double"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    found = covertree.linked(frame, threshold, s=s).select("doc.vec_id", "n_links", "component_id", "kept").collect()
    assert Counter(map(tuple, found)) == brute(rows, threshold)
    return found


def families(seed, n, dim, spread, groups):
    """Near copies around centres, groups of every tightness, exact and scaled copies, and lone vectors."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    of = rng.choice(groups, n, p=np.r_[1 / 3, np.full(groups - 1, 2 / 3 / (groups - 1))])
    x = base[of] + rng.normal(size=(n, dim)) * rng.choice([0, 0.05, spread, 2 * spread], (n, 1))
    x *= rng.choice([1.0, 1.0, 7.5, 1e-3], (n, 1))
    return [(int(i), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim,spread,threshold", [(3, 0.3, 0.9), (16, 0.25, 0.8)])
def test_against_brute_force(spark, dim, spread, threshold):
    found = check(spark, families(dim, 500, dim, spread, 12), threshold=threshold)
    assert sum(r.n_links > 0 for r in found) > 100


def test_single_precision_table(spark):
    check(spark, families(5, 300, 6, 0.2, 9), kind="float")


@pytest.mark.parametrize("s", [SMALL._replace(levels=1), SMALL._replace(sample=1, tile=3), SMALL._replace(tile=3, levels=3)])
def test_settings_change_nothing(spark, s):
    check(spark, families(7, 160, 5, 0.2, 7), s)


def test_large_group_is_linked_as_a_whole(spark):
    """Near copies are not compared one by one: what is left undecided does not grow with their square."""
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(1, 12)) + rng.normal(size=(900, 12)) * 0.01, rng.normal(size=(100, 12))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert check(spark, rows)[0] is not None
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    vectors = covertree.distinct(frame)
    tree = covertree.fit(covertree.unit([np.array(r.vector, "<f8").tobytes() for r in vectors.limit(64).collect()], "<f8"), SMALL)
    points = covertree.inserted(covertree.compact(vectors, "<f8"), tree, "<f8")
    m = covertree.measured(points, tree)
    undecided, whole = covertree.traversed(spark, tree, m, float(np.sqrt(0.2)))
    first = tree.levels[-1][0]
    assert sum(int(m.vectors[a - first]) * int(m.vectors[b - first]) for a, b in undecided.collect()) < 1000 * 1000 / 10
    assert sum(int(m.rows[a]) * int(m.rows[b]) for a, b in whole.collect()) > 300_000


def test_tree_is_nested_and_covers():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.fit(x, covertree.Settings())
    for k, (low, n) in enumerate(tree.levels[:-2]):
        radius, nodes = 2.0 / 2 ** (k + 1), tree.centers[tree.levels[k + 1][0] :][: tree.levels[k + 1][1]]
        assert {tuple(c) for c in tree.centers[low : low + n]} <= {tuple(c) for c in nodes}
        apart = np.sqrt(np.maximum(2 - 2 * nodes @ nodes.T, 0))
        assert (apart + 9 * np.eye(len(nodes))).min() > radius - 1e-6  # kept apart by the radius
        assert np.sqrt(np.maximum(2 - 2 * (x @ nodes.T).max(axis=1), 0)).max() <= radius + 1e-6  # and cover the sample
        assert tree.children[low : low + n].sum() == len(nodes)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [2.0, -0.0]), (20, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (3, [nan, 1.0]),
            (4, [1.0, inf]), (5, [1.0, None]), (6, []), (7, [1.0]), (8, [-3.0]), (9, [2.0]), (None, [0.5, 0.5]), (None, [-1.0, 2.0]), (None, None),
            (-20, [-1.0, 2.0]), (30, [1e-200, 1e-200]), (31, [1e200, 1e200]), (32, [1.0, 0.0, 0.0])]
    check(spark, rows)
    clash = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links int, vector string")
    assert covertree.linked(clash, s=SMALL).select("doc.*").columns == clash.columns
    assert covertree.linked(clash.limit(0)).count() == 0
    assert covertree.linked(clash.where("vec_id = 40")).select("n_links", "kept").collect() == [(0, True)]
    with pytest.raises(ValueError):
        covertree.linked(clash, 1.0)


def test_query_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_TINY}/embeddings.parquet").collect()]
    found = queries.op11_vectors(spark, SF_TINY)
    assert Counter(map(tuple, found.collect())) == brute(rows)
