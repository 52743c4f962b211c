"""Quality, URL filters, rules, mixing, packing, search and the pipeline."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import plain
from edgecases import edge_rows, edges, nothing  # noqa: F401
from leakloom.llm import common, mixing, neighbours, packing, quality, queries, rules, urls
from registry.compare import duck

SF_TINY, SF_SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


# Packing


def test_cached_encoder_equals_whole_texts(encode):
    rng = random.Random(1)
    parts = [" ", "\n", "  ", "\n\n", "\t", "a", "B", "é", "1", "'s", "'ll", ".", "!", "\xa0", "\x1c", "\x85", "\U0001f600",
             "<|endoftext|>", "<|endoftext|", "Ġ", "Ċ", "\r\n", "word", " the", "-", "\u200b", "\u3000", "中", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    got = packing.CachedEncoder(queries.vocabulary())(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [encode(t) for t in texts]


def test_added_tokens_are_tokens(encode):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "a <|endoftext| > b"]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.CachedEncoder(queries.vocabulary())(texts)]
    assert got == [encode(t) for t in texts]
    assert got[0] == [64, 220, 50256, 275]


def test_cache_is_bounded(encode, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    of = packing.CachedEncoder(queries.vocabulary())
    for text in ("a b c d e f", "c d x", "a b c d e f"):
        assert np.frombuffer(of([text])[0], "<u4").tolist() == encode(text)


def test_packing_of_edge_rows(edges, nothing, encode):
    numbered = edges.withColumn("doc_id", F.monotonically_increasing_id())
    numbered = common.saved(numbered, "numbered")
    packed = packing.pack(numbered, queries.vocabulary(), window=64)
    rows = packed.select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
    plain.check_pieces(pairs(numbered), map(tuple, rows), encode, window=64)
    whole = packing.sequences(packed, 64).collect()
    assert all(len(r.input_ids) == 64 for r in whole) and sum(r.n_tokens < 64 for r in whole) <= 1
    flat = [i for r in sorted(whole) for i in r.input_ids[: r.n_tokens]]
    assert Counter(flat) == sum((Counter([*encode(t or ""), 1]) for _, t in pairs(numbered)), Counter())
    assert packing.pack(edges, queries.vocabulary()).where("doc_id IS NULL").count() == 3
    assert packing.pack(nothing, queries.vocabulary()).count() == 0


def test_query_packing(spark, encode):
    rows = [tuple(r) for r in queries.op5_packing(spark, SF_TINY).collect()]
    plain.check_pieces(pairs(spark.read.parquet(f"{SF_TINY}/documents.parquet")), rows, encode)


# Quality


def test_quality_on_held_out_documents(spark):
    scored = queries.op1_quality(spark, SF_SMALL)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{SF_SMALL}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_of_edge_rows(spark, edges, nothing):
    labels = [(1, 0), (2, 0), (3, 0), (5, 1), (9, 1), (9, 0), (10, 1), (11, 1), (12, 0), (13, 0), (None, 1), (8, None), (7, 5)]
    model = quality.fit(edges.union(edges.where("doc_id = 9")), spark.createDataFrame(labels, "doc_id long, label int"))
    scores = [r.s for r in edges.select(quality.score(model, F.col("text")).alias("s")).collect()]
    assert len(scores) == len(edge_rows()) and all(0 <= s <= 1 for s in scores)
    blank = edges.where("text IS NULL OR text = '' OR doc_id IN (3, 4)")
    assert len({r.s for r in blank.select(quality.score(model, F.col("text")).alias("s")).collect()}) == 1
    empty = quality.fit(nothing, spark.createDataFrame([], "doc_id long, label int"))
    assert {round(r.s, 6) for r in edges.select(quality.score(empty, F.col("text")).alias("s")).collect()} <= {0.5}
    assert nothing.select(quality.score(model, F.col("text"))).count() == 0


def test_tokens_and_temperature():
    assert quality.tokens_of("Ab Ab ABC *** x!! 12") == ["ab", quality.SAME, "ab", quality.CAPS, "abc", "*3", "!2", "x", quality.NUMBER]
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality._temperature(z * 3, y) - 3) < 0.4


# URLs


def plain_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = plain.low(rest[:cut]), rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [None, "", "no scheme", "http://", "http://Example.ORG/es/1?x=1#y", "https://a.example.org/en/12", "http://example.org/en/2",
        "http://notexample.org/es/", "http://b.COM/fr/x", "http://b.com/de", "http://b.com/de/", "ftp://x.net?q=://a/b", "http://org/",
        "http://org", "a://b://c.com/de/", "http://é.com/de/é", "http://x.com:80/de/", "http://h\n.org/x\ny", "http://a.com/de/" + "x" * 100_000]


def test_urls_of_edge_rows(spark):
    rows = [(i, u, "a", "b", 1.0) for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, probability string, length double").repartition(2)
    known = spark.createDataFrame([(f"http://{'good' if i % 2 else 'b4d-1'}.net/{i}", "allow" if i % 2 else "block") for i in range(60)], "url string, label string")
    for labelled in (known, known.where("label = 'block'"), known.limit(0)):
        found = urls.fit(labelled).apply(pages).collect()
        assert len(found) == len(rows)
        for r in found:
            host, path, rule, verdict = plain_rule(r.doc.url)
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
            assert r.verdict == verdict if rule else r.score is not None
    assert urls.fit(known).apply(pages.limit(0)).count() == 0


def test_trees_learn_from_labels(spark):
    known = [(f"http://{'good' if i % 2 else 'b4d-1'}.net/{i}", "allow" if i % 2 else "block") for i in range(400)]
    frame = spark.createDataFrame(known, "url string, label string")
    found = urls.fit(frame.limit(300)).apply(frame).collect()
    assert np.mean([r.verdict == r.doc.label for r in found]) > 0.98


def test_query_urls(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    found = queries.op3_urls(spark, SF_SMALL).collect()
    assert len(found) == len(pages) and len({r.verdict for r in found if r.rule is None}) == 2
    for r in found:
        host, path, rule, verdict = plain_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == verdict)


def test_entropy(spark):
    for text in ("", "a", "aab", "http://x.y/zz?é"):
        n = Counter(text)
        want = -sum(c / len(text) * math.log2(c / len(text)) for c in n.values()) if text else 0
        got = spark.createDataFrame([(text,)], "t string").select(urls._entropy(F.col("t"))).first()[0]
        assert got == pytest.approx(want, abs=1e-9)


# Rules


def plain_distances(rows):
    """Squared distances by concentration steps in numpy. rows: (group, statistics)."""
    floors = np.diag([v**2 for v in rules.STATS.values()])
    out = {}
    for group in {g for g, _ in rows}:
        x = np.array([s for g, s in rows if g == group], float)
        if len(x) < rules.LEAST_ROWS:
            continue
        lower = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
        mean = lower(x)
        cov = np.diag((lower(abs(x - mean)) * 1.4826) ** 2) + floors

        def step(mean, cov):
            z = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
            bins = np.floor(np.log2(np.maximum((z**2).sum(0), 1e-9)) * rules.BINS)
            values, counts = np.unique(bins, return_counts=True)
            edge = values[np.cumsum(counts) - counts < len(x) * rules.HALF].max()
            near = x[bins <= edge]
            return near.mean(0), np.cov(near.T, bias=True) + floors

        now = step(mean, cov)
        for _ in range(rules.STEPS - 1):
            after = step(*now)
            if np.linalg.slogdet(after[1])[1] >= np.linalg.slogdet(now[1])[1] - 1e-9:
                break
            now = after
        out[group] = now
    return out


def test_rules_against_numpy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("source", F.lit("one")).collect()}
    frame = spark.createDataFrame(list(docs.values()))
    stats, counts = {}, {}
    for d, r in docs.items():
        n, chars, symbols, dup, repeats, failed = counts[d] = plain.rule_counts(r.text)
        lines = sum(bool(plain.WORD.search(x)) for x in r.text.split("\n"))
        root = lambda a, b: math.sqrt(a / b) if b else 0.0
        stats[d] = (math.log(chars / n) if n else 0.0, root(symbols, chars), root(dup, lines), root(repeats, n))
    fitted = plain_distances([(docs[d].lang, stats[d]) for d in docs if not counts[d][5]])
    found = rules.judge(frame).collect()
    assert len(found) == len(docs) and {"en", "fr"} <= set(fitted)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts[r.doc_id]
        mean, cov = fitted[docs[r.doc_id].lang]
        d = np.array(stats[r.doc_id]) - mean
        d2 = d @ np.linalg.solve(cov, d) / rules.CONSISTENCY
        assert r.d2 == pytest.approx(d2, rel=1e-6, abs=1e-9)
        assert r.kept == (not r.base_failed and d2 <= rules.FAR)


def test_rules_of_small_groups(spark):
    """Groups, languages and the corpus, each the finest with enough passing rows, judge every document."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumns({
        "lang": F.when(F.col("doc_id") % 50 == 0, "rare").otherwise(F.col("lang")),
        "source": F.when((F.col("lang") == "en") & (F.col("doc_id") % 2 == 0), "one").otherwise(F.col("source")),
    }).collect()
    stats, passed = {}, {}
    for r in docs:
        n, chars, symbols, dup, repeats, failed = plain.rule_counts(r.text)
        lines = sum(bool(plain.WORD.search(x)) for x in r.text.split("\n"))
        root = lambda a, b: math.sqrt(a / b) if b else 0.0
        stats[r.doc_id] = (math.log(chars / n) if n else 0.0, root(symbols, chars), root(dup, lines), root(repeats, n))
        passed[r.doc_id] = not failed
    keys = lambda r: ((r.lang, r.source), (r.lang,), ())
    fitted = plain_distances([(k, stats[r.doc_id]) for r in docs if passed[r.doc_id] for k in keys(r)])
    judge_of = {r.doc_id: next(k for k in keys(r) if k in fitted) for r in docs}
    assert {len(k) for k in judge_of.values()} == {0, 1, 2}
    found = rules.judge(spark.createDataFrame(docs)).collect()
    assert len(found) == len(docs)
    for r in found:
        mean, cov = fitted[judge_of[r.doc_id]]
        d = np.array(stats[r.doc_id]) - mean
        d2 = d @ np.linalg.solve(cov, d) / rules.CONSISTENCY
        assert r.d2 == pytest.approx(d2, rel=1e-6, abs=1e-9)
        assert r.kept == (passed[r.doc_id] and d2 <= rules.FAR)


def test_query_rules_rejects_outliers(spark):
    """With their real sources all groups of the table are small."""
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = queries.op6_rules(spark, SF_SMALL).where("NOT base_failed").join(labels, "doc_id").collect()
    assert all(r.d2 is not None for r in rows)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 10


def test_rules_reject_symbols(spark):
    """Labelled-bad documents with clear symbols go (those here have 9% and more), all labelled-good ones stay."""
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = queries.op6_rules(spark, SF_SMALL).where("NOT base_failed").join(labels, "doc_id").collect()
    clear = [r for r in rows if r.quality == 0 and r.n_symbols > 0.05 * r.word_chars]
    assert len(clear) > 20 and not any(r.kept for r in clear)
    assert all(r.kept for r in rows if r.quality == 1)


def test_rules_of_edge_rows(edges, nothing):
    rows = rules.judge(edges).collect()
    want = Counter((d, *plain.rule_counts(t)) for d, t in pairs(edges))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(r.kept != r.base_failed for r in rows)  # groups are too small for an estimate
    assert rules.judge(nothing).count() == 0


def test_rules_keep_good_documents(spark):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = queries.op6_rules(spark, SF_SMALL).where("NOT base_failed").join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1)


# Mixing


def test_mixing_of_edge_rows(edges, nothing):
    rows = mixing.mix(edges).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.probability <= 1 for r in rows)
    without = mixing.mix(edges.withColumn("text", F.lit(None).cast("string"))).collect()
    assert all(r.kept and r.tokens == 0 for r in without)
    assert Counter((r.doc.doc_id, r.tokens) for r in rows) == Counter((d, len(plain.words(t))) for d, t in pairs(edges))
    assert mixing.mix(nothing).count() == 0


def test_marginals_are_met(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(60, 400), rng.choice(["en", "en", "de"]), rng.choice("aaaab")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mix(docs, {"lang": {"en": 1, "de": 1}, "source": {"a": 1, "b": 3}}, budget=0.1).collect()
    for column, want in (("lang", {"en": 0.5, "de": 0.5}), ("source", {"a": 0.25, "b": 0.75})):
        expected, kept = defaultdict(float), defaultdict(float)
        for r in found:
            expected[r[column]] += r.tokens * r.probability
            kept[r[column]] += r.tokens * r.kept
        for value, share in want.items():
            assert expected[value] / sum(expected.values()) == pytest.approx(share, abs=1e-6)
            assert kept[value] / sum(kept.values()) == pytest.approx(share, abs=0.06)
    none = mixing.mix(docs, {"lang": {"fr": 1}}).collect()
    assert not any(r.kept for r in none)


def plain_mix(cells, budget, powers=mixing.POWERS, rounds=200):
    """Tokens that each cell keeps, by loops. cells: tokens by (source, lang, topic)."""
    total = sum(cells.values())
    goals = []
    for k, margin in enumerate(mixing.MARGINS):
        own = Counter()
        for c, n in cells.items():
            own[c[k]] += n
        share = {v: n ** powers[margin] for v, n in own.items()}
        full, goal = set(), {}
        while True:  # values that cannot give their part give all, and the others share again
            rest = budget * total - sum(own[v] for v in full)
            weight = sum(share[v] for v in own if v not in full)
            goal = {v: own[v] if v in full else rest * share[v] / weight for v in own}
            short = {v for v in own if goal[v] > own[v]}
            if not short:
                break
            full |= short
        goals.append(goal)
    x = {c: float(n) for c, n in cells.items()}
    for _ in range(rounds):
        for k, goal in enumerate(goals):
            sums = defaultdict(float)
            for c, v in x.items():
                sums[c[k]] += v
            x = {c: min(cells[c], v * goal[c[k]] / sums[c[k]]) for c, v in x.items()}
    return x, goals


def test_budget_is_kept_by_what_is_not_scarce(spark):
    """One document of a new source or of no language moves the expected share by less than a point, and its target is reported."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    added = [(-1, "word " * 60, "en", "new source"), (-2, "word " * 60, None, "web")]
    kept = []
    for extra in ([], added[:1], added[1:]):
        more = docs.union(spark.createDataFrame(extra, docs.schema))
        rows = mixing.mix(more).groupBy().agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens")).first()
        kept.append(rows[0] / rows[1])
    assert abs(kept[0] - mixing.BUDGET) < 0.02 and max(abs(k - kept[0]) for k in kept) < 0.01
    said = {(r.margin, r.value): r for r in mixing.report(docs.union(spark.createDataFrame(added[:1], docs.schema))).collect()}
    new = said["source", "new source"]
    assert not new.reachable and new.tokens == new.goal == 60 and new.expected <= 60
    assert all(r.goal <= r.tokens + 1e-6 and r.expected <= r.tokens + 1e-6 for r in said.values())


def test_mixing_against_loops(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 90), rng.choice(["en"] * 8 + ["de", None]), rng.choice(["a"] * 9 + ["b", "c", "d"]), rng.choice("xyz")) for i in range(2000)]
    docs = spark.createDataFrame([*rows, (5000, "one two", "fr", "e", "q")], "doc_id long, text string, lang string, source string, kind string")
    found = mixing.mix(docs, budget=0.6, topic=F.col("kind")).collect()
    cells = Counter()
    for r in found:
        assert r.topic == r.doc.kind
        cells[r.source, r.lang, r.topic] += r.tokens
    want, goals = plain_mix(cells, 0.6, rounds=mixing.ROUNDS)
    assert all(r.probability == pytest.approx(want[r.source, r.lang, r.topic] / cells[r.source, r.lang, r.topic], abs=1e-9) for r in found)
    report = mixing.report(docs, budget=0.6, topic=F.col("kind")).collect()
    assert {(r.margin, r.value): r.goal for r in report} == pytest.approx(
        {(m, v): g for m, goal in zip(mixing.MARGINS, goals) for v, g in goal.items()})
    assert all(abs(r.expected - r.goal) < 0.01 * sum(cells.values()) for r in report)


# Search


def plain_nearest(rows, k):
    ids, x = zip(*rows)
    x = np.array(x, float)
    out = {}
    for q, v in rows:
        s = x @ np.array(v, float)
        out[q] = sorted(((-a, i) for a, i in zip(s.tolist(), ids) if i != q))[:k]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_search_recall(spark, scale):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)) * (rng.uniform(0.2, 3, (700, 1)) if scale else 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = neighbours.Settings(trees=3, leaf=64, degree=20, reverse=12, rounds=3, beam=80)
    found = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 10, s=small).collect()
    want, hits = plain_nearest(rows, 10), 0
    for r in found:
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12) and r.vec_id != r.query_id
        hits += r.vec_id in {i for _, i in want[r.query_id]}
    assert len(found) == 350 and hits / 350 >= 0.9


def test_one_long_row_and_one_of_another_length(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[1] *= 1000
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, (9999, [1.0] * 65)], "vec_id long, embedding array<double>")
    small = neighbours.Settings(trees=3, leaf=128, degree=24, reverse=16, rounds=3, beam=120)
    found = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 10, s=small).collect()
    want = plain_nearest(rows, 10)
    recall = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in found) / 750
    assert len(found) == 750 and recall >= 0.9


def test_ties_among_many_copies(spark):
    """2,000 equal vectors, more than any list holds, and near copies that are equal in 8 bits."""
    rng = np.random.default_rng(6)
    lone = rng.normal(size=(500, 16))
    lone /= 4 * np.sqrt((lone * lone).sum(axis=1, keepdims=True))
    one = np.r_[1.0, np.zeros(15)]
    near = np.tile(np.r_[0.6, 0.8, np.zeros(14)], (100, 1)) + rng.normal(size=(100, 16)) * 1e-6
    x = np.r_[np.tile(one, (2000, 1)), lone, near]
    ids = rng.permutation(len(x))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = [int(i) for i in ids[:2000] if i % 20 == 0][:30] + [int(i) for i in ids[2500:2520]]
    small = neighbours.Settings(trees=3, leaf=64, seeds=12, degree=20, reverse=12, rounds=3, beam=80)
    found = neighbours.nearest(frame, frame.where(F.col("vec_id").isin(asked)), 20, s=small).collect()
    want = plain_nearest(rows, 20)
    assert len(found) == 20 * len(asked)
    for q in asked:
        got = [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        if q in set(ids[:2000].tolist()):
            assert got == sorted(i for i in ids[:2000].tolist() if i != q)[:20]
        else:
            assert len(set(got) & {i for _, i in want[q]}) >= 19


def test_few_changes_end_the_rounds(spark):
    rng = np.random.default_rng(7)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "id long, vector array<double>")
    graph = neighbours.descend(neighbours.prepared(vectors), neighbours.Settings(leaf=400, seeds=20, degree=20, rounds=50))
    assert graph.agg(F.sum("changed")).first()[0] <= 0.02 * 300 * 20


def test_search_of_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, inf]),
            (5, [1.0, None]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (-20, [-1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, near int")
    small = neighbours.Settings(trees=1, rounds=1, search_rounds=3)
    found = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 3, s=small).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20, -20)}
    assert got == {0: [(1, 1.0), (2, 1.0), (20, 0.5)], 20: [(-20, 0.5), (0, 0.5), (1, 0.5)], -20: [(20, 0.5), (0, -1.0), (1, -1.0)]}
    assert len(found) == 9
    assert neighbours.nearest(frame.limit(0), frame, 3, s=small).count() == 0
    one = frame.where("vec_id = 20")
    assert neighbours.nearest(one, one, 3, s=small).count() == 0


def test_query_search(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_TINY}/embeddings.parquet").collect()]
    want = plain_nearest(rows, 20)
    found = queries.op8_neighbours(spark, SF_TINY).collect()
    queried = {i for i, _ in rows if i % 20 == 0}
    assert Counter(r.query_id for r in found) == {q: min(20, len(rows) - 1) for q in queried}
    assert np.mean([r.vec_id in {i for _, i in want[r.query_id]} for r in found]) >= 0.9


# Pipeline


def test_pipeline_stage_by_stage(spark, encode):
    docs = common.table(spark, SF_TINY, "documents")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(common.saved(stage(spark, tables[-1], SF_TINY), name))
    assert all(t.columns == columns for t in tables[:-1])
    raw, good, lined, unique, mixed = (t.orderBy("doc_id").collect() for t in tables[:-1])
    scores = {r.doc_id: r.score for r in queries.op1_quality(spark, SF_TINY).collect()}
    assert [r.doc_id for r in good] == [r.doc_id for r in raw if scores[r.doc_id] >= 0.7]
    assert [(r.doc_id, r.text) for r in lined] == [(r.doc_id, x[2]) for r, x in zip(good, plain.line_dedup([(r.doc_id, r.text) for r in good]))]
    assert all(r.n_chars == len(r.text) for r in lined)
    _, groups = plain.near_groups([(r.doc_id, r.text) for r in lined])
    first = {g: i for i, g in reversed(list(enumerate(groups)))}
    assert [r.doc_id for r in unique] == [lined[i].doc_id for i in sorted(first.values())]
    con = duck(SF_TINY)
    con.execute("CREATE OR REPLACE TEMP TABLE stage (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO stage VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in unique])
    kept = con.sql(f"SELECT doc_id FROM ({mixing.oracle().replace('FROM documents', 'FROM stage')}) WHERE kept ORDER BY 1").fetchall()
    assert [(r.doc_id,) for r in mixed] == kept
    check_sequences(tables[-1].collect(), [(r.doc_id, r.text) for r in mixed], encode)


def check_sequences(rows, docs, encode, window=2048):
    """Padded ids are the documents' ids, each closed by 1, and pieces say whose they are."""
    ids = {d: [*encode(t or ""), 1] for d, t in docs}
    seen = Counter()
    for k, r in enumerate(sorted(rows, key=lambda r: r.sequence_id)):
        assert r.sequence_id == k and len(r.input_ids) == window and r.n_tokens == sum(p.length for p in r.pieces)
        assert r.n_tokens == window or k == len(rows) - 1
        at = 0
        for p in r.pieces:
            assert p.offset == at and p.start == seen[p.doc_id]
            assert r.input_ids[at : at + p.length] == ids[p.doc_id][p.start : p.start + p.length]
            at += p.length
            seen[p.doc_id] += p.length
        assert r.input_ids[at:] == [0] * (window - at)
    assert seen == Counter({d: len(x) for d, x in ids.items()})


def test_pipeline_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """A run that dies in its fourth stage leaves three, which the next one does not repeat; work tables go."""
    calls, stages = [], corpus_pipeline.STAGES

    def counted(name, stage, dies):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if dies and name == "mixing":
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(n, f, True) for n, f in stages])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF_TINY, str(tmp_path / "run"))
    assert calls == ["quality", "lines", "duplicates", "mixing"]
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "run").glob("[123]-*/part-*")}
    calls.clear()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(n, f, False) for n, f in stages])
    done = corpus_pipeline.run(spark, SF_TINY, str(tmp_path / "run"))
    assert calls == ["mixing", "packing"] and done.count() > 0
    assert kept and all(p.stat().st_mtime_ns == t for p, t in kept.items())
    with common.scratch(spark):
        made = common.saved(spark.range(3), "short")
        assert made.count() == 3
    assert not os.path.exists(made._work_path)


def test_pipeline_of_edge_rows(spark, edges, nothing):
    """Rows that quality keeps go through all stages, whatever their ids, texts and classes are."""
    columns = edges.columns
    for start in (edges, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES[1:]:
            rows = docs.count()
            docs = common.saved(stage(spark, docs, SF_TINY), name)
            if name in ("lines", "duplicates", "mixing"):
                assert docs.columns == columns
                assert docs.count() == rows if name == "lines" else docs.count() <= rows
        flat = [(p.doc_id, p.length) for r in docs.collect() for p in r.pieces]
        assert bool(flat) == (start is edges)
        if start is edges:
            # One each of the near copies, blank texts and texts without an id is left before mixing.
            assert {d for d, _ in flat} <= {r.doc_id for r in edges.collect()}
            assert 5 in {d for d, _ in flat} or sum(n for _, n in flat) > 0
    good = corpus_pipeline.quality_stage(spark, edges, SF_TINY)
    assert good.columns == columns and good.count() < edges.count()
    assert corpus_pipeline.quality_stage(spark, nothing, SF_TINY).count() == 0


def test_work_path(spark):
    path = common.work_path(spark, "x")
    assert path != common.work_path(spark, "x") and path.rpartition("/")[2].startswith("x-")
