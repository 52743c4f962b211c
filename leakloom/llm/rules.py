"""Quality rules: base limits, and robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics. For every group (language, source) a
minimum-covariance-determinant estimate is found by concentration steps: the rows nearest
to the current centre, by Mahalanobis distance, give the next mean and covariance, until
the determinant no longer falls. Rows far from the final centre are rejected. A group with
few rows is judged by the estimate of its language, or else by that of the whole corpus.

Everything is DataFrame expressions. A step is one aggregate of counts by distance bin and
one of sums by group, both combined before the shuffle, so a group of any size costs its
tasks a few rows. Factors of the covariance are columns of a table with a row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leakloom.llm import common

#: Words of a window, least number of words, largest share (of 100) of repeated words.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
GROUP = ("lang", "source")
#: What an estimate is made for: level 0 is a group, 1 a language, 2 the corpus; columns left out are "".
KEYS = ("level", *GROUP)
NONE = "(none)"
#: The transformed statistics, and the spread that each has at least: what the count of a
#: short text can tell. Mean length of 100 words is known to 0.05 (a word's length varies by
#: half of its mean); 0.03 is one symbol in 1,100 characters, 0.12 one line in 70, 0.15 one
#: word in 44. With nothing else unusual, a row is far off with symbols in 3.8% of its word
#: characters or duplicates in 61% of its lines; repeats alone are left to MOST_REPEATED.
STATS = {"word_length": 0.05, "symbols": 0.03, "dup_lines": 0.12, "repeats": 0.15}
#: Part of a group that an estimate rests on, steps at most, rows that a group needs.
HALF, STEPS, LEAST_ROWS = 0.75, 6, 40
#: Squared distance from which a row is an outlier: the chi-square quantile at 1 - 1e-5, 4 degrees.
FAR = 28.5
#: What the covariance of the nearest HALF of normal rows lacks in 4 dimensions:
#: HALF / P(chi-square with 6 degrees <= its HALF quantile with 4).
CONSISTENCY = 1.486
#: Distance bins of one octave.
BINS = 16


def _windows_repeated(words: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more, the first included.

    Windows are compared by a 64-bit hash. Equal hashes are found by one sort of the
    document's windows; most documents end before it, at the count of distinct hashes.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            n = F.size(s)
            follow = F.zip_with(s, F.slice(s, 2, n), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))

            def places(same: Column) -> Column:
                before = F.concat(F.array(F.lit(False)), F.slice(same, 1, F.size(same) - 1))
                hit = F.zip_with(same, before, lambda a, b: a | b)
                at = F.zip_with(s, hit, lambda a, f: F.when(f, a["i"]))
                return F.sort_array(F.filter(at, lambda x: x.isNotNull()))

            return common.bind(follow, places)

        def total(at: Column) -> Column:
            gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda sum_, g: sum_ + g)

        found = common.bind(common.bind(placed, marked), total)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, common.bind(hashes, covered)).otherwise(F.lit(0).cast("long"))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Slim rows: doc_id, lang, source and the counts of each text; written once."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(common.WORD))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            common.bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            common.bind(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
            _windows_repeated(words).alias("n_repeat_words"),
        )

    words = F.regexp_extract_all(body, F.lit(f"({common.WORD})"))
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in GROUP),
        common.bind(words, counts).alias("c"),
    )
    return common.saved(slim.select("doc_id", *GROUP, "c.*"), "rule-counts")


def with_stats(rows: DataFrame) -> DataFrame:
    """Adds base_failed and STATS: logarithms and square roots make the statistics' spread even."""
    share = lambda a, b: F.sqrt(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)))
    return rows.withColumns({
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        "word_length": F.coalesce(F.ln(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words"))), F.lit(0.0)),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    })


def _pairs(stats: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(stats)) for j in range(i + 1)]


def _moments(rows: DataFrame) -> DataFrame:
    """Rows, mean (m0, ..) and covariance (c00, c10, ..) of each group; each variance has its floor added."""
    stats = list(STATS)
    sums = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(s).alias(f"m{i}") for i, s in enumerate(stats)),
        *(F.covar_pop(stats[i], stats[j]).alias(f"c{i}{j}") for i, j in _pairs(stats)),
    )
    return sums.withColumns({f"c{i}{i}": F.col(f"c{i}{i}") + STATS[s] ** 2 for i, s in enumerate(stats)})


def _factored(moments: DataFrame) -> DataFrame:
    """Adds the Cholesky factor of the covariance (l00, l10, ..) and logdet; floors keep it positive definite."""
    out = moments
    for j in range(len(STATS)):
        for i in range(j, len(STATS)):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    logs = [F.ln(f"l{i}{i}") * 2 for i in range(len(STATS))]
    return out.withColumn("logdet", sum(logs[1:], logs[0]))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution in the columns of the factor."""
    out = rows
    for i, s in enumerate(STATS):
        z = F.col(s) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"_z{k}")
        out = out.withColumn(f"_z{i}", z / F.col(f"l{i}{i}"))
    squares = [F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(len(STATS))]
    return out.withColumn("d2", sum(squares[1:], squares[0]))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * BINS)


def _by_group(df: DataFrame, purpose: str) -> DataFrame:
    """A table of one row per group, written as one file. Spark then knows its size before it
    joins: as long as it is small, rows of a hot group are not moved to meet theirs."""
    return common.saved(df.repartition(1), purpose)


def _near(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The nearest HALF of each group: whole distance bins, as many as hold that part of its rows."""
    placed = _distance(rows.join(estimate, list(KEYS))).withColumn("bin", _bin(F.col("d2")))
    sizes = placed.groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("k"))
    upto = W.partitionBy(*KEYS).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*KEYS)
    inside = sizes.select(*KEYS, "bin", F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("before"), F.sum("k").over(whole).alias("n"))
    edge = inside.where(F.col("before") < F.col("n") * HALF).groupBy(*KEYS).agg(F.max("bin").alias("edge"))
    return placed.join(_by_group(edge, "edges"), list(KEYS)).where("bin <= edge").select(*KEYS, *STATS)


def _start(rows: DataFrame) -> DataFrame:
    """A first estimate from medians (approximate, of mergeable sketches) and the deviations from them."""
    stats = list(STATS)
    middle = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), *(F.percentile_approx(s, 0.5, F.lit(2000)).alias(f"m{i}") for i, s in enumerate(stats))
    )
    middle = _by_group(middle.where(F.col("n") >= LEAST_ROWS), "medians")
    off = rows.join(middle, list(KEYS)).select(
        *KEYS, *(F.abs(F.col(s) - F.col(f"m{i}")).alias(f"o{i}") for i, s in enumerate(stats))
    )
    spread = off.groupBy(*KEYS).agg(
        *((F.pow(F.percentile_approx(f"o{i}", 0.5, F.lit(2000)) * 1.4826, F.lit(2)) + STATS[s] ** 2).alias(f"c{i}{i}") for i, s in enumerate(stats))
    )
    flat = {f"c{i}{j}": F.lit(0.0) for i, j in _pairs(stats) if i != j}
    return _by_group(_factored(middle.join(spread, list(KEYS)).withColumns(flat)), "estimates")


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """One robust estimate (mean, factor, logdet, n) for each of KEYS with LEAST_ROWS rows or more.

    Steps keep, for each group, the estimate with the smallest determinant so far, and end
    when no group's falls any more or after `steps`. Each is written, so plans stay short.
    """
    used = rows.select(*KEYS, *STATS)
    now = _by_group(_factored(_moments(_near(used, _start(used)))), "estimates")
    for _ in range(steps - 1):
        after = _factored(_moments(_near(used, now)))
        old = now.select(*KEYS, *(F.col(c).alias(f"_{c}") for c in now.columns if c not in KEYS))
        better = F.col("logdet") < F.col("_logdet") - 1e-9
        best = after.join(old, list(KEYS)).select(
            *KEYS, *(F.when(better, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in now.columns if c not in KEYS), better.alias("_moved")
        )
        best = _by_group(best, "estimates")
        moved = best.where("_moved").limit(1).count()
        now = best.drop("_moved")
        if not moved:
            break
    return now


def _levels(rows: DataFrame) -> DataFrame:
    """One row per group: used, the keys whose estimates its passing rows take part in, and
    judged, the finest of its keys with LEAST_ROWS passing rows (null if there is none).

    A language or the corpus has an estimate only where some group needs it.
    """
    sizes = _by_group(rows.groupBy(*GROUP).agg(F.count_if(~F.col("base_failed")).alias("n")), "sizes")
    langs = _by_group(sizes.groupBy("lang").agg(F.sum("n").alias("in_lang"), F.min("n").alias("least")), "sizes")
    corpus = langs.agg(F.sum("in_lang").alias("in_all"), F.min("in_lang").alias("least_lang"))
    key = lambda level, *names: F.struct(F.lit(level).alias("level"), *(n.alias(c) for c, n in zip(GROUP, names)))
    own, lang, all_ = key(0, F.col("lang"), F.col("source")), key(1, F.col("lang"), F.lit("")), key(2, F.lit(""), F.lit(""))
    enough = lambda n: F.col(n) >= LEAST_ROWS
    used = F.array(
        F.when(enough("n"), own), F.when(enough("in_lang") & ~enough("least"), lang), F.when(enough("in_all") & ~enough("least_lang"), all_)
    )
    judged = F.when(enough("n"), own).when(enough("in_lang"), lang).when(enough("in_all"), all_)
    sized = sizes.join(langs, "lang").crossJoin(corpus)
    return _by_group(sized.select(*GROUP, F.array_compact(used).alias("used"), judged.alias("judged")), "levels")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, d2 and kept of each document.

    Documents that fail the base limits are not kept and take no part in the estimates.
    The others are kept unless their squared distance from their group's centre is above
    FAR; where fewer than LEAST_ROWS of a group passed, the centre is that of its language,
    and with fewer in the language that of all. Only a table with fewer in all has no
    estimate and keeps them. Null lang or source is a value of its own, null text has no
    words; repeated rows count each; an empty table gives no rows. docs needs lang and
    source; other columns are not used.
    """
    rows = with_stats(counted(docs, key, text))
    levels = _levels(rows)
    passed = rows.where("NOT base_failed").join(levels, list(GROUP)).select(F.explode("used").alias("key"), *STATS)
    found = estimates(common.saved(passed.select("key.*", *STATS), "rule-stats"))
    wanted = levels.select(*(F.col(c).alias(f"_{c}") for c in GROUP), "judged.*")
    of = wanted.join(found, list(KEYS)).drop(*KEYS).withColumnsRenamed({f"_{c}": c for c in GROUP})
    found = _distance(rows.join(_by_group(of, "estimates"), list(GROUP), "left"))
    found = found.withColumn("d2", F.col("d2") / CONSISTENCY)
    far = F.coalesce(F.col("d2") > FAR, F.lit(False))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "d2", (~F.col("base_failed") & ~far).alias("kept"),
    )
