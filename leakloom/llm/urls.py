"""URL filters: rules by host and path, and gradient-boosted trees for URLs that no rule fits.

The trees see lexical features only: length, depth, digit ratio, entropy, parameter count
and statistics of host and file suffixes. They are trained on labelled URLs. Everything is
DataFrame expressions and Spark's own trees; no shuffle but the counts of the suffixes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from leakloom.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "block_rate", "seen", "file")


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def parsed(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls packed into doc, with _url, host and path (both empty for null and without `://`)."""
    named = urls.select(F.struct("*").alias("doc"), F.col(url).cast("string").alias("_url"))
    # What follows the first "://".
    rest = F.when(F.instr("_url", "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    return named.withColumn("_rest", F.coalesce(rest, F.lit(""))).select(
        "doc", "_url",
        F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def judged(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds rule and ruled (its verdict): of the rules that fit, the longest; null if none fits."""
    names, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        names, verdicts = F.when(fits, r.name).otherwise(names), F.when(fits, r.verdict).otherwise(verdicts)
    return found.withColumns({"rule": names, "ruled": verdicts})


def _entropy(text: Column) -> Column:
    """Entropy of the characters in bits: one sort, then the lengths of runs of equal characters."""
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def add(state: Column, c: Column) -> Column:
        same = state["c"] == c
        run = state["run"]
        done = F.when(run > 1, run * F.log2(run)).otherwise(0.0)
        return F.struct(
            c.alias("c"),
            F.when(same, run + 1.0).otherwise(1.0).alias("run"),
            (state["sum"] + F.when(same, 0.0).otherwise(done)).alias("sum"),
        )

    def end(state: Column) -> Column:
        run = state["run"]
        return state["sum"] + F.when(run > 1, run * F.log2(run)).otherwise(0.0)

    n = F.char_length(text)
    runs = F.aggregate(F.sort_array(F.split(text, "")), start, add, end)
    return F.when(n > 1, F.log2(n) - runs / n).otherwise(0.0)


def _suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def with_features(found: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds FEATURES. suffixes: suffix, block_rate, seen of the training sample, one row each."""
    url = F.coalesce("_url", F.lit(""))
    n = F.char_length(url)
    lexical = found.withColumns({
        "length": n.cast("double"),
        "host_length": F.char_length("host").cast("double"),
        "labels": F.regexp_count("host", F.lit(r"[^.]+")).cast("double"),
        "depth": F.regexp_count("path", F.lit(r"[^/]+")).cast("double"),
        "digits": F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": _entropy(url),
        "parameters": F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("[^&]+")).cast("double"),
        "file": F.char_length(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)).cast("double"),
        "suffix": _suffix(F.col("host")),
    })
    joined = lexical.join(F.broadcast(suffixes), "suffix", "left")
    return joined.fillna({"block_rate": 0.5, "seen": 0.0})


class Filter(NamedTuple):
    """Rules, suffix statistics and trees; `trees` is None where all labels are alike."""

    rules: tuple[Rule, ...]
    suffixes: DataFrame
    trees: Transformer | None
    verdict: str

    def apply(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """doc (the columns of urls), host, path, rule, verdict and score of each row.

        The longest rule that fits a host (or a domain above it) and the start of the path
        decides; where none fits, the trees do: block from a probability of 0.5 on, which
        score holds (null for rules). Null urls have empty host and path; repeated rows get
        the same verdict; an empty table gives no rows.
        """
        found = judged(parsed(urls, url), self.rules)
        if self.trees is None:
            scored = found.withColumn("_p", F.lit(float(self.verdict == "block")))
        else:
            rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(with_features(found, self.suffixes))
            scored = self.trees.transform(rows).withColumn("_p", vector_to_array("probability")[1])
        method = F.when(F.col("_p") >= 0.5, "block").otherwise("allow")
        return scored.select(
            "doc", "host", "path", "rule",
            F.coalesce("ruled", method).alias("verdict"),
            F.when(F.col("rule").isNull(), F.col("_p")).alias("score"),
        )


def fit(
    labelled: DataFrame, rules: Sequence[Rule] = RULES, sample: int = 20_000, url: str = "url", label: str = "label",
    trees: int = 20, depth: int = 4,
) -> Filter:
    """Trees from labelled URLs (label: allow or block; other labels are ignored).

    The sample is the `sample` labelled rows with the smallest hash of their URL. Rates of
    suffixes are smoothed with one allowed and one blocked row.
    """
    known = labelled.where(F.col(label).isin("allow", "block"))
    order = F.xxhash64(F.col(url), F.lit("urls"))
    chosen = common.saved(
        known.select(F.col(url).cast("string").alias("url"), F.col(label).alias("label")).orderBy(order, "url", "label").limit(sample),
        "url-sample",
    )
    found = parsed(chosen).withColumns({"y": (F.col("doc.label") == "block").cast("double"), "suffix": _suffix(F.col("host"))})
    suffixes = found.groupBy("suffix").agg(
        ((F.sum("y") + 1) / (F.count("y") + 2)).alias("block_rate"), F.log1p(F.count("y")).alias("seen")
    )
    suffixes = common.saved(suffixes, "url-suffixes")
    classes = found.agg(F.min("y").alias("low"), F.max("y").alias("high")).first()
    if classes["low"] is None or classes["low"] == classes["high"]:
        return Filter(tuple(rules), suffixes, None, "block" if classes["high"] else "allow")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(with_features(found.drop("suffix"), suffixes))
    model = GBTClassifier(
        featuresCol="_x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=3
    ).fit(rows.select("_x", "y"))
    return Filter(tuple(rules), suffixes, model, "allow")
