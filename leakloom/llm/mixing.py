"""Mixing sources to target weights by iterative proportional fitting, within a token budget.

Documents are added up to cells (source, language, topic). Each margin's target shares
become goals that add up to the budget: a value that has fewer tokens than its share asks for
gives all it has, and the others share the rest in proportion. Raking scales the cells' token
weights to the goal of every source, then of every language, then of every topic, again
and again; no cell exceeds its own tokens. What a cell keeps of its tokens is the
probability with which each of its documents is kept. A scarce value therefore costs the others
nothing. report() says which targets are out of reach and how near the fit has come.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leakloom.llm import common

MARGINS = ("source", "lang", "topic")
#: Shares are flattened to this power where no target is given.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
ROUNDS = 12
#: Part of all tokens that is to stay, if the margins can give it.
BUDGET = 0.7
#: Rounds between two written tables, so that plans stay short.
CUT = 4
NONE = "(none)"


def topic_of(text: Column, words: Column) -> Column:
    """What kind of text it is, by its form."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("***") | text.contains("###"), "marks")
        .when(text.contains("!! "), "shouts")
        .when(words < 50, "note")
        .when(words >= 2000, "book")
        .otherwise("prose")
    )


def classed(docs: DataFrame, text: str = "text", topic: Column | None = None) -> DataFrame:
    """doc (the columns of docs), tokens (words) and the margins of each document."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("doc"), body.alias("_text"), common.n_words(body).alias("tokens"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in MARGINS[:2]),
        (F.lit(None) if topic is None else F.coalesce(topic.cast("string"), F.lit(NONE))).alias("_topic"),
    )
    kind = topic_of(F.col("_text"), F.col("tokens")) if topic is None else F.col("_topic")
    return rows.select("doc", "tokens", "source", "lang", kind.alias("topic"))


def goals(cells: DataFrame, margin: str, wanted: Mapping[str, float] | None, power: float, budget: float) -> DataFrame:
    """margin, tokens, its target share (as wanted, 0 for values not named, or the own share to a power) and its goal in tokens.

    From the value that falls shortest of its share on, each asks whether the rest of the
    budget by shares is more than it has; the largest rate that any is asked for is the one of all
    that have enough.
    """
    own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens"))
    if wanted is None:
        weight = F.pow("tokens", F.lit(power))
    else:
        weight = reduce(lambda c, kv: F.when(F.col(margin) == kv[0], float(kv[1])).otherwise(c), wanted.items(), F.lit(0.0))
    everything = W.partitionBy()
    shared = own.withColumn("w", weight).withColumn("share", F.coalesce(F.try_divide("w", F.sum("w").over(everything)), F.lit(0.0)))
    order = [F.coalesce(F.try_divide("tokens", "share"), F.lit(float("inf"))), F.col(margin)]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.lit(budget) * F.sum("tokens").over(everything) - F.coalesce(F.sum("tokens").over(before), F.lit(0.0))
    rate = F.try_divide(left, F.sum("share").over(after))
    rated = shared.withColumn("rate", rate).withColumn("rate", F.max("rate").over(everything))
    goal = F.least(F.col("tokens"), F.col("share") * F.coalesce("rate", F.lit(0.0)))
    return rated.select(margin, "tokens", "share", goal.alias("goal"))


def rake(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Adds fitted, the tokens that a cell is to keep, from the goals to_source, to_lang and to_topic."""
    fitted = cells.withColumn("fitted", F.col("tokens").cast("double"))
    for i in range(rounds):
        for margin in MARGINS:
            factor = F.try_divide(F.col(f"to_{margin}"), F.sum("fitted").over(W.partitionBy(margin)))
            scaled = F.col("fitted") * F.coalesce(factor, F.lit(0.0))
            fitted = fitted.withColumn("fitted", F.least(F.col("tokens").cast("double"), scaled))
        if i % CUT == CUT - 1:
            fitted = common.saved(fitted, "raked")
    return fitted


def weights(
    rows: DataFrame, wanted: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS, budget: float = BUDGET
) -> DataFrame:
    """source, lang, topic, tokens, fitted and probability of each cell of a frame made by classed().

    Cells are few (sources x languages x topics); what windows over all cells gather is
    one row each, added up before. A cell without tokens has probability 1: nothing in it
    counts against a target.
    """
    cells = common.saved(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    aimed = cells.where("tokens > 0")
    for margin in MARGINS:
        goal = goals(cells.where("tokens > 0"), margin, (wanted or {}).get(margin), POWERS[margin], budget)
        aimed = aimed.join(goal.select(margin, F.col("goal").alias(f"to_{margin}")), margin)
    fitted = rake(aimed, rounds).select(*MARGINS, "fitted")
    share = F.when(F.col("tokens") > 0, F.coalesce("fitted", F.lit(0.0)) / F.col("tokens")).otherwise(1.0)
    return common.saved(cells.join(fitted, list(MARGINS), "left").withColumn("probability", share), "mix")


def report(
    docs: DataFrame, wanted: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS,
    text: str = "text", budget: float = BUDGET, topic: Column | None = None,
) -> DataFrame:
    """margin, value, tokens, share (its target), goal, expected (tokens that stay) and reachable of each value.

    A target is out of reach if the value has fewer tokens than its share of the budget; its
    goal is then all it has.
    """
    cells = weights(classed(docs, text, topic), wanted, rounds, budget)
    out = []
    for margin in MARGINS:
        goal = goals(cells.where("tokens > 0"), margin, (wanted or {}).get(margin), POWERS[margin], budget)
        stays = cells.groupBy(margin).agg(F.sum("fitted").alias("expected"))
        asked = F.col("share") * F.lit(budget) * F.sum("tokens").over(W.partitionBy())
        out.append(goal.withColumn("reachable", F.col("tokens") >= asked).join(stays, margin).select(
            F.lit(margin).alias("margin"), F.col(margin).alias("value"), "tokens", "share", "goal", "expected", "reachable"
        ))
    return reduce(DataFrame.union, out)


def draw(key: Column) -> Column:
    """A number from 0 to below 1 for a key; the same for the same key (null is a key)."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def mix(
    docs: DataFrame, wanted: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS,
    key: str = "doc_id", text: str = "text", budget: float = BUDGET, topic: Column | None = None,
) -> DataFrame:
    """doc (the columns of docs), source, lang, topic, tokens, probability and kept of each document.

    wanted gives target shares for some margins, e.g. {"lang": {"en": 1, "de": 1}}; other
    margins get their own shares, flattened. budget is the part of all tokens that is to stay.
    topic is a column of docs or another expression over them, by default the kind of text.
    Null source, lang or topic is a value of its own; null and empty texts have no tokens and are
    drawn with their cell, which stays whole if none of it has tokens; repeated ids share their
    draw; very long texts count with all their words; an empty table gives no rows; columns
    of docs only appear inside doc.
    """
    rows = classed(docs, text, topic)
    of = weights(rows, wanted, rounds, budget).select(*MARGINS, "probability")
    joined = rows.join(of, list(MARGINS))
    return joined.select(
        "doc", *MARGINS, "tokens", "probability", (draw(F.col(f"doc.{key}")) < F.col("probability")).alias("kept")
    )


def oracle(rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """The same in DuckDB over documents, one subquery for each scaling."""
    blank = r"[^\x20\x09-\x0D]+"
    margins = ", ".join(
        f"""m_{m} AS (SELECT {m}, s, pow(s, {POWERS[m]}) / sum(pow(s, {POWERS[m]})) OVER () AS share
    FROM (SELECT {m}, CAST(sum(tokens) AS DOUBLE) AS s FROM cells WHERE tokens > 0 GROUP BY {m})),
l_{m} AS (SELECT {m}, s, share, ({budget} * sum(s) OVER () - coalesce(sum(s) OVER (ORDER BY s / share, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(share) OVER (ORDER BY s / share, {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM m_{m}),
g_{m} AS (SELECT {m}, least(s, share * max(rate) OVER ()) AS goal FROM l_{m})"""
        for m in MARGINS
    )
    aims = ", ".join(f"g_{m}.goal AS to_{m}" for m in MARGINS)
    joins = " ".join(f"JOIN g_{m} USING ({m})" for m in MARGINS)
    steps, last = [], "aimed"
    for i in range(rounds):
        for m in MARGINS:
            name = f"r{i}_{m}"
            steps.append(
                f"{name} AS (SELECT * REPLACE (least(CAST(tokens AS DOUBLE), coalesce(f * (to_{m} / nullif(sum(f) OVER (PARTITION BY {m}), 0)), 0)) AS f) FROM {last})"
            )
            last = name
    return f"""WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    len(regexp_extract_all(coalesce(text, ''), '{blank}')) AS tokens FROM documents),
rows AS (SELECT doc_id, source, lang, tokens, CASE WHEN contains(text, ' | ') THEN 'table'
    WHEN contains(text, '***') OR contains(text, '###') THEN 'marks' WHEN contains(text, '!! ') THEN 'shouts'
    WHEN tokens < 50 THEN 'note' WHEN tokens >= 2000 THEN 'book' ELSE 'prose' END AS topic FROM words),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM rows GROUP BY ALL),
{margins},
aimed AS MATERIALIZED (SELECT source, lang, topic, tokens, CAST(tokens AS DOUBLE) AS f, {aims} FROM cells {joins} WHERE tokens > 0),
{", ".join(steps)},
fitted AS (SELECT source, lang, topic, f / tokens AS p FROM {last})
SELECT r.doc_id, r.source, r.lang, r.topic, r.tokens,
  round(coalesce(p, CASE WHEN c.tokens > 0 THEN 0 ELSE 1 END), 6) AS probability,
  CAST(('0x' || substr(md5(coalesce(CAST(r.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0
    < coalesce(p, CASE WHEN c.tokens > 0 THEN 0 ELSE 1 END) AS kept
FROM rows r JOIN cells c USING (source, lang, topic) LEFT JOIN fitted USING (source, lang, topic)"""
