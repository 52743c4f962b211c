"""Match extraction and false-positive suppression.

Everything happens inside the document's own row, so scanning needs no shuffle.

Spark's regex functions report matched texts but no positions. They are recovered by
laying the document out again, gap by gap, with a small token in front of every
match that carries the match's ordinal:

    gap0 <token 0> match0 gap1 <token 1> match1 ...

Split at newlines, the array index of a piece is the line number, and the text before
a token on its line gives column and context. The work is linear in the document.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from leakloom.functions import catalog, text as tx
from leakloom.functions.catalog import RULES, Rule

# Token delimiters. Private-use characters behave alike in every rule, so replacing
# stray ones in the laid-out copy changes neither matches nor lengths.
OPEN, CLOSE, STRAY = "\ue000", "\ue001", "\ue002"

def gate(code: Column, fold: Column, rule: Rule) -> Column:
    text = code if rule.cased else fold
    likely = tx.has_any(text, rule.needles)
    return likely & F.contains(text, F.lit(rule.also)) if rule.also else likely


def match_column(rule: Rule) -> str:
    return f"_m{rule.id:02d}"


def _all_of(code: Column, rule: Rule) -> Column:
    """Matched texts in order, empty where the rule took text that is no match."""
    return F.regexp_extract_all(code, F.lit(rule.regex), F.lit(2 if rule.skips else 0))


def _matches_of(code: Column, rule: Rule) -> Column:
    found = _all_of(code, rule)
    return F.filter(found, lambda m: m != "") if rule.skips else found


def _gaps_of(code: Column, rule: Rule) -> Column:
    """The texts before each match, and the rest; one more than matches."""
    pieces = F.split(F.regexp_replace(code, rule.regex, "$1" + OPEN), OPEN, -1)
    # Every text that was taken is followed by a token; keep those of matches.
    kept = F.zip_with(
        pieces, _all_of(code, rule), lambda g, m: F.when(m != "", F.concat(g, F.lit(OPEN))).otherwise(g)
    )
    return F.split(F.array_join(kept, ""), OPEN, -1)


def _pieces_of(clean: Column, rule: Rule) -> Column:
    """The text before the first match, then each match, CLOSE and the text after it; null without a match.

    One pass of the regex gives matches and gaps. ``clean`` holds no tokens of its own.
    """
    marked = F.regexp_replace(clean, rule.regex, OPEN + "$0" + CLOSE)
    return tx.let(marked, lambda t: F.when(F.contains(t, F.lit(OPEN)), F.split(t, OPEN, -1)))


# Expressions name their columns and do not depend on a frame, so each is built once.


@lru_cache
def _match_columns(rules: tuple[Rule, ...]) -> list[Column]:
    code, fold, clean = F.col("code"), F.col("_fold"), F.col("_clean")
    taken = {r: _matches_of(code, r) if r.skips else _pieces_of(clean, r) for r in rules}
    return [F.when(gate(code, fold, r), taken[r]).alias(match_column(r)) for r in rules]


def with_matches(df: DataFrame, rules=RULES) -> DataFrame:
    """Add ``_clean`` (the code without tokens) and one array per rule, null where the rule cannot match.

    It holds the pieces of the text (see ``_pieces_of``), or the matched texts of a rule that skips.
    """
    folded = df.withColumns({"_fold": tx.folded(F.col("code")), "_clean": _without_tokens(F.col("code"))})
    return folded.select(*df.columns, "_clean", *_match_columns(tuple(rules)))


def _without_tokens(text: Column) -> Column:
    return F.when(
        tx.has_any(text, (OPEN, CLOSE)), F.translate(text, OPEN + CLOSE, STRAY + STRAY)
    ).otherwise(text)


@lru_cache
def _layouts(rules: tuple[Rule, ...]) -> Column:
    per_rule = []
    for r in rules:
        taken, clean = F.col(match_column(r)), F.col("_clean")
        if r.skips:
            found, gaps = taken, F.slice(_gaps_of(clean, r), F.lit(1), F.size(taken))
        else:
            texts = F.transform(F.slice(taken, F.lit(2), F.size(taken)), lambda p: F.substring_index(p, CLOSE, 1))
            found = F.when(clean == F.col("code"), texts).otherwise(_matches_of(F.col("code"), r))
            later = F.transform(F.slice(taken, F.lit(2), F.size(taken) - 2), _after_token)
            gaps = F.concat(F.array(F.element_at(taken, 1)), later)
        per_rule.append(
            F.when(F.size(taken) > 0, F.struct(F.lit(r.id).alias("rule"), found.alias("found"), gaps.alias("gaps")))
        )
    return F.array_compact(F.array(*per_rule)).alias("_found")


def with_layouts(df: DataFrame, rules=RULES) -> DataFrame:
    """Add ``_found``: one struct per rule that matched, with its matches and gaps.

    There are as many gaps as matches; the text after the last match is not needed.
    """
    return with_matches(df, rules).select(*df.columns, _layouts(tuple(rules)))


def marked_lines(found: Column, gaps: Column) -> Column:
    """Lines on which a match starts: array<struct<line:int, text:string>> with tokens."""
    laid_out = F.array_join(
        F.transform(
            F.zip_with(
                gaps, found, lambda g, m: F.struct(g.alias("g"), _without_tokens(m).alias("m"))
            ),
            lambda z, i: F.concat(
                z["g"], F.lit(OPEN), i.cast("string"), F.lit(CLOSE), z["m"]
            ),
        ),
        "",
    )
    numbered = F.transform(
        F.split(laid_out, "\n", -1),
        lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")),
    )
    return F.filter(numbered, lambda x: F.contains(x["text"], F.lit(OPEN)))


def _any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.rlike(text, F.lit(p))
    return hit


def is_namespace_context(before: Column) -> Column:
    return _any_of(before, catalog.NAMESPACE_CONTEXTS)


def url_host(url: Column) -> Column:
    """Host of a plain http address, lower-case, cut at the first / ? # or :"""
    return F.lower(F.regexp_extract(url, r"(?is)\A.{7}([^/?#:]*)", 1))


def is_namespace_host(host: Column, hosts=catalog.NAMESPACE_HOSTS) -> Column:
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    return F.rlike(host, F.lit(rf"(?:^|\.)(?:{names})\z"))


def is_batch_file(filename: Column) -> Column:
    return F.rlike(F.lower(filename), F.lit(catalog.BATCH_FILE))


def is_batch_token(before: Column) -> Column:
    return F.rlike(before, F.lit(catalog.BATCH_TOKEN))


def is_suppressed(
    rule: Column, recent: Column, seen: Column, match: Column, filename: Column
) -> Column:
    """Known false positives. Suppressed matches take no part in any later step.

    ``recent`` is the text since the previous match of the rule on the line began, which is
    all that a pattern right before the match can reach; ``seen`` tells whether the text
    before that held a namespace word.
    """
    return (
        F.when(
            rule == catalog.HTTP_RULE,
            is_namespace_host(url_host(match)) | seen | is_namespace_context(recent),
        )
        .when(rule == catalog.EVAL_RULE, is_batch_file(filename) | is_batch_token(recent))
        .otherwise(F.lit(False))
    )


def _ordinal(piece: Column) -> Column:
    return F.substring_index(piece, CLOSE, 1).cast("int")


def _after_token(piece: Column) -> Column:
    return F.substring(piece, F.instr(piece, CLOSE) + 1, F.length(piece))


def _first_on_line(r: Column, text: Column, filename: Column) -> Column:
    """The first match on a marked line that is not suppressed, as (col, k); else k = -1."""
    nothing, never = F.lit(-1), F.lit(False)
    state = lambda recent, seen, col, k: F.struct(
        recent.alias("recent"), seen.alias("seen"), col.alias("col"), k.alias("k")
    )

    def step(s, piece):
        def at(k):
            hit = ~is_suppressed(r["rule"], s["recent"], s["seen"], F.get(r["found"], k), filename)
            # The next match begins with a letter, so a word right before it goes on.
            seen = s["seen"] | (
                (r["rule"] == catalog.HTTP_RULE)
                & _any_of(F.concat(s["recent"], F.lit("h")), catalog.NAMESPACE_ANYWHERE)
            )
            passed = tx.let(
                _after_token(piece), lambda t: state(t, seen, s["col"] + F.length(t), nothing)
            )
            return F.when(hit, state(F.lit(""), never, s["col"], k)).otherwise(passed)

        return F.when(s["k"] >= 0, s).otherwise(tx.let(_ordinal(piece), at))

    return tx.let(
        F.split(text, OPEN, -1),
        lambda p: F.aggregate(
            F.slice(p, F.lit(2), F.size(p)),
            state(F.element_at(p, 1), never, F.length(F.element_at(p, 1)), nothing),
            step,
        ),
    )


def _rule_hits(r: Column, filename: Column) -> Column:
    """At most one hit per line of one rule: the first match that is not suppressed."""
    firsts = F.transform(
        marked_lines(r["found"], r["gaps"]),
        lambda x: F.struct(
            x["line"].alias("line"), _first_on_line(r, x["text"], filename).alias("at")
        ),
    )
    return F.transform(
        F.filter(firsts, lambda x: x["at"]["k"] >= 0),
        lambda x: F.struct(
            x["line"].cast("int").alias("line"),
            r["rule"].alias("rule"),
            x["at"]["col"].cast("int").alias("column"),
            tx.redact(F.get(r["found"], x["at"]["k"])).alias("match"),
        ),
    )


@lru_cache
def _hits() -> Column:
    return F.sort_array(
        F.flatten(F.transform("_found", lambda r: _rule_hits(r, F.col("filename"))))
    )


def with_hits(df: DataFrame, rules=RULES) -> DataFrame:
    """Add ``_hits``: per (line, rule) the surviving hit, ordered by line then rule."""
    found = with_layouts(df, rules)
    return tx.compute_once(found, "_hits", _hits()).select(*df.columns, "_hits")


def all_matches(df: DataFrame, rules=RULES) -> DataFrame:
    """Every match of every rule with its position, before any suppression.

    One row per match: rule, type, k (ordinal), offset, line, column, before (text
    before it on its line) and the matched text.
    """
    keep = [c for c in df.columns if c != "code"]
    types = F.array(*[F.lit(r.type) for r in RULES])
    steps = F.zip_with(
        F.col("r.gaps"),
        F.concat(F.array(F.lit("")), F.slice("r.found", F.lit(1), F.size("r.found") - 1)),
        lambda g, m: (F.length(g) + F.length(m)).cast("bigint"),
    )
    rows = (
        with_layouts(df, rules)
        .select(*keep, F.explode_outer("_found").alias("r"))
        .where(F.col("r").isNotNull())
        .select(
            *keep, "r.rule", "r.found",
            tx.running_totals(steps).alias("offsets"),
            F.explode_outer(marked_lines(F.col("r.found"), F.col("r.gaps"))).alias("l"),
        )
        .select(*keep, "rule", "found", "offsets", "l.line", F.split("l.text", OPEN, -1).alias("p"))
        .select("*", F.posexplode(F.slice("p", F.lit(2), F.size("p"))).alias("at", "piece"))
    )
    before = F.concat(
        F.element_at("p", 1),
        F.array_join(F.transform(F.slice("p", F.lit(2), F.col("at")), _after_token), ""),
    )
    return (
        rows.withColumn("k", _ordinal(F.col("piece")))
        .withColumn("before", before)
        .select(
            *keep, "rule", F.get(types, F.col("rule")).alias("type"), "k",
            F.get("offsets", F.col("k")).cast("int").alias("offset"),
            F.col("line").cast("int").alias("line"),
            F.length("before").cast("int").alias("column"),
            "before",
            F.get("found", F.col("k")).alias("text"),
        )
    )
