"""DuckDB statements for the scan, written with windows instead of arrays."""

from __future__ import annotations

from leakloom.functions import catalog
from leakloom.functions.catalog import RULES
from registry.views import CORPUS_SQL, q

# White space for RE2, whose \s is ASCII without the vertical tab (fixed values).
_WS = (
    r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def re2(pattern: str) -> str:
    return pattern.replace(catalog.WS_CLASS, _WS)


def rule_pattern(rule) -> str:
    p = re2(rule.pattern)
    if rule.id == catalog.SQL_FORMAT_RULE:
        # RE2 has no lookahead: take one more character and strip it again below.
        head, _ = p.split("(?!")
        p = rf"""{head}(?:[{_WS}]*[^{_WS}'"]|[{_WS}]*\z)"""
    return ("" if rule.cased else "(?i)") + p


def _rule_select(rule, source: str) -> str:
    p = q(rule_pattern(rule))
    return (
        f"SELECT doc_id, {rule.id} AS rule, regexp_extract_all(code, {p}, 0) AS ms, "
        f"string_split_regex(code, {p}) AS gs FROM {source} WHERE regexp_matches(code, {p})"
    )


def matches_cte(source: str = "corpus", rules=RULES) -> str:
    """CTEs up to ``matches``: every match with offset, line, column and context."""
    union = "\nUNION ALL ".join(_rule_select(r, source) for r in rules)
    extra = q(rf"""%(?:[{_WS}]*[^{_WS}'"]|[{_WS}]*)\z""")
    rows = ", ".join(
        f"({r.id}, {q(r.type)}, {q(r.severity)}, {q(r.confidence)})" for r in RULES
    )
    return f"""
rules(rule, type, severity, confidence) AS (VALUES {rows}),
found AS MATERIALIZED ({union}),
numbered AS (SELECT doc_id, rule, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM found),
placed AS (
  SELECT doc_id, rule, CAST(i - 1 AS INT) AS k,
    CASE WHEN rule = {catalog.SQL_FORMAT_RULE} THEN regexp_replace(ms[i], {extra}, '%') ELSE ms[i] END AS text,
    CAST(list_sum(list_transform(gs[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INT) AS offset_
  FROM numbered),
prefixed AS (
  SELECT p.*, substr(s.code, 1, p.offset_) AS pre, s.filename
  FROM placed p JOIN {source} s USING (doc_id)),
matches AS (
  SELECT doc_id, filename, rule, k, text, offset_,
    CAST(length(pre) - length(replace(pre, chr(10), '')) + 1 AS INT) AS line,
    CAST(length(string_split(pre, chr(10))[-1]) AS INT) AS col,
    string_split(pre, chr(10))[-1] AS before
  FROM prefixed)"""


def suppressed_sql(before="before", text="text", filename="filename") -> str:
    contexts = " OR ".join(
        f"regexp_matches({before}, {q(re2(p).replace('(?iU)', '(?i)').replace('(?U)', ''))})"
        for p in catalog.NAMESPACE_CONTEXTS
    )
    names = "|".join(h.replace(".", r"\.") for h in catalog.NAMESPACE_HOSTS)
    token = q(re2(catalog.BATCH_TOKEN).replace("(?iU)", "(?i)"))
    return f"""CASE rule
 WHEN {catalog.HTTP_RULE} THEN {contexts}
   OR regexp_matches(lower(substr({text}, 8)), '(?:^|\\.)(?:{names})\\z')
 WHEN {catalog.EVAL_RULE} THEN regexp_matches(lower({filename}), '\\.(?:bat|cmd)\\z')
   OR regexp_matches({before}, {token})
 ELSE false END"""


REDACTED = """CASE WHEN length(trim(text)) <= 4 THEN '***'
 WHEN length(trim(text)) <= 12 THEN left(trim(text), 2) || '***' || right(trim(text), 2)
 ELSE left(trim(text), 4) || '...' || right(trim(text), 4) END"""


def findings_cte(source: str = "corpus", rules=RULES) -> str:
    """CTEs up to ``findings``: suppression, one per line, precedence."""
    return f"""{matches_cte(source, rules)},
kept AS (SELECT * FROM matches WHERE NOT ({suppressed_sql()})),
first_per_line AS (
  SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, rule, line ORDER BY offset_) = 1),
ranked AS (
  SELECT *, bool_or(rule = {catalog.SQL_CONCAT_RULE}) OVER (PARTITION BY doc_id, line) AS has_concat,
    min(rule) OVER (PARTITION BY doc_id, line) AS lowest
  FROM first_per_line),
findings AS (
  SELECT doc_id, filename, line, severity, rule, type, col AS "column", {REDACTED} AS match, confidence
  FROM ranked JOIN rules USING (rule)
  WHERE NOT (rule <= {catalog.LAST_SECRET_RULE} AND rule <> lowest)
    AND NOT (rule = {catalog.SQL_FORMAT_RULE} AND has_concat))"""


def corpus_cte() -> str:
    return f"WITH corpus AS MATERIALIZED ({CORPUS_SQL})"


def with_matches(rules=RULES) -> str:
    return f"{corpus_cte()}, {matches_cte(rules=rules)}"


def with_findings() -> str:
    return f"{corpus_cte()}, {findings_cte()}"
