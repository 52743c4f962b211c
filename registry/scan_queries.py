"""Sources, matches, rules, suppression, precedence, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom.functions import catalog, text as tx
from leakloom.functions.catalog import RULES
from leakloom.operators import admission, entries as en, findings as fd, matches, report
from leakloom.plans import archive_scan, scan
from leakloom.sources import archives as src, tables
from registry import scan_sql as sq, views as v
from registry.views import q

QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# --- sources and admission --------------------------------------------------------


def _without_some_names(spark, sf):
    c = v.corpus(spark, sf)
    return c.withColumn("filename", F.when(F.col("doc_id") % 3 != 0, F.col("filename")))


add(
    "S01_code_table",
    lambda spark, sf: tables.code_table(_without_some_names(spark, sf)).select(
        "doc_id", "filename", F.md5("code").alias("code_md5")
    ),
    f"{sq.corpus_cte()} SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN filename "
    "ELSE 'input.py' END AS filename, md5(code) AS code_md5 FROM corpus",
)


def file_tree(spark, sf):
    """Documents written as one file each, by as many tasks as the table has parts, then read back as a file tree."""
    path = v.work_dir(spark, "files")
    text = F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("value")
    tables.write_file_tree(v.table(spark, sf, "documents").select("doc_id", text), path)
    files = tables.file_tree(spark, path, "*.txt")
    return files.select(
        F.regexp_extract("path", r"/doc_id=(-?\d+)(/[^/]+|\.txt)$", 1).try_cast("long").alias("doc_id"),
        F.endswith("filename", F.lit(".txt")).alias("is_base_name"), F.md5("code").alias("code_md5"),
    )


add(
    "S02_file_tree",
    file_tree,
    "SELECT doc_id, true AS is_base_name, md5(text || chr(10)) AS code_md5 FROM documents",
)


def _raw_bytes(suffix):
    return F.concat(F.encode("text", "UTF-8"), F.lit(suffix))


add(
    "S02_decode_newlines",
    lambda spark, sf: tables.decode_files(
        v.table(spark, sf, "documents").select(
            F.concat(F.lit("/data/x/f"), F.col("doc_id").cast("string")).alias("path"),
            _raw_bytes(b"\r\n\xffa\rb\n").alias("content"),
        )
    ).select("filename", F.md5("code").alias("code_md5")),
    "SELECT 'f' || CAST(doc_id AS VARCHAR) AS filename, "
    "md5(text || chr(10) || chr(65533) || 'a' || chr(10) || 'b' || chr(10)) AS code_md5 FROM documents",
)
add(
    "S03_archive_entries",
    lambda spark, sf: v.archives(spark, sf)
    .select("archive", F.explode(src.list_entries(F.col("content"))["entries"]).alias("e"))
    .select("archive", "e.*"),
    f"{sq.corpus_cte()}, entries AS ({v.ENTRIES_SQL}) "
    "SELECT archive, entry_idx, name, size, is_dir FROM entries",
)
_N = "doc_id % 10"
add(
    "S04_admission",
    lambda spark, sf: admission.with_admission(v.request_bodies(spark, sf), max_chars=20000).select(
        "doc_id", "reason", "filename", F.length("code").alias("code_chars")
    ),
    f"""SELECT doc_id,
  CASE WHEN {_N} IN (1, 5) THEN 'no_code' WHEN {_N} = 2 THEN 'code_not_text'
    WHEN {_N} = 3 OR ({_N} = 7 AND doc_id % 300 + 100 > 255) THEN 'bad_filename'
    WHEN {_N} <> 4 AND length(text) > 20000 THEN 'code_too_long'
    WHEN {_N} = 4 THEN 'blank' ELSE 'scan' END AS reason,
  CASE WHEN {_N} = 3 THEN NULL WHEN {_N} = 1 THEN 'a.py' WHEN {_N} IN (2, 4, 5, 6) THEN 'input.py'
    WHEN {_N} = 7 THEN repeat('n', doc_id % 300 + 100)
    ELSE 'f' || CAST(doc_id AS VARCHAR) END AS filename,
  CAST(CASE WHEN {_N} IN (1, 2, 5) THEN NULL WHEN {_N} = 4 THEN 4 ELSE length(text) END AS INT) AS code_chars
FROM documents""",
)
_LIMITS = dict(max_bytes=120_000, max_entries=40, max_total=100_000)


def archive_admission(spark, sf):
    """Whole archives through the plan; a part of them holds bytes that are no archive."""
    zips = v.archives(spark, sf)
    odd = F.left(F.md5("archive"), F.lit(1)) < "5"
    torn = zips.withColumn("content", F.when(odd, F.encode("archive", "UTF-8")).otherwise(F.col("content")))
    # The packed size depends on the packer; the plan is told the size before packing.
    sizes = v.entries(spark, sf).groupBy("archive").agg(F.sum("size").alias("n_bytes"))
    rows = archive_scan.directories(torn.drop("n_bytes").join(sizes, "archive"), **_LIMITS)
    return rows.select("archive", "n_bytes", "reason", F.size(F.coalesce("entries", F.array())).alias("n_entries"))


add(
    "S05_archive_admission",
    archive_admission,
    f"""{sq.corpus_cte()}, entries AS ({v.ENTRIES_SQL}),
t AS (SELECT archive, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_bytes FROM entries GROUP BY archive),
r AS (SELECT *, CASE WHEN n_bytes > 120000 THEN 'too_large' WHEN left(md5(archive), 1) < '5' THEN 'not_a_zip'
  WHEN n > 40 THEN 'too_many_entries' WHEN n_bytes > 100000 THEN 'too_large_expanded' END AS reason FROM t)
SELECT archive, n_bytes, reason, CASE WHEN reason IS NULL THEN n ELSE 0 END AS n_entries FROM r""",
)
_SAFE_SQL = """CASE WHEN name LIKE '../%' THEN NULL
  ELSE array_to_string(list_filter(string_split(replace(name, '\\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') END"""
add(
    "S06_safe_path",
    lambda spark, sf: v.entries(spark, sf).select("doc_id", "name", en.safe_name(F.col("name")).alias("path")),
    f"{sq.corpus_cte()}, entries AS ({v.ENTRIES_SQL}) SELECT doc_id, name, {_SAFE_SQL} AS path FROM entries",
)
# Every suffix and bare name that counts as code, and some that do not; with and without a stem.
_ENDINGS = (*catalog.CODE_SUFFIXES, *catalog.BARE_NAMES, ".txt", ".pyc", ".md", "", ".JSON", "DockerFile", ".Vue")


def scannable_names(spark, sf):
    i = F.col("doc_id")
    stem = F.when(i % 3 == 0, "").when(i % 3 == 1, "src/").otherwise(F.concat(F.lit("src/f"), i.cast("string")))
    name = F.concat(stem, v._pick(_ENDINGS, i % len(_ENDINGS)))
    return v.table(spark, sf, "documents").select("doc_id", name.alias("filename")).withColumn(
        "scannable", en.is_scannable(F.col("filename"))
    )


_CODE = "|".join(x[1:] for x in catalog.CODE_SUFFIXES)
_BARE = ", ".join(map(q, catalog.BARE_NAMES))
add(
    "S07_scannable",
    scannable_names,
    f"""WITH n AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'src/' ELSE 'src/f' || CAST(doc_id AS VARCHAR) END
    || {v._sql_pick(_ENDINGS, f'doc_id % {len(_ENDINGS)}')} AS filename FROM documents),
b AS (SELECT *, lower(regexp_replace(filename, '^.*/', '')) AS base FROM n)
SELECT doc_id, filename, base IN ({_BARE}) OR regexp_matches(base, '^.+\\.({_CODE})$') AS scannable FROM b""",
)
add(
    "S08_size_filter",
    lambda spark, sf: v.entries(spark, sf).where(en.is_small_enough(F.col("size"), 5000)).select("doc_id", "size"),
    f"{sq.corpus_cte()}, entries AS ({v.ENTRIES_SQL}) SELECT doc_id, size FROM entries WHERE size <= 5000",
)
add(
    "S09_binary_filter",
    lambda spark, sf: v.table(spark, sf, "documents").select(
        "doc_id",
        en.looks_binary(
            F.when(F.col("doc_id") % 2 == 0, _raw_bytes(b"\0x")).otherwise(_raw_bytes(b"x"))
        ).alias("is_binary"),
    ),
    "SELECT doc_id, doc_id % 2 = 0 AND strlen(text) < 8192 AS is_binary FROM documents",
)
add(
    "S10_archive_decode",
    lambda spark, sf: v.table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.decode_utf8(_raw_bytes(b"\r\n\xff"))).alias("code_md5")
    ),
    "SELECT doc_id, md5(text || chr(13) || chr(10) || chr(65533)) AS code_md5 FROM documents",
)


def nested_sink(spark, sf):
    path = v.work_dir(spark, "results")
    results = scan.scan_requests(v.corpus(spark, sf))
    tables.write_results(scan.scan_document(results, "doc_id"), path)
    back = spark.read.schema(scan.scan_document(results, "doc_id").schema).json(path)
    pairs = F.explode(F.arrays_zip("findings", "report")).alias("x")
    counts = [F.col(f"summary.{s}").alias(s) for s in catalog.SEVERITIES]
    return back.select("doc_id", "file", "total", *counts, pairs).select(
        "doc_id", "file", "total", *catalog.SEVERITIES, "x.findings.type", "x.findings.line", "x.findings.column",
        "x.findings.match", "x.report.severity_raw", "x.report.titlu", "x.report.match_redactat",
    )


_COUNTS = ", ".join(
    f"CAST(count(*) FILTER (severity = '{s}') OVER (PARTITION BY doc_id) AS INT) AS {s}" for s in catalog.SEVERITIES
)
_TITLES = f"templates(type, title) AS (VALUES {', '.join(f'({q(k)}, {q(t[0])})' for k, t in catalog.TEMPLATES.items())})"
add(
    "S11_nested_sink",
    nested_sink,
    f"""{sq.with_findings()}, {_TITLES} SELECT doc_id, filename AS file,
  CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total, {_COUNTS}, f.type, line, "column", match,
  severity AS severity_raw, title AS titlu, match AS match_redactat FROM findings f JOIN templates t ON t.type = f.type""",
)


def saved(spark, sf):
    found = fd.with_findings(v.corpus(spark, sf))
    slim = F.transform(
        "findings",
        lambda f: F.struct(*[f[c].alias(c) for c in ("type", "severity", "line", "match", "confidence")]),
    )
    bare = F.to_json(slim)
    nested = F.to_json(F.struct(slim.alias("findings"), F.col("code")))
    docs = found.select("doc_id", F.when(F.col("doc_id") % 2 == 0, bare).otherwise(nested).alias("value"))
    rows = tables.saved_findings(docs)
    return rows.select("doc_id", F.md5("code").alias("code_md5"), F.explode("findings").alias("f")).select(
        "doc_id", "code_md5", "f.type", "f.severity", "f.line", "f.match"
    )


add(
    "S13_saved_findings",
    saved,
    f"""{sq.with_findings()} SELECT f.doc_id, md5(CASE WHEN f.doc_id % 2 = 0 THEN '' ELSE code END) AS code_md5,
  type, severity, line, match FROM findings f JOIN corpus c USING (doc_id)""",
)

# --- matches and rules ------------------------------------------------------------


def _matches(spark, sf, rules=RULES):
    return matches.all_matches(v.corpus(spark, sf).select("doc_id", "filename", "code"), rules)


def _match_query(*columns, **extra):
    def run(spark, sf):
        m = _matches(spark, sf)
        return m.select("doc_id", "rule", "k", *columns, *[f(m).alias(n) for n, f in extra.items()])

    return run


_M = f"{sq.with_matches()} SELECT doc_id, rule, k, "
add("M01_matches", _match_query("text"), _M + "text FROM matches")
add("M02_offset", _match_query("offset"), _M + 'offset_ AS "offset" FROM matches')
add("M03_line", _match_query("line"), _M + "line FROM matches")
add("M04_column", _match_query("column"), _M + 'col AS "column" FROM matches')
add("M05_text_before", _match_query("before"), _M + "before FROM matches")
add(
    "M06_redaction",
    _match_query(match=lambda m: tx.redact(F.col("text"))),
    _M + f"{sq.REDACTED} AS match FROM matches",
)
add(
    "M07_rule_fields",
    lambda spark, sf: fd.explode_findings(fd.with_findings(v.corpus(spark, sf)), "doc_id").select(
        "doc_id", "line", "type", "severity", "confidence", "description"
    ),
    f"{sq.with_findings()} SELECT doc_id, line, f.type, severity, confidence, d.description FROM findings f "
    f"JOIN (VALUES {', '.join(f'({q(r.type)}, {q(r.description)})' for r in RULES)}) AS d(type, description) "
    "ON d.type = f.type",
)
for _r in RULES:
    add(
        f"R{_r.id:02d}_{_r.type}",
        lambda spark, sf, r=_r: _matches(spark, sf, [r]).select(
            "doc_id", "k", "offset", "line", "column", "text"
        ),
        f"{sq.with_matches([_r])} "
        'SELECT doc_id, k, offset_ AS "offset", line, col AS "column", text FROM matches',
    )

# --- suppression ------------------------------------------------------------------

_HTTP, _EVAL = [RULES[catalog.HTTP_RULE]], [RULES[catalog.EVAL_RULE]]


def _flagged(rules, name, expr):
    return lambda spark, sf: _matches(spark, sf, rules).select("doc_id", "k", "text", expr().alias(name))


_contexts = " OR ".join(
    f"regexp_matches(before, {q(sq.re2(p).replace('(?iU)', '(?i)').replace('(?U)', ''))})"
    for p in catalog.NAMESPACE_CONTEXTS
)
add(
    "X01_namespace_context",
    _flagged(_HTTP, "in_context", lambda: matches.is_namespace_context(F.col("before"))),
    f"{sq.with_matches(_HTTP)} SELECT doc_id, k, text, {_contexts} AS in_context FROM matches",
)
add(
    "X02_url_host",
    _flagged(_HTTP, "host", lambda: matches.url_host(F.col("text"))),
    f"{sq.with_matches(_HTTP)} SELECT doc_id, k, text, lower(substr(text, 8)) AS host FROM matches",
)
add(
    "X02_url_host_pages",
    lambda spark, sf: v.table(spark, sf, "pages").select(
        "page_id",
        matches.url_host(F.regexp_replace("url", "^https://", "http://")).alias("host"),
    ),
    "SELECT page_id, lower(regexp_extract(substr(regexp_replace(url, '^https://', 'http://'), 8), '^[^/?#:]*')) AS host FROM pages",
)
_hosts = " OR ".join(f"h = {q(h)} OR h LIKE {q('%.' + h)}" for h in catalog.NAMESPACE_HOSTS)
add(
    "X03_host_allow_list",
    _flagged(_HTTP, "allowed", lambda: matches.is_namespace_host(matches.url_host(F.col("text")))),
    f"{sq.with_matches(_HTTP)} SELECT doc_id, k, text, {_hosts} AS allowed "
    "FROM (SELECT *, lower(substr(text, 8)) AS h FROM matches)",
)
add(
    "X04_batch_file",
    _flagged(_EVAL, "in_batch_file", lambda: matches.is_batch_file(F.col("filename"))),
    f"{sq.with_matches(_EVAL)} SELECT doc_id, k, text, "
    "lower(filename) LIKE '%.bat' OR lower(filename) LIKE '%.cmd' AS in_batch_file FROM matches",
)
_token = q(sq.re2(catalog.BATCH_TOKEN).replace("(?iU)", "(?i)"))
add(
    "X05_batch_token",
    _flagged(_EVAL, "after_batch_word", lambda: matches.is_batch_token(F.col("before"))),
    f"{sq.with_matches(_EVAL)} SELECT doc_id, k, text, regexp_matches(before, {_token}) AS after_batch_word FROM matches",
)

# --- precedence, order, caps ------------------------------------------------------


def _findings(spark, sf, *keys, limit=None):
    return fd.explode_findings(fd.with_findings(v.corpus(spark, sf), limit), *keys)


add(
    "D01_one_secret_per_line",
    lambda spark, sf: _findings(spark, sf, "doc_id")
    .where(F.col("rule") <= catalog.LAST_SECRET_RULE)
    .select("doc_id", "line", "rule", "column", "match"),
    f"""{sq.with_findings()} SELECT doc_id, line, rule, "column", match FROM findings WHERE rule <= 5""",
)
add(
    "D02_format_yields_to_concat",
    lambda spark, sf: _findings(spark, sf, "doc_id")
    .where(F.col("rule").isin(catalog.SQL_CONCAT_RULE, catalog.SQL_FORMAT_RULE))
    .select("doc_id", "line", "rule", "column"),
    f"""{sq.with_findings()} SELECT doc_id, line, rule, "column" FROM findings WHERE rule IN (6, 7)""",
)
add(
    "D03_distinct_type_line",
    lambda spark, sf: _findings(spark, sf, "doc_id").select("doc_id", "type", "line", "column"),
    f"""{sq.with_findings()} SELECT doc_id, type, line, "column" FROM findings""",
)
_ORDER = "ORDER BY line, severity, rule"
add(
    "D04_report_order",
    lambda spark, sf: fd.with_findings(v.corpus(spark, sf))
    .select("doc_id", F.posexplode("findings").alias("pos", "f"))
    .select("doc_id", F.col("pos").alias("position"), "f.line", "f.severity", "f.type"),
    f"""{sq.with_findings()} SELECT doc_id,
  CAST(row_number() OVER (PARTITION BY doc_id {_ORDER}) - 1 AS INT) AS position, line, severity, type FROM findings""",
)
_RANKED = f"""ranked_f AS (SELECT *, row_number() OVER (PARTITION BY doc_id {_ORDER}) AS rn,
  count(*) OVER (PARTITION BY doc_id) AS n FROM findings)"""


def top_per_scan(spark, sf):
    cut = fd.with_findings(v.corpus(spark, sf), 2)
    return fd.explode_findings(cut, "doc_id", "findings_truncated").select(
        "doc_id", "findings_truncated", "line", "type"
    )


add(
    "D05_top_per_scan",
    top_per_scan,
    f"{sq.with_findings()}, {_RANKED} SELECT doc_id, n > 2 AS findings_truncated, line, type FROM ranked_f WHERE rn <= 2",
)

_PER_ENTRY, _PER_ARCHIVE = 2, 30
# Findings of scanned entries and the walk over each archive, with lowered caps.
_ARCHIVE_CTE = f"""{sq.corpus_cte().replace('corpus AS', 'plain AS', 1)},
entries AS ({v.ENTRIES_SQL.replace('FROM corpus', 'FROM plain')}),
checked AS (SELECT *, {_SAFE_SQL} AS path FROM entries),
corpus AS MATERIALIZED (SELECT doc_id, path AS filename, code FROM checked
  WHERE path IS NOT NULL AND NOT is_dir AND NOT is_binary AND size <= {catalog.MAX_ENTRY_BYTES}
    AND regexp_matches(path, '\\.(py|js|cs|env)$')),
{sq.findings_cte()}, {_RANKED},
walk AS (SELECT c.archive, c.entry_idx, c.doc_id, c.path, c.path IS NULL AS bad, s.doc_id IS NOT NULL AS scanned,
    least(coalesce(f.n, 0), @E) AS n
  FROM checked c LEFT JOIN corpus s USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM findings GROUP BY doc_id) f USING (doc_id)),
summed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY archive ORDER BY entry_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_n FROM walk),
stopped AS (SELECT *, min(entry_idx) FILTER (scanned AND before_n >= @A) OVER (PARTITION BY archive) AS stop FROM summed),
seen AS (SELECT *, CAST(greatest(0, least(n, @A - before_n)) AS INT) AS keep,
    scanned AND before_n < @A AS emitted, bool_or(bad) OVER (PARTITION BY archive) AS is_rejected
  FROM stopped WHERE stop IS NULL OR entry_idx <= stop),
totals AS (SELECT s.archive, s.is_rejected, count(*) FILTER (scanned) AS files_scanned,
    count(*) FILTER (keep > 0) AS files_with_findings, CAST(sum(keep) AS BIGINT) AS total
  FROM seen s GROUP BY 1, 2),
sev AS (SELECT s.archive, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
    count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
  FROM seen s JOIN ranked_f f ON f.doc_id = s.doc_id AND f.rn <= s.keep GROUP BY 1)
"""


def _archive_sql(select, per_entry=_PER_ENTRY, per_archive=_PER_ARCHIVE):
    return _ARCHIVE_CTE.replace("@E", str(per_entry)).replace("@A", str(per_archive)) + select


def _scanned_entries(spark, sf, **kw):
    rows = archive_scan.entry_rows(archive_scan.directories(v.archives(spark, sf)))
    return archive_scan.scan_entries(rows, **kw)


def _capped(spark, sf):
    return _scanned_entries(spark, sf, per_entry=_PER_ENTRY, per_archive=_PER_ARCHIVE)


add(
    "D06_top_per_entry",
    lambda spark, sf: fd.explode_findings(
        _scanned_entries(spark, sf, per_entry=1, per_archive=10**6), "archive", "entry_idx"
    ).select("archive", "entry_idx", "line", "type"),
    _archive_sql(
        "SELECT archive, entry_idx, line, type FROM seen JOIN ranked_f USING (doc_id) WHERE rn <= keep", 1, 10**6
    ),
)
add(
    "D07_archive_cap",
    lambda spark, sf: _capped(spark, sf).select("archive", "entry_idx", "scanned", "keep", "emitted"),
    _archive_sql("SELECT archive, entry_idx, scanned, keep, emitted FROM seen"),
)
_SEV = ", ".join(f"coalesce({s}, 0) AS {s}" for s in catalog.SEVERITIES)
add(
    "A01_scan_summary",
    lambda spark, sf: scan.scan_files(v.corpus(spark, sf)).select("doc_id", "filename", "total", "summary.*"),
    f"""{sq.with_findings()} SELECT c.doc_id, c.filename, CAST(count(f.line) AS INT) AS total,
  {", ".join(f"CAST(count(*) FILTER (severity = '{s}') AS INT) AS {s}" for s in catalog.SEVERITIES)}
FROM corpus c LEFT JOIN findings f USING (doc_id) GROUP BY 1, 2""",
)
add(
    "A02_archive_rollup",
    lambda spark, sf: en.rollup(_capped(spark, sf).where(F.col("archive_status") == en.OK)),
    _archive_sql(
        f"SELECT t.archive, files_scanned, files_with_findings, total, {_SEV} "
        "FROM totals t LEFT JOIN sev USING (archive) WHERE NOT is_rejected"
    ),
)
add(
    "A03_archive_files",
    lambda spark, sf: en.files_list(_capped(spark, sf).where(F.col("archive_status") == en.OK))
    .select("archive", F.posexplode("findings_by_file").alias("position", "f"))
    .select("archive", "position", "f.file", "f.count"),
    _archive_sql(
        "SELECT archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY entry_idx) - 1 AS INT) AS position, "
        'path AS file, keep AS "count" FROM seen WHERE emitted AND NOT is_rejected'
    ),
)
add(
    "A04_blank_scan",
    lambda spark, sf: scan.blank_document(
        admission.with_admission(v.request_bodies(spark, sf)), "doc_id"
    ).select("doc_id", "status", "file", "total", F.col("summary.critical").alias("critical")),
    "SELECT doc_id, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS file, 0 AS total, "
    "CAST(NULL AS INT) AS critical FROM documents WHERE doc_id % 10 = 4",
)
_PRODUCTION = dict(per_entry=catalog.MAX_FINDINGS_PER_ENTRY, per_archive=catalog.MAX_FINDINGS_PER_ARCHIVE)


def torn_archives(spark, sf):
    """Archives of which some have a damaged directory and some are no archives at all."""
    digit = F.left(F.md5("archive"), F.lit(1))
    damaged = F.unhex(F.replace(F.hex("content"), F.lit("504B0102"), F.lit("00000000")))
    content = F.when(digit < "4", damaged).when(digit == "f", F.encode("archive", "UTF-8")).otherwise(F.col("content"))
    return v.archives(spark, sf).withColumn("content", content)


add(
    "A06_archive_outcomes",
    lambda spark, sf: archive_scan.usage_inputs(
        archive_scan.scan_archives(torn_archives(spark, sf), with_reports=False, **_PRODUCTION)
    ).drop("size"),
    _archive_sql(
        "SELECT t.archive, CAST(total AS INT) AS total, "
        + ", ".join(f"CAST(coalesce({s}, 0) AS INT) AS {s}" for s in catalog.SEVERITIES)
        + """, 'ok' AS status FROM totals t LEFT JOIN sev USING (archive)
WHERE NOT is_rejected AND left(md5(archive), 1) >= '4' AND left(md5(archive), 1) <> 'f'
UNION ALL SELECT DISTINCT archive, 0, """
        + ", ".join("0" for _ in catalog.SEVERITIES)
        + ", 'error' FROM entries WHERE left(md5(archive), 1) < '4'",
        catalog.MAX_FINDINGS_PER_ENTRY, catalog.MAX_FINDINGS_PER_ARCHIVE,
    ),
)


def archive_reports(spark, sf):
    """Every report item of every admitted archive, through the whole plan."""
    done = archive_scan.scan_archives(v.archives(spark, sf), **_PRODUCTION).where(F.col("status") == en.OK)
    files = done.select("archive", F.explode("findings_by_file").alias("f"))
    items = files.select("archive", "f.file", "f.count", F.posexplode("f.report").alias("position", "r"))
    return items.select(
        "archive", "file", "count", "position", "r.severity", "r.severity_raw", "r.line", "r.titlu", "r.explicatie",
        "r.fix_prompt", "r.match_redactat", "r.snippet", "r.confidence",
    )


# --- reports ----------------------------------------------------------------------

_TEMPLATE_ROWS = ", ".join(
    f"({q(k)}, {', '.join(map(q, t))})" for k, t in catalog.TEMPLATES.items() if k != "weak_crypto"
)
_DEFAULTS = dict(zip(("title", "explanation", "fix_prompt"), catalog.DEFAULT_TEMPLATE))
_COALESCED = ", ".join(f"coalesce(t.{c}, {q(x)}) AS {c}" for c, x in _DEFAULTS.items())


def templated(spark, sf):
    kind = F.when(F.col("type") == "weak_crypto", "unheard_of").otherwise(F.col("type"))
    slim = _findings(spark, sf, "doc_id").select("doc_id", "line", kind.alias("type"))
    fields = {c: report.template_field(F.col("type"), i) for i, c in enumerate(_DEFAULTS)}
    return slim.withColumns(fields)


add(
    "T01_templates",
    templated,
    f"""{sq.with_findings()}, templates(type, title, explanation, fix_prompt) AS (VALUES {_TEMPLATE_ROWS})
SELECT doc_id, line, CASE WHEN f.type = 'weak_crypto' THEN 'unheard_of' ELSE f.type END AS type, {_COALESCED}
FROM findings f LEFT JOIN templates t ON t.type = f.type""",
)
add(
    "T02_severity_label",
    lambda spark, sf: _findings(spark, sf, "doc_id").select(
        "doc_id", "line", "type",
        report.severity_label(F.when(F.col("line") % 2 == 0, "odd").otherwise(F.col("severity"))).alias("label"),
    ),
    f"{sq.with_findings()} SELECT doc_id, line, type, CASE WHEN line % 2 = 0 THEN 'odd' "
    + " ".join(f"WHEN severity = {q(k)} THEN {q(x)}" for k, x in catalog.SEVERITY_LABELS.items())
    + " END AS label FROM findings",
)
_SNIPPET = """(SELECT string_agg(CASE WHEN n = f.line THEN '>' ELSE ' ' END || ' ' || CAST(n AS VARCHAR) || ': ' || ls[n], chr(10) ORDER BY n)
  FROM unnest(range(greatest(1, f.line - 2), least(len(ls), f.line + 2) + 1)) AS r(n))"""


def _report_rows(spark, sf):
    results = scan.scan_requests(v.corpus(spark, sf))
    return results.select("doc_id", F.explode("report").alias("r")).select("doc_id", "r.*")


_WITH_LINES = f"""{sq.with_findings()},
f AS (SELECT x.*, string_split(c.code, chr(10)) AS ls FROM findings x JOIN corpus c USING (doc_id))"""
add(
    "T03_snippet",
    lambda spark, sf: _report_rows(spark, sf).select("doc_id", "line", "severity_raw", "snippet"),
    f"{_WITH_LINES} SELECT doc_id, line, severity AS severity_raw, {_SNIPPET} AS snippet FROM f",
)
add(
    "T04_report_rows",
    lambda spark, sf: _report_rows(spark, sf).select(
        "doc_id", "severity", "severity_raw", "line", "titlu", "explicatie", "fix_prompt", "match_redactat", "confidence"
    ),
    f"""{sq.with_findings()}, templates(type, title, explanation, fix_prompt) AS
  (VALUES {", ".join(f"({q(k)}, {', '.join(map(q, t))})" for k, t in catalog.TEMPLATES.items())})
SELECT doc_id, CASE severity {" ".join(f"WHEN {q(k)} THEN {q(x)}" for k, x in catalog.SEVERITY_LABELS.items())} END AS severity,
  severity AS severity_raw, line, title AS titlu, explanation AS explicatie, fix_prompt, match AS match_redactat, confidence
FROM findings f JOIN templates t USING (type)""",
)

_TEMPLATES = f"""templates(type, title, explanation, fix_prompt) AS
  (VALUES {", ".join(f"({q(k)}, {', '.join(map(q, t))})" for k, t in catalog.TEMPLATES.items())})"""
_LABEL = f"""CASE severity {" ".join(f"WHEN {q(k)} THEN {q(x)}" for k, x in catalog.SEVERITY_LABELS.items())} END"""
add(
    "A03_archive_reports",
    archive_reports,
    _archive_sql(
        f""", {_TEMPLATES}, shown AS (SELECT s.archive, s.path, s.keep, r.*, string_split(c.code, chr(10)) AS ls
  FROM seen s JOIN ranked_f r USING (doc_id) JOIN corpus c USING (doc_id) WHERE emitted AND NOT is_rejected AND r.rn <= s.keep)
SELECT archive, path AS file, keep AS "count", CAST(rn - 1 AS INT) AS position, {_LABEL} AS severity, severity AS severity_raw,
  line, title AS titlu, explanation AS explicatie, fix_prompt, match AS match_redactat, {_SNIPPET} AS snippet, confidence
FROM shown f JOIN templates t USING (type)""",
        catalog.MAX_FINDINGS_PER_ENTRY, catalog.MAX_FINDINGS_PER_ARCHIVE,
    ),
)

# --- whole scans ------------------------------------------------------------------


def _raw_scan(table, key, text, filename, planted=False):
    """The text of a table as it is, or with a line of code that its key picks behind it."""
    n = len(v.FRAGMENTS)

    def run(spark, sf):
        code = F.concat(F.col(text), F.lit("\n"), v._pick(v.FRAGMENTS, F.col(key) % n)) if planted else F.col(text)
        files = v.table(spark, sf, table).select(
            F.col(key).alias("doc_id"), F.lit(filename).alias("filename"), code.alias("code")
        )
        return fd.explode_findings(fd.with_findings(files), "doc_id").select(
            "doc_id", "line", "column", "type", "severity", "match"
        )

    code_sql = f"{text} || chr(10) || {v._sql_pick(v.FRAGMENTS, f'{key} % {n}')}" if planted else text
    sql = f"""WITH corpus AS MATERIALIZED (SELECT {key} AS doc_id, {q(filename)} AS filename, {code_sql} AS code FROM {table}),
{sq.findings_cte()} SELECT doc_id, line, "column", type, severity, match FROM findings"""
    return run, sql


add("scan_documents", *_raw_scan("documents", "doc_id", "text", "a.txt"))
add("scan_page_urls", *_raw_scan("pages", "page_id", "url", "a.txt"))
add("scan_pages", *_raw_scan("pages", "page_id", "html", "a.html", planted=True))
add(
    "scan_corpus",
    lambda spark, sf: _findings(spark, sf, "doc_id", "filename").select(
        "doc_id", "filename", "line", "column", "type", "severity", "match", "confidence"
    ),
    f'{sq.with_findings()} SELECT doc_id, filename, line, "column", type, severity, match, confidence FROM findings',
)
