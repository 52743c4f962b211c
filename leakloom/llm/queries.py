"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leakloom.llm import alignment, common, covertree, infill, licenses, lines, mixing, neighbours, packing, quality, rules, sharding, simhash, urls

#: File name of the vocabulary below the folder of the installed public tokenizers.
VOCABULARY = "byte_bpe_50k.json"
#: The other vocabulary that texts are aligned with.
PIECES = "piece_bpe_32k.model"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the key law, and where they lie with one more."""
    placed = sharding.assign(
        common.table(spark, sf_dir, "documents"), sharding.layout(24), sharding.layout(25)
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, vocabulary(), end_id=1, window=2048)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; id 1 closes a document."""
    return packed(common.table(spark, sf_dir, "documents"))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of the licence templates in whole documents."""
    return licenses.scan(common.table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 or more code points that three or more documents share, kept in the last one."""
    done = lines.dedup(common.table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return done.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


# A document is a row, as in the operator, also where rows share an id.
ORACLES["op4_line_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT row, doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT row, doc_id, string_split(text, chr(10)) AS l FROM docs))),
shared AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key
           HAVING count(DISTINCT row) >= 3),
marked AS (SELECT l.*, s.key IS NOT NULL AND l.doc_id IS DISTINCT FROM s.keeper AS dropped FROM lines l LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and quality of the labelled rows that a model may learn from; the others are held out."""
    known = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return known.where(~held_out(F.col("doc_id")))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a quarter of the ids is held out from fitting."""
    docs = common.table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality_labels(spark, sf_dir))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, else by trees that were trained on the URLs the rules judge."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    ruled = urls.judged(urls.parsed(pages), urls.RULES).select(F.col("_url").alias("url"), F.col("ruled").alias("label"))
    found = urls.fit(ruled.where("label IS NOT NULL")).apply(pages)
    return found.select("doc.page_id", "host", "path", "rule", "verdict", "score")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and draw of every document, raked to flattened shares of sources, languages and topics."""
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc.doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept"
    )


ORACLES["op7_mixing"] = mixing.oracle()


@query
def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base limits and robust outliers of every document."""
    return rules.judge(common.table(spark, sf_dir, "documents"))


@query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others, by inner product."""
    rows = common.table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


@query
def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-the-middle form, and the text rebuilt from that."""
    cut = infill.transform(common.table(spark, sf_dir, "documents"))
    back = cut.withColumn("restored", infill.restored(F.col("output"), F.col("form")))
    return back.select(
        "doc.doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


# Texts are cut as lists of units; the restored text is the text, which the digest of what was rebuilt has to equal.
ORACLES["op12_infill"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, u, len(u) AS n, h1 % (len(u) + 1) AS x, h2 % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') AS p,
  array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups of two vocabularies in every document, and its links by the corpus-wide numbers of their pairs."""
    return alignment.aligned(common.table(spark, sf_dir, "documents"), vocabulary(), vocabulary(PIECES))


@query
def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all vectors with a cosine of 0.9 or more."""
    found = covertree.linked(common.table(spark, sf_dir, "embeddings"), 0.9)
    return found.select("doc.vec_id", "n_links", "component_id", "kept")
