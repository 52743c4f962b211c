"""From raw documents to packed training sequences, in five written stages.

Every stage works on all rows that the one before left, and its result is a Parquet table
in the shared folder, which the next one reads. The last table holds what a model is trained on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from leakloom.llm import common, lines, mixing, packing, quality, queries, simhash

#: No SQL states a trained classifier; the tests compare each stage with a plain version.
ORACLE_SQL = None

LEAST_QUALITY = 0.7
WINDOW = 2048


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of LEAST_QUALITY or more stay."""
    model = quality.fit(docs, queries.quality_labels(spark, sf_dir))
    good = docs.select(F.struct("*").alias("doc"), quality.score(model, F.col("text")).alias("score"))
    return good.where(F.col("score") >= LEAST_QUALITY).select("doc.*")


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that three or more documents share, except in the last of them."""
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    done = lines.dedup(docs)
    return done.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics get their target shares of tokens."""
    return mixing.mix(docs).where("kept").select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Padded sequences of 2048 token ids, with the pieces of documents that they hold."""
    return packing.sequences(packing.pack(docs, queries.vocabulary(), end_id=1, window=WINDOW), WINDOW)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("duplicates", duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents; null and empty texts, repeated rows and empty tables as each operator says.

    Every stage's result stays in `folder` (a new one in the shared folder, if not given) and its
    work tables go. A run that is given the folder of one that died goes on after the last
    stage that was finished there; documents, labels and parameters have to be the same.
    """
    folder = folder or common.work_path(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        if not _there(spark, f"{path}.done"):
            with common.scratch(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(path)
            spark.range(1).write.mode("overwrite").parquet(f"{path}.done")
        docs = spark.read.parquet(path)
    return docs


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("id long").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True
