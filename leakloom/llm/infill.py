"""Fill-in-the-middle: texts cut into prefix, middle and suffix by one match of a per-row pattern.

A text's units are words with the blanks before them, and blanks at its end. regexp_count
gives their number n. Two draws from the document's id give the ends a <= b of prefix and
middle, and the row's own pattern unit{a} unit{b - a} rest captures all three in one match.
The counted groups are possessive: nothing is given back, so matching takes time in
proportion to the text and no stack, however long the text is.

All of it is SQL expressions within the row: no shuffle, no Python.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from leakloom.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = rf"(?:{common.BLANK}*+{common.WORD}+|{common.BLANK}++)"


class Settings(NamedTuple):
    seed: str = "42"
    changed: int = 50  # of 100 documents
    suffix_first: int = 80  # of 100 changed ones: suffix, prefix, middle; else prefix, suffix, middle


def draws(key: Column, seed: str) -> list[Column]:
    """Four 32-bit numbers from the digest of seed and key; a null key counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def parts(text: Column, a: Column, b: Column) -> Column:
    """The first a units, those up to the b-th, and the rest, as an array; text holds no MIDDLE."""
    count = lambda x: F.concat(F.lit(f"({UNIT}{{"), x.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), count(a), count(b - a), F.lit(r"(.*+)\z"))
    return F.split(F.regexp_replace(text, pattern, F.lit(f"$1{MIDDLE}$2{MIDDLE}$3")), MIDDLE, -1)


def joined(text: Column, form: Column, cut: Column) -> Column:
    """The output of a form for the parts of a text."""
    p, m, s = (cut[i] for i in range(3))
    return (
        F.when(form == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
        .when(form == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
        .otherwise(text)
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Changed texts hold no mark, so the first of each kind is the one put in."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc (the columns of docs), n, form, prefix, middle, suffix and output of each row.

    form is psm, spm or plain: texts that are null (as empty), empty or hold one of the
    marks stay plain, and so do the documents that the draws leave alone; plain rows have
    null parts and their text as output. Repeated ids have the same draws (null is an id);
    equal rows give equal results; very long texts are matched whole; an empty table gives
    no rows; columns of docs only appear inside doc, whatever their names.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(f"doc.{key}"), s.seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= s.changed)
    form = F.when(plain, "plain").when(h4 % 100 < s.suffix_first, "spm").otherwise("psm")
    rows = docs.select(F.struct("*").alias("doc"), body.alias("text"), F.regexp_count(body, F.lit(UNIT)).cast("long").alias("n"))
    rows = rows.select("doc", "text", "n", form.alias("form"), (h1 % (F.col("n") + 1)).alias("x"), (h2 % (F.col("n") + 1)).alias("y"))
    cut = F.when(F.col("form") != "plain", parts(F.col("text"), F.least("x", "y"), F.greatest("x", "y")))
    rows = rows.select("doc", "text", "n", "form", cut.alias("cut"))
    named = [F.col("cut")[i].alias(name) for i, name in enumerate(("prefix", "middle", "suffix"))]
    return rows.select("doc", "n", "form", *named, joined(F.col("text"), F.col("form"), F.col("cut")).alias("output"))
