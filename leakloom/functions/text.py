"""Text expressions. Positions and lengths are Unicode code points throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakloom.functions.catalog import WS_CLASS

# The characters Unicode-aware stripping removes (fixed values).
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Letters outside ASCII that a case-insensitive match equates with s, i, i, k.
FOLDING_LETTERS = "\u017f\u0131\u0130\u212a"
FOLDED_TO = "siik"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column so that no later step makes Spark compute it again.

    Spark pushes filters below projections by repeating the projected expression, and an
    explode implies such a filter. It never pushes a filter on generated rows, while
    filters on the other columns still pass through to the reader.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def has_any(text: Column, needles) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def folded(text: Column) -> Column:
    """Lower-case text in which every literal of a case-insensitive rule can be found.

    The literals are ASCII, so other letters become blanks: Spark folds plain ASCII byte by byte,
    and any other text letter by letter.
    """
    plain = F.when(
        has_any(text, FOLDING_LETTERS), F.translate(text, FOLDING_LETTERS, FOLDED_TO)
    ).otherwise(text)
    return F.lower(F.regexp_replace(plain, r"[^\x00-\x7F]+", " "))


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(rf"(?U)[^{WS_CLASS}]"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP_CHARS))


def redact(match: Column) -> Column:
    """Hide the middle of a match; at most twelve characters show two at each end."""
    return let(
        strip(match),
        lambda t: F.when(F.length(t) <= 4, F.lit("***"))
        .when(F.length(t) <= 12, F.concat(F.left(t, F.lit(2)), F.lit("***"), F.right(t, F.lit(2))))
        .otherwise(F.concat(F.left(t, F.lit(4)), F.lit("..."), F.right(t, F.lit(4)))),
    )


def decode_utf8(content: Column) -> Column:
    """Bytes to text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def snippet(lines: Column, line: Column, context: int = 2) -> Column:
    """Numbered lines around ``line``, the hit itself marked with '>'."""
    first = F.greatest(F.lit(1), line - context)
    return F.array_join(
        F.transform(
            F.slice(lines, first, F.greatest(F.lit(0), line + context + 1 - first)),
            lambda text, i: F.concat(
                F.when(i + first == line, F.lit(">")).otherwise(F.lit(" ")),
                F.lit(" "),
                (i + first).cast("string"),
                F.lit(": "),
                text,
            ),
        ),
        "\n",
    )


def running_totals(values: Column, block: int = 256) -> Column:
    """Inclusive prefix sums of an array<bigint>.

    Arrays are immutable, so appending n times costs n copies. Summing inside blocks
    of fixed length and then over the block totals keeps that cost near linear.
    """

    def prefix(arr):
        return F.aggregate(
            arr,
            F.array().cast("array<bigint>"),
            lambda acc, x: F.array_append(
                acc, x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint"))
            ),
        )

    def with_blocks(v):
        starts = F.sequence(F.lit(1), F.size(v), F.lit(block))
        inner = F.transform(starts, lambda s: prefix(F.slice(v, s, F.lit(block))))
        return let(
            inner,
            lambda rows: let(
                prefix(F.transform(rows, lambda r: F.element_at(r, -1))),
                lambda ends: F.flatten(
                    F.transform(
                        rows,
                        lambda r, i: F.transform(
                            r,
                            lambda x: x
                            + F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, i - 1)),
                        ),
                    )
                ),
            ),
        )

    empty = F.array().cast("array<bigint>")
    return let(values, lambda v: F.when(F.size(v) == 0, empty).otherwise(with_blocks(v)))
