
import pytest


#: Extra columns, named like what the operators use inside or return.
CLASHES = "kept string, row long, own long, fp long, rest string, tokens string, topic string, place string, h1 long, part int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SHARED = "This line is in many documents of the table."


def edge_rows():
    """Null ids, texts and classes, empty, blank and very long texts, ties and repeated rows."""
    texts = [
        (None, SHARED + "\nfirst text without an id"), (None, SHARED + "\nfirst text without an id"), (None, None),
        (1, None), (2, ""), (3, " \t\n \r"), (4, "\n\n\n"), (5, LONG), (6, "One"), (7, "one two"), (8, "One two three"),
        (9, SHARED + "\nown words of nine"), (9, SHARED + "\nown words of nine"), (9, SHARED.upper() + "\nother nine"),
        (10, "  " + SHARED + " \nown words of ten\n" + SHARED), (11, "own words of ten\néè \U0001f600 中文 ### |"),
        (12, "same text " * 30), (13, "same text " * 30), (-5, "same text " * 30), (2**60, "<|endoftext|> it's\r\na\x00b"),
    ]
    out = []
    for i, (doc, text) in enumerate(texts):
        lang, source = (None, None) if i % 5 == 0 else ("en", f"src{i % 2}")
        out.append((doc, text, lang, source, None, "kept", i, None, 1, "x", "y", None, "z", 5, 6))
    return out


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
