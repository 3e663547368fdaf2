import os

import pytest

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def raw(data):
    """(doc_id, text, source, lang) of all documents, as Python sees them."""
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{data}/documents.parquet'").fetchall()


LONG = "lorem ipsum dolor " * 120_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, columns whose names clash with our own."""
    rows = [
        (1, "The same text\nwith a line that is long enough", "en", "a", 0),
        (2, "THE SAME text\nwith a line that is long enough", "en", "a", None),
        (2, "THE SAME text\nwith a line that is long enough", "en", "a", None),
        (3, None, None, None, 1),
        (4, "", "de", None, 2),
        (5, " \n\t\n", "de", "b", 2),
        (6, LONG, "en", "b", 3),
        (7, "über straße ñandú éàè 😀 <|endoftext|> end", "de", "c", 3),
        (None, "no id here, with a line that is long enough", None, "c", 4),
        (None, None, None, None, None),
        (8, "   with a LINE that is long enough \nother", "fr", "c", 4),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, __h int").withColumnRenamed("__h", "h").cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
