"""Small tables with everything a corpus may throw at an operator."""

from __future__ import annotations

import pytest

#: Extra columns are named like columns that the operators use or make.
CLASHING = ("_doc", "_text", "_row", "_digest", "_key", "_n", "_hit", "_quality", "fp", "size", "target", "block", "part", "score", "keep", "item", "kind")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)

PLAIN = "The river of the north was wide and the people there told that it had a name with seven letters."
LONG = " ".join(f"word{i % 977} of line{i % 31}" for i in range(60_000))
RAW = [
    (1, PLAIN, "en", "a"),
    (2, PLAIN, "en", "b"),
    (3, PLAIN.upper(), "en", "b"),
    (3, PLAIN.upper(), "en", "b"),  # a row twice
    (4, None, "de", "a"),
    (5, "", None, None),
    (6, "  \n\t ", "fr", None),
    (None, "no id here at all", "en", "a"),
    (7, "one", "en", "c"),
    (8, LONG, "en", "c"),
    (9, "Ärger über 你好 \U0001f600  zwei  Leer zeichen ", "de", "\U0001f600"),
    (10, "mail a.b@c-d.example.org or +49 (30) 123-4567, host 10.0.0.255, card 4111 1111 1111 1111.", "en", "c"),
]


def rows():
    return [(i, t, lang, s, None if t is None else len(t), *(["x"] * len(CLASHING))) for i, t, lang, s in RAW]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    items = [
        (1, "seven letters of the north was wide and the people there told that"),
        (2, "one"),
        (3, None),
        (4, ""),
        (None, "no id here at all"),
        (5, "the People there told that it had a name with seven letters and more"),
        (5, "the People there told that it had a name with seven letters and more"),
    ]
    return spark.createDataFrame(items, "item_id long, text string")


def documents(sf: str):
    """Rows doc_id, text of a given documents table, read without Spark."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang", "source"])
    return sorted(zip(*(t[c].to_pylist() for c in t.column_names), strict=True))
