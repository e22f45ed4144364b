from __future__ import annotations

import pytest
from llm.brute import prose
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, body string, "
    "kept boolean, mix string, row long, node long, `digest.x` string"
)


def edge_texts() -> list[tuple]:
    """(doc_id, text): NULLs, empty and very long texts, ties, repeated rows, clashing needs."""
    a, passage, long = prose(1, 60), prose(2, 50), prose(3, 30_000)
    halves = long[: len(long) // 2].rstrip() + " " + passage + " " + long[len(long) // 2 :].lstrip()
    return [
        (7, a),
        (3, a.replace(" ", " \t\n")),
        (12, a.upper()),
        (5, a.rsplit(" ", 4)[0] + " other tail of the text"),
        (4, None),
        (8, None),
        (9, ""),
        (10, " \t\r\n"),
        (20, halves),
        (21, prose(4, 80) + "\n" + passage + "\n" + prose(5, 80)),
        (22, "la " * 400),
        (23, "x y z " * 40 + prose(6, 40)),
        (24, prose(7, 45)),
        (24, prose(7, 45)),
        (30, "three short words"),
        (31, "three short words"),
        (32, "é ß 漢字     end\u0085line 🙂"),
        (33, "12345 67890 !!! ###"),
        (34, "same line here\nsame line here\n\n \nsame line here " + prose(8, 30)),
        (-5, prose(9, 34)),
        (-6, prose(9, 34)),
        (40, prose(10, 35)),
        (41, prose(10, 35)),
    ]


@pytest.fixture(scope="session")
def edge_rows():
    return edge_texts()


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en" if (i or 0) % 2 else None, None if i == 20 else "s", None, "b", True, "m", 1, 2, "d")
         for i, t in rows],
        SCHEMA,
    )


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return frame(spark, edge_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def null_id_docs(spark):
    """Rows without doc_id beside others."""
    a = prose(1, 60)
    return [(None, a), (None, a), (None, prose(77, 50)), (2, a), (None, None)]


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, []).select("*")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def as_frame(spark):
    return lambda rows: frame(spark, rows)


__all__ = ["F"]
