from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from odd_rows import ROWS, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame([(*r, 0.5, "k", "l", "s") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None), (9, None, None)], "doc_id long, quality int, toxic int")
