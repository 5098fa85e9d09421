import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest  # noqa: E402
from llm_helpers import SCHEMA, prose, rows  # noqa: E402

@pytest.fixture(scope="session")
def edge_texts():
    base = prose(1, 40)
    return [
        None, "", " \t\n ", "one", "two words", base, base, base + " tail", prose(2, 3000), "\n\n\n", "A line that repeats\nx\nA line that repeats\n  a LINE that repeats  ",
        "x " * 50, "Released under the MIT License. CC BY NC cc by nc", "é ü ß 日本 😀 " * 5, "caps\r\nlines\x0bhere\x0c", base.upper(),
    ]


@pytest.fixture(scope="session")
def edge_rows(edge_texts):
    r = rows(edge_texts)
    return [*r, r[5], r[5], (None, "A line that repeats", "en", "s", 1, "r", "w", "x", "f", "i"), (3, "another text of id 3\nA line that repeats", "en", "s", 1, "r", "w", "x", "f", "i")]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

