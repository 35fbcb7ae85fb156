from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
    para = " ".join(f"tok{i}" for i in range(80))
    rows = [(1, para, "en", "a"), (2, para, "en", "a"), (2, para, "en", "a"), (3, None, None, None), (4, "", "de", "b"),
            (None, para, "en", "a"), (5, long, "fr", "b"), (6, "two words", "en", None), (7, "two words", "en", "c"),
            (8, para + " one more word here", "en", "b"), (9, " \t\n ", "en", "a"), (10, "x\n" * 60, "en", "a"),
            (11, "é ü 日本 #$% <|endoftext|> I'M\n\nReleased under the MIT License.", "es", "c"), (None, None, None, None)]
    return spark.createDataFrame([r + (0, "s", 1, True) for r in rows],
                                 "doc_id long, text string, lang string, source string, size int, score string, row int, listed boolean")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, None), (99, 1, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))
