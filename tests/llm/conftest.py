import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"

#: Nulls, empty and very long texts, repeated rows, ties, and characters of all widths.
EDGE = [
    (1, "The cat sat on the mat. " * 20, "en"),
    (2, "", "en"),
    (3, None, "en"),
    (4, "   \n\t ", None),
    (5, "12345 !!! ???", None),
    (6, "le chat noir et la souris dans la maison bleue " * 15, "fr"),
    (7, "日本語のテキスト 😀 naïve coöperation", None),
    (7, "日本語のテキスト 😀 naïve coöperation", None),
    (8, "word " * 60_000, "en"),
    (9, "x" * 30_000, None),
    (None, "no id here but some words anyway", "en"),
    (10, "a\x85b　c d\x1ce\x0bf", None),
    (11, "The cat sat on the mat. " * 20, "en"),
    (12, "  two  spaces   and\r\n\r\nlines ", "en"),
    (13, "<|endoftext|> x<|endoftext|>y.", "en"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with every odd case, and extra columns whose names clash with those the operators make."""
    rows = [(i, t, lang, "src", len(t or ""), 1, "z", 2.0) for i, t, lang in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans string, score double")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
