from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd_docs(spark):
    """Null, empty, blank, repeated and long texts, a null id, and columns named like the operators' own."""
    long_text = "\n".join(f"line number {i} of the very long text" for i in range(20_000))
    rows = [(1, "the cat sat on the mat and the dog ran to it"), (2, None), (3, ""), (4, " \n\t "), (5, long_text), (1, "the cat sat on the mat and the dog ran to it"),
            (None, "no id but a text of the usual kind"), (7, "one two"), (8, "naïve Σας\x00 \x1c 漢字 😀 <|endoftext|> it's")]
    names = ["ids", "n_lines", "n_dropped", "class_id", "quality_score", "sequence_id", "doc", "rest", "which", "h", "text_a", "Drop"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], schema)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
