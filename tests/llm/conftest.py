import pytest

ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "a",
    "Straße 東京 😀 don't we'LL 've 12x3   \n\n end \r\n",
    "same words here " * 30,
    "same words here " * 30,
    "ab" * 30_000,
    "'s 's''t   x\x1cy\x00z",
    "x" * 70 + " " + "y " * 500,
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, repeated ids, and columns named like the operators' own."""
    rows = [(i if i != 3 else None, text, "en" if i % 2 else None, "s", 1, "id", [1]) for i, text in enumerate(ODD_TEXTS)]
    rows += [rows[5], (5, "another text of the same id", None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, ids array<int>"
    return spark.createDataFrame(rows, kind)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def documents(spark, root):
    return spark.read.parquet(f"{root}/documents.parquet")
