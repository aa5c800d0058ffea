import pytest

#: Texts with every awkward case: null, empty, white space, ties, repeats, very long.
AWKWARD = [
    (1, None, "s1"),
    (2, "", None),
    (3, " \t\n ", "s1"),
    (4, "one two three four five six seven", "s2"),
    (5, "one two three four five six seven", "s2"),
    (6, "ONE two three\nfour five\n\nsix seven", None),
    (7, "word", "s3"),
    (8, "é😀 ü " * 50, "s3"),
    (9, "alpha beta gamma delta " * 3000, "s1"),
    (10, "unbroken" * 4000, "s2"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """The table, with columns whose names clash with those that operators use."""
    schema = "doc_id bigint, text string, source string, size string, bucket int, digest string, pass int, start string"
    rows = [(i, t, s, "x", 1, "d", 2, "y") for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
