import pytest

#: Names that the operators use inside, as extra columns of their inputs.
CLASHES = (
    "node component key hub size n fp norm group_size keep_id lists hashes shard score predicted copies finish target unit "
    "sketch first doc repeat before taken"
).split()
LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(30_000))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]), with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), *CLASHES) for r in rows]
        extra = ", ".join(f"`{c}` string" for c in CLASHES)
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [
        (1, "a b c d e f g h i j k l m n o", "s1"), (2, "a  b\tc d e f g h i j k l m n o", "s1"), (3, None, None),
        (4, "", "s2"), (5, " \t\n", "s2"), (6, "x y", None), (6, "x y", None), (None, "x y", "s1"), (None, None, None),
        (7, LONG, "s2"), (8, LONG + " end", "s2"), (9, "A B C d e f g h i j k l m n o", "s1"), (10, "z" * 50_000, "s3"),
        (11, "é ü ß </s> <|turn|> \\ 你好", "s3"), (11, "another text of the same id", "s3"),
    ]


@pytest.fixture(scope="session")
def sample_texts():
    """(doc_id, text) of the smallest given table, in order."""
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    return duckdb.sql(f"SELECT doc_id, text FROM '{path}' ORDER BY doc_id").fetchall()
