import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls anywhere, empty and very long texts, ties, repeated rows, and columns whose names operators use."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (4, long), (None, "no id here"), (None, None), (5, "one"), (5, "two"), (6, "x" * 50_000), (7, "é 漢字 \x00 🙂"), (8, long + " tail"), (9, "one")]
    frame = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS)
    clashing = ("id", "tkey", "fp", "n", "key", "anchor", "digest", "copied", "spans", "kept", "n_words", "n_tokens", "sequence_id", "component_id", "_bytes", "row", "segs", "u", "v")
    return frame.selectExpr("*", *[f"'clash' AS {c}" for c in clashing])


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
