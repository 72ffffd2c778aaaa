import pytest

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", None, "b"), (5, "Same text here twice over", "en", "a"),
        (5, "Same text here twice over", "en", "a"), (None, "no id at all in this row", "en", None), (6, long, "fr", "b"), (7, long, "fr", "b"),
        (8, "é😀 mail a.b+c@x-y.co.uk_d@e.f now. 1.2.3.4.5.6.7.8 256.1.1.1 +1 (183) 555-1276 4111 1111 1111 1111 4111-1111-1111-1112 a@b a@b. ++12345678 9", "de", "c"),
        (9, "12 3456 789012345678901234567890 0000000000000000 007.1.1.1 1.2.3.+49 30 1234567.", "de", "c"),
        (10, "call phone 212-555-1234 my ssn 123-45-6789 IBAN GB82 WEST 1234 5698 7654 32 bad GB82 WEST 1234 5698 7654 33", "en", "c"),
        (11, "a\n a\na\nb\n\n\nb", "en", "d"), (12, "x y z " * 30, "en", "d"), (13, "word" * 3_000, "en", "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 AS n_words", "'z' AS h", "2 AS prefix", "3 AS key", "doc_id AS bytes", "'q' AS size", "1 AS score", "0 AS stratum")
