import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tableprep.llm.base import ship_package
    ship_package(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns that clash with the operators' own names."""
    prose = "The cat of the house sat on a mat and the dog of the yard ran to it while the sun was low."
    rows = [
        (1, prose, "en", "s1"), (2, prose, "en", None), (3, prose + " Then it slept.", "en", "s1"),
        (4, None, "en", "s2"), (5, "", None, "s2"), (6, " \n\t ", "de", "s2"), (7, "word", "de", None),
        (8, "a much shared line here\nonly mine\n\na much shared line here", "en", "s1"),
        (9, "  A MUCH shared line here \nother", "en", "s1"), (9, "  A MUCH shared line here \nother", "en", "s1"),
        (None, "no id but a much shared line here", "en", "s3"), (None, None, None, None),
        (10, "w" * 50_000 + " " + "long words " * 20_000, "en", "s1"), (-3, "\U0001f600 été \x85 straße <|endoftext|>", "fr", "é"),
        (11, "+" * 5000 + "1" * 5000 + "@" * 5000, "en", "s1"),
    ]
    schema = ("doc_id long, text string, lang string, source string, key long, salt int, SALTS int, n long, row long, "
              "label string, start long")
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "x", 6) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
