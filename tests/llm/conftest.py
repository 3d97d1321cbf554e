import pytest

#: Rows that every operator must take: nulls, empty, blank, long, repeated and non-ASCII texts; extra columns with names that operators use.
LONG = "Zeta of the word " * 6000
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six seven eight nine ten."), (5, "ONE two three four five six seven eight nine ten."),
    (5, "ONE two three four five six seven eight nine ten."), (6, "été 日本語 🙂 naïve İstanbul ſ K"), (7, LONG), (8, LONG.lower()), (9, "x" * 5000), (None, "no id"), (10, "a b"), (11, ""),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "src0", len(t or ""), "own", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, fp int").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
