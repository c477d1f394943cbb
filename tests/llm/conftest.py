import pytest

WORDS = "the of and une la thing under wander maison idiot keep, alpha beta gamma delta Über".split()


def text(n: int, seed: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * 3 + i // 5) % len(WORDS)] for i in range(n))


#: doc_id, text: null, empty, blank, short, long, copies, repeated rows, a null id, characters of several bytes.
ODD = [
    (5, None), (3, ""), (4, " \t\n "), (1, "a"), (2, "ab cd"), (7, text(60, 1)), (8, text(60, 1)), (9, text(60, 1) + " tail"), (9, text(60, 1) + " tail"),
    (20, "é" * 70 + "𝄞" * 30), (21, "x " + "é" * 70 + "𝄞" * 30), (30, text(4000, 2)), (31, "  two  spaces \n\n here "), (None, text(40, 3)), (None, None), (40, "<|endoftext|> is a text"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of every odd kind, with extra columns whose names clash with those used inside."""
    rows = [(i, t, "en" if n % 2 else None, "s1" if n % 3 else None, 0, n, "x", 1) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block int, range string, key int")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
