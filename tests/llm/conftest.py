import pytest

ODD = [
    (1, "The cat sat on the mat and the dog was in the house with a ball of red wool for the day."),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b "),
    (5, "one"),
    (6, "x" * 50_000),
    (7, "the quick brown fox " * 10_000),
    (8, "Ünï çödé ΑΣ İstanbul é ́mark <|endoftext|> it's 'll #1 | $2!!\n\n" * 30),
    (9, "same words in this row"),
    (9, "same words in this row"),
    (9, "another text under an id that is taken"),
    (None, "a row without any id"),
    (None, None),
    (-5, "negative ids are ids too \U0001F600 and so on\r\nnext line"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and extra columns whose names operators use inside."""
    rows = [(i, t, "en", "src", None if t is None else len(t), 1, 2, 3, 4, "k") for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, y int, fp long, kept_id long, "
              "example long, rank string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (5, 0, 0), (None, 1, 1), (9, None, None), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
