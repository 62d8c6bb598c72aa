import pytest

from odd_rows import ODD


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, 7, 0.5, "word", 1) for r in ODD]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, size int, position double, word string, hash int").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (6, None, None), (None, 1, 1), (7, 1, 0), (7, 0, 1)],
                                 "doc_id bigint, quality int, toxic int")
