import pytest

from casepipe.session import ship

#: Rows that every text operator must survive: null and empty texts, blanks
#: only, repeats, ties, a text without letters, non-ASCII and a long one.
LONG = "\n".join(" ".join(f"w{(i * 7919 + j * 104729) % 65537}" for j in range(40)) for i in range(1200))
TEXTS = [None, "", " \t\n ", "a", "a", "Alpha beta.", "!!! 123 ---", "Éa ñ 中文 😀 don't 's", "\x1c \x85 x", LONG, LONG + " end"]


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(shipped):
    """Odd texts under increasing ids, one row without id, one row twice, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", 0, 0, "x") for i, t in enumerate(TEXTS)]
    rows += [(None, "orphan text", "en", 0, 0, "x"), (3, "a", "en", 0, 0, "x")]
    return shipped.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, doc int, digest string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def sample_docs(shipped):
    return shipped.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(shipped):
    return shipped.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
