import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank, very long and repeated texts, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the deep dark forest near the old mill " * 3
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n", "en", None, 3), (4, "one", "en", "a", 3), (5, long, "en", "a", len(long)), (6, plain, "en", "a", 1),
            (7, plain, "en", "a", 1), (7, plain, "en", "a", 1), (8, "Zwei Wörter", "de", "b", 11), (None, plain, "en", "a", 1), (10, " ".join(f"unlike{k}" for k in range(80)), "en", "a", 1),
            (-9, "née “quoted” 日本 語 🙂", "fr", "c", 5)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"{SCHEMA}, n long, score long, component_id long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    """A few hundred given documents with near copies of some, and their labels."""
    from conftest import SMALL

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = [tuple(r) for r in docs.collect()]
    near = []
    for k, row in enumerate([r for r in rows if len(r[1]) > 600][:12]):
        words = row[1].split(" ")
        for j in range(3):
            edited = list(words)
            edited[(7 * k + 11 * j) % len(words)] = f"changed{j}"
            near.append((10_000 + 10 * k + j, " ".join(edited), *row[2:]))
    return spark.createDataFrame(rows + near, docs.schema), labels
