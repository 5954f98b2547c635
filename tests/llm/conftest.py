import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def make(spark):
    """A documents table of texts, with ids in order and a column whose name clashes with ones that operators use."""

    def of(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1.5) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOCS + ", spans string, score double").repartition(2)

    return of
