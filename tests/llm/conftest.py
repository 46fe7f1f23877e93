import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, line string, rank int, id long, c string"


@pytest.fixture
def docs(spark):
    """Documents with columns whose names operators use themselves."""

    def make(*texts, ids=None, sources=None):
        rows = [((ids or range(len(texts)))[i], t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "fp", "key", "line", 1, 2, "c") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def rows_of():
    def collect(df, key="doc_id"):
        return {r[key]: r for r in df.orderBy(F.col(key)).collect()}

    return collect
