import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text[, source[, lang]]) to a documents table with a clashing extra column."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for clash in ("size", "key", "part", "copies", "fingerprint", "start", "score", "node", "__id", "__hash", "__copies", "__rows", "__place", "__own", "__bytes", "rest", "spans"):
                df = df.withColumn(clash, F.lit("clash"))
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"
