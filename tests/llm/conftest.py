import llm_brute
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{llm_brute.SF}/documents.parquet").cache()


@pytest.fixture()
def docs(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) tuples."""

    def make(*rows, extra=()):
        full = [(*(r + (None,) * 4)[:4], len(r[1]) if len(r) > 1 and r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS).selectExpr("*", *extra)

    return make
