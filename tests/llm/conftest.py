import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text[, lang[, source]]) tuples; clash adds columns with awkward names."""

    def make(rows, clash=False):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for c in ("kept", "digest", "id", "h", "key", "component", "text_sha256", "size", "start"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
