import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, t string, score double, id bigint, block int"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names operators use inside."""

    def build(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", 0.5, 7, 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build
