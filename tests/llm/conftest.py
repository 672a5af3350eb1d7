from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, source) rows, with columns beside them whose names operators use inside."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENT)
        if extra:
            for name in ("copy_no", "part", "kind", "keep", "token", "cluster", "score", "digest", "p_quality"):
                frame = frame.withColumn(name, frame["lang"])
        return frame

    return make
