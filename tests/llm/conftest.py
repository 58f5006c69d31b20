from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, _kept string, length int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and texts, empty and very long texts, repeated rows, ties, and extra columns with likely names."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en"),
        (2, "one two three four five six seven eight nine ten eleven twelve", None),
        (3, None, "en"),
        (4, "", "en"),
        (5, "  \n\t ", "en"),
        (None, "no id at all here but some words to link by anyhow today", "en"),
        (None, "no id at all here but some words to link by anyhow today", "en"),
        (6, long, "en"),
        (7, "solo", "en"),
        (7, "solo", "en"),
        (8, "naïve ça été über größe 　 full width​x", "fr"),
    ]
    return spark.createDataFrame([(i, t, g, None, len(t or ""), 5, 0.5, "x", 3) for i, t, g in rows], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
