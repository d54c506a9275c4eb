import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, copies long"


@pytest.fixture
def documents(spark):
    """Rows with nulls in any column, empty and long texts, copies and clashing extra columns."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (9, base, "en", "b"),
        (4, base, "en", "b"),
        (7, base.replace("word30", "other"), "en", None),
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, " \t\n", "fr", "a"),
        (5, "one", "fr", "c"),
        (6, "!!! ??? 123", "en", "c"),
        (8, "zebra " * 40_000, "en", "c"),
        (None, "no identifier here at all", "en", "b"),
        (11, "é" * 50 + " fin", None, "a"),
    ]
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", 0.5, 7) for i, t, la, s in rows], COLUMNS)


@pytest.fixture
def nothing(documents):
    return documents.limit(0)
