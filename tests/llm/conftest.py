import pytest

DOCS = "doc_id long, text string, lang string, source string, id long, score double"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 7, 0.1),
    (2, "the quick brown FOX jumps over the lazy dog near the river bank today.", "en", "a", 7, 0.2),
    (3, "Der schnelle braune Fuchs springt über den faulen Hund am Fluss heute.", "de", "b", 7, None),
    (4, "", "en", "a", None, 0.3),
    (5, None, None, None, None, None),
    (6, "   \n\t ", "en", "a", 1, 0.4),
    (7, "1234 5678 !!", "en", "c", 1, 0.5),
    (8, "Le renard brun saute par-dessus le chien paresseux près de la rivière.", "fr", "c", 1, 0.5),
    (None, "A row without an id, with words of its own.", "en", None, 1, 0.5),
    (9, "word " * 30_000 + "end", "en", "c", 1, 0.5),
    (9, "word " * 30_000 + "end", "en", "c", 1, 0.5),
]


@pytest.fixture
def docs(spark):
    """Rows with nulls in every column, empty and very long texts, copies, repeated rows and columns that clash with results."""
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture
def rows():
    return ROWS


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)
