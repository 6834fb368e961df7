"""Rows that every operator has to cope with, and helpers."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over a lazy dog near the old mill. " * 4000


def odd_rows():
    """Null and empty texts, blanks, one very long word and text, repeated
    rows and ids, a null id."""
    return [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t \n", None, None, 5),
        (4, "x" * 100_000, "en", "a", 100_000),
        (5, LONG, "en", "b", len(LONG)),
        (6, "same words here again", "en", "b", 21),
        (6, "same words here again", "en", "b", 21),
        (7, "one id", "en", "b", 6),
        (7, "two texts", "en", "b", 9),
        (None, "no id at all", "en", "b", 12),
        (None, None, None, None, None),
        (8, "é日▁ \x00😀\n\n.", "de", "b", 9),
    ]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
