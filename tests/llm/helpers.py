"""Small tables for the operators' edge cases."""

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string"


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties and columns with clashing names."""
    base = "The quick brown fox jumps over the lazy dog near the river bank today\nA second line of this text that repeats\n"
    rows = [
        (0, base + "tail zero", "en", "a", 1, 0.5, "x"),
        (1, base + "tail zero", "en", "a", 1, 0.5, "x"),
        (2, base + "tail two is its own", "en", None, None, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "de", "b", 0, 0.1, ""),
        (5, "   \n\t ", "de", "b", 0, 0.1, ""),
        (6, LONG, "fr", "b", 9, 0.9, "y"),
        (7, "l'été sera chaud à Besançon — déjà vu", "fr", "c", 5, 0.2, "z"),
        (7, "l'été sera chaud à Besançon — déjà vu", "fr", "c", 5, 0.2, "z"),
        (None, "a document without an id but with many words in it", "en", "c", 3, 0.3, "w"),
        (9, "one", "en", "a", 3, 0.3, "w"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
