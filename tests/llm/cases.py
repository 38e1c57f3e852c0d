"""Documents with every edge: nulls, empty and very long texts, ties, repeated rows, and further columns whose names clash."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("score", "y", "token", "node", "n", "key", "label", "copies", "_lang", "_copy", "_order", "_found", "vector", "lang_pred", "held_out", "_u")

LONG = " ".join(f"word{k % 9973}" for k in range(150_000))
EDGE_TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (1, None, "en"),
    (2, "", "en"),
    (3, "   \n\t ", None),
    (4, "one", "en"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (6, LONG, "en"),
    (7, LONG + " end", None),
    (8, "\x00  \U0001f600 ünïcödé �", "de"),
    (9, "12345 67890 !!!", "en"),
    (9, "12345 67890 !!!", "en"),
    (None, "no id at all here but some words", "en"),
    (10, "Der schnelle braune Fuchs springt über den faulen Hund am Fluss", "de"),
]


def docs(spark, texts=None, clash=True):
    rows = [(i, t, lang, None if k % 3 == 0 else f"s{k % 2}", None) for k, (i, t, lang) in enumerate(EDGE_TEXTS if texts is None else texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASH)) if clash else df


def empty(spark):
    return spark.createDataFrame([], DOCS)
