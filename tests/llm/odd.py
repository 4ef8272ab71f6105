"""A table of documents with everything that may go wrong, and an empty one."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, line int, row long, key string, spans string, n_words long"


def rows():
    long_text = " ".join(f"word{k % 977} steht hier" for k in range(20_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank.\nThe quick brown fox jumps over the lazy dog near the river bank."),
        (2, None),
        (3, ""),
        (4, "  \n\t "),
        (5, long_text),
        (6, "The quick brown fox jumps over the lazy dog near the river bank."),
        (6, "The quick brown fox jumps over the lazy dog near the river bank."),
        (None, "Ein anderer Satz mit Umlauten: äöü und ß, der lang genug ist."),
        (7, "x" * 50_000),
        (8, "12345 67890 !!! ???"),
        (9, "naïve café — déjà vu 😀 <|endoftext|>   ſ K"),
        (None, None),
    ]
    return [(i, t, None if i == 6 else "en", "s", None, 1, 2, 3, "k", "x", 4) for i, t in texts]


def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, limit=None):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
