"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{k % 977} of passage{k % 31}." for k in range(30_000))
SENTENCES = "The quick brown fox jumps over a dog. It was not amused by all of this today. So they went home to eat some bread."


def documents(spark, extra=True):
    rows = [
        (1, "Plain English text about the house and the garden. " * 3, "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, "   \t\n ", "fr", "b"),
        (5, LONG, "en", "c"),
        (6, SENTENCES, "en", "a"),
        (7, SENTENCES, "en", None),
        (7, SENTENCES, "en", None),
        (8, "12345 !!! ###", "de", "b"),
        (None, "Une petite maison dans la prairie, avec des fleurs.", "fr", "b"),
        (9, "un", "fr", "c"),
        (10, "Other words come first here. " + SENTENCES, "en", "c"),
        (11, "a\x00b\x01c ▁▁   tail  double", "en", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    if extra:
        for c in ("words", "size", "key", "bands", "score", "copies", "path"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
