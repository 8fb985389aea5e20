"""Small tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 6000 + "x" * 5000
ROWS = [
    (1, "The Cat sat on the mat and looked at the dog", "en", "a", 1),
    (2, "the cat SAT on the mat and looked at the dog", "en", "a", 1),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, "   \n\t ", "de", None, 5),
    (6, LONG, "en", "b", len(LONG)),
    (7, "one two three", "en", "b", 13),
    (7, "one two three", "en", "b", 13),
    (8, "Ünïcode — tèxt mit <|endoftext|> Zeichen 😀 !!", "de", "b", None),
    (9, "one two three four five six seven eight nine", None, "c", 3),
    (None, "one two three", "en", "b", 13),
    (None, None, None, None, None),
]
CLASHES = "body row tail fp hash size id doc copy spans keep_id kept prefix n_tokens ids bytes score rejected_by".split()


def docs(spark, rows=None):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
