"""Small tables that every operator has to bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, key string, component string"


def words(n: int, seed: int = 0, kinds: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(kinds)}" for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    """A row of documents, with extra columns whose names the operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", "z", "c")


def odd_rows():
    """Nulls in every column, empty and white texts, one word, ties, repeated rows, a very long text."""
    return [
        row(1, None),
        row(2, ""),
        row(3, " \n\t "),
        row(4, "one"),
        row(5, words(300, 5)),
        row(5, words(300, 5)),
        row(6, words(300, 5)),
        row(7, "ab " * 500),
        row(8, words(30_000, 8, 3_000)),
        row(9, "Łódź ßtraße 東京 \U0001f600 é"),
        row(None, words(80, 9)),
        row(10, words(80, 10), None, None),
        row(-3, words(80, 10)),
    ]


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)
