"""Rows that every operator on documents must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, ids string, key string"


def awkward():
    """Nulls everywhere, empty and blank texts, one very long text, ties and
    repeated rows, and columns named like those that operators make."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    prose = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    texts = [
        None, "", " \t\n\x0b\r ", "one", "One two three", long, "x" * 50_000, "\n\n\n", "nbsp and   sep\x1c",
        "<|endoftext|> is a word's text", "Énd ß ﬁ İ", *prose, prose[0], prose[0] + " tail", prose[1].upper(),
        "same line\nother " + prose[2], "same line\n" + prose[3],
    ]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None, "s", "i", None) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[11], (None, prose[4], None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
