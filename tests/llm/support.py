"""Fixtures shared by the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta omega kappa sigma theta lambda epsilon zeta iota".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 60)) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows and ids, ties, white space of all kinds."""
    same = prose(1, 60)
    return [
        (1, same, "en", "a", 3), (2, same, "en", "a", 3), (3, same + " more", None, "b", None), (4, None, "en", None, 0), (5, "", None, "b", 0),
        (6, " \t\n ", "de", "a", 4), (7, "one", "de", "a", 3), (8, prose(2, 4000), "en", "c", 1), (9, prose(3, 12), "en", None, 1), (9, prose(3, 12), "en", None, 1),
        (None, prose(4, 30), "en", "a", 1), (None, None, None, None, None), (10, "Straße Ünï 日本 😀 " * 8, "xx", "b", 2), (11, "x" * 5000, "en", "c", 1),
    ]


def clashing(docs):
    """The same documents with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    for name in ("key", "node", "label", "size", "bucket", "score", "words", "copies", "host", "path", "bad", "evidence", "chunk", "core", "bin", "at", "kept", "taken", "p", "q"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs
