"""Plain-Python forms of the contracts, and rows that hold the awkward cases."""

import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, body int, owner string"


def documents(spark, texts, ids=None):
    """Documents with further columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return SPACE_WORD.findall(text or "")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
