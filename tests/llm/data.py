"""Small documents for the operators' tests."""

from __future__ import annotations

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "[\\x20\\x09-\\x0D]+"


def words_of(rng, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{int(k)}" for k in (rng.pareto(1.0, n) * 8).astype(int) % vocabulary]


def near_copies(rng, n: int = 120) -> list[str]:
    """Texts, exact copies of some, and copies with a few words changed by degrees."""
    base = [words_of(rng, int(rng.integers(1, 60)), 4000) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        w = list(base[int(rng.integers(len(base)))])
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(len(w)))] = f"x{int(rng.integers(900))}"
        out.append(w)
    return [" ".join(w) if rng.random() < 0.8 else "\t".join(v.upper() for v in w) for w in out]


def awkward(spark, extra: bool = True):
    """Nulls in every column, empty and blank texts, repeated rows and ids, a very long text; extra columns with
    names that the operators use themselves."""
    long = " ".join(f"word{k % 5000} line\n" for k in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "web", 3), (1, "one two three four five six", "en", "web", 3), (2, None, "en", "web", None), (3, "", None, None, 0), (4, " \n\t ", "de", None, 4),
        (None, "a text without an id", "en", "web", 5), (None, None, None, None, None), (5, "word", "en", "web", 4), (6, "Äpfel ß 漢字 naïve é", "de", "book", 9), (7, long, "en", "web", len(long)),
        (8, "mail a@b.org or 10.0.0.1 now", "en", "web", 9), (9, "one two three four five six", None, "web", 3), (1, "another text of the same id", "fr", "book", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("key", "n", "cls", "grp", "size", "h", "pos", "term", "rate", "shard", "score", "_c", "_id", "_hit", "held_out", "component_id"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df, len(rows)


def empty(spark):
    return spark.createDataFrame([], DOCS)
