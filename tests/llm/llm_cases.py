"""Rows and helpers that the tests of the corpus operators share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, score string, row string, shard string, key string"


def filler(n: int, seed: int = 0) -> str:
    """n different words that no other seed gives."""
    return " ".join(f"w{seed}x{k}" for k in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, ties, a very long text."""
    long = filler(60_000, 9)
    near = filler(300, 1)
    texts = [
        (1, near),
        (2, near),
        (2, near),
        (3, near + " tail"),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (None, near),
        (None, None),
        (7, "One two"),
        (8, "one TWO"),
        (9, long),
        (10, filler(40, 3) + "\n" + filler(25, 1) + "\n" + filler(40, 4)),
        (10, "another text of the same id"),
        (11, "é — ü " * 30),
        (12, filler(30, 5) + " " + filler(30, 5)),
        (13, "x" * 70_000),
    ]
    return [(i, t, "a", "b", "c", "d", "e") for i, t in texts]
