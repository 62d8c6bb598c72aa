"""Rows that every operator must take."""

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"

# nulls, empty and blank texts, repeated rows, ties, and extra columns whose names clash with those that operators use
ODD = [
    (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"),
    (2, None, None, None), (3, "", "en", "a"), (4, " \t\n", None, "b"), (5, "x", "fr", None),
    (None, "one two three four five six seven", "en", "b"), (6, "ONE two  three four five six seven", None, "c"),
    (7, "été 日本語 \U0001f600 naïve é", "fr", "a"), (8, "long " * 30_000, "en", "a"),
    (9, "a" * 50_000, "de", "b"), (1, "another text under the same id entirely", "en", "a"),
]
