"""Rows that every operator must cope with."""

LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
#: Nulls, empty and blank texts, repeated rows, ties, a very long text.
ODD_ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "one two three four five six seven", "b"), (5, "word", "b"),
    (6, LONG, "b"), (7, LONG, "a"), (7, LONG, "a"), (None, None, None), (9, "one two three four five six seven", None),
    (10, "one two three four five six seven", "b"), (10, "another text with the same id stands here today", "b"),
]
