"""Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""

LONG = " ".join(f"w{k * 7919 % 5003}" for k in range(20_000))
BASE = " ".join(f"v{k}" for k in range(120))
NEAR = BASE.replace("v60 ", "changed ")
LINE = "Share this page with friends\n"
ROWS = [
    (1, BASE, "en", "a", 1),
    (2, BASE, "en", "b", 1),
    (3, NEAR, "en", "c", 1),
    (4, None, "en", "a", 1),
    (5, "", None, None, None),
    (6, " \t\n ", "en", "b", 1),
    (7, LONG, "en", "a", 1),
    (8, LINE + "one own line here with words", "en", "a", 1),
    (9, LINE + "another own line there with words", "en", "b", 1),
    (10, LINE + "third own line about it all", "en", "c", 1),
    (11, "two words", None, "c", 1),
    (11, "two words", None, "c", 1),
    (None, "nobody owns this text at all", "en", "d", 1),
    (None, None, None, None, None),
    (12, "This This This " * 40, "en", "a", 1),
    (13, "été déjà vu \U0001f437 naïve ça " * 30, "fr", None, 1),
    (-14, "it's <|endoftext|> 42!!", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, label string, slot string"
