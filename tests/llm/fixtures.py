"""Small documents with every awkward case, for all operators."""

from __future__ import annotations

import random

WORDS = "the of and to in that is was for on with as his they at be this from have or had by word".split()


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "a", "ing", "é", "X"]) for _ in range(words))


PASSAGE = prose(99, 60)
LINE = "A very common line of some length that many of the texts share."


def texts() -> list[tuple[int | None, str | None]]:
    near = prose(1, 200).split()
    near[100] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (1, prose(1, 200)),
        (2, None),
        (3, ""),
        (4, prose(4, 6000)),  # long
        (5, prose(1, 200)),  # a copy
        (6, " ".join(near)),  # a near copy
        (7, "   \n\t "),
        (8, "word"),
        (9, "two words"),
        (10, PASSAGE),
        (11, prose(11, 40) + " " + PASSAGE + "\n" + prose(12, 30)),
        (12, prose(13, 300) + " " + PASSAGE),
        (13, "ab" * 400),  # repeats itself
        (14, "mail me at Jane.Doe+x@mail.example.com or +1 (434) 555-2368, 10.0.0.255 and 4111 1111 1111 1111!"),
        (15, "no mail: a@b @c.d 1.2.3.400 4111 1111 1111 1112 +12 34"),
        (16, "漢字 text <|endoftext|> İ ½ it's we'll​ don't"),
        (None, prose(17, 50)),
        (None, prose(17, 50)),
        (1, prose(1, 200)),  # a repeated row
        (20, prose(20, 30)),
        (20, prose(21, 30)),  # an id with another text
        (21, "WORD word Word word word WORD"),
        (22, "x" * 3000),  # one long word
    ]
    rows += [(30 + i, f"{prose(200 + i, 25)}\n{LINE}\n{prose(300 + i, 25)}") for i in range(20)]
    return rows


# Columns that operators use inside; a table may have them.
CLASHING = ["row", "n", "key", "bucket", "shard", "words", "fp", "score", "spans", "base", "terms", "part", "node",
            "_id", "_key", "_key2", "_base", "_terms", "_k", "_k2", "row_key", "row_key2", "k", "kept_id"]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{c} string" for c in CLASHING
    )
    full = [(i, t, None, "s", None, *("x" for _ in CLASHING)) for i, t in rows]
    return spark.createDataFrame(full, ddl).repartition(3)
