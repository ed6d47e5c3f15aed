"""Small tables with every awkward case, and plain reference versions of shared parts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have columns of these names too.
CLASHING = ["score", "held_out", "predicted", "row", "th", "nth", "fp", "size", "copies", "block", "kept", "a", "b", "w", "t", "n", "d"]


def text_of(rng: random.Random, words: int) -> str:
    stems = ["stone", "river", "Lamp", "über", "ñandú", "cold", "of", "the", "a", "walks", "seven", "under"]
    return " ".join(rng.choice(stems) + rng.choice(["", "", "s", ",", "."]) for _ in range(words))


def awkward_docs(spark, extra: bool = False):
    """Nulls in every column, empty and very long texts, ties and repeated rows; optionally further columns."""
    rng = random.Random(11)
    rows = [(i, text_of(rng, rng.randrange(12, 60)), rng.choice(["en", "de"]), f"s{i % 3}", 5) for i in range(40)]
    rows += [(i + 100, rows[i][1], rows[i][2], rows[i][3], 5) for i in range(6)]  # copies
    rows += [rows[3], rows[3], rows[4]]  # repeated rows
    rows += [
        (200, None, None, None, None),
        (201, "", "en", "s0", 0),
        (202, " \n\t ", "en", None, 4),
        (None, "no id here at all", "en", "s1", 3),
        (None, "no id here at all", "en", "s1", 3),
        (203, "\n".join(text_of(rng, 9) for _ in range(400)), "en", "s2", 1),
        (204, text_of(rng, 4000), "en", "s2", 1),
        (205, "x" * 5000, "en", "s2", 1),
        (206, "a\r\n b\x0b\x0cc", "en", "s2", 1),
    ]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit(7) for c in CLASHING}) if extra else df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def components(n, links):
    """Least member of each number's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
