"""Odd rows that every operator must stand, and tables of them."""

import random

from pyspark.sql import functions as F

#: Nulls, empty and blank texts, ties, repeated rows, a null id, several scripts, a very long text.
EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "Hello World"),
    (6, "hello world"),
    (6, "hello world"),
    (7, "Übermut tut ſelten gut – 数据 🙂 end"),
    (None, "a row without an id"),
    (None, None),
    (8, "HELLO WORLD"),
    (9, " ".join(f"word{i % 977}" for i in range(20_000))),
]


def near():
    """Texts of which groups differ in one word of many."""
    rng = random.Random(0)
    out = []
    for g in range(6):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
        for k in range(4):
            own = list(base)
            if k:
                own[rng.randrange(300)] = f"changed{k}"
            out.append((1000 + 10 * g + k, " ".join(own)))
    return out


def table(spark, rows, id_name="doc_id"):
    return spark.createDataFrame(rows, f"{id_name} long, text string")


def clashing(spark, rows):
    """The rows with columns more, named like what operators use within."""
    df = table(spark, rows)
    return df.withColumns({c: F.lit(c) for c in ("hash", "row", "key", "id", "n", "word", "c", "_row", "_text", "_id", "_hash", "_kept", "score", "toxicity", "toxic", "n_lines", "fingerprint", "lang")})


def empty(spark):
    return table(spark, [])
