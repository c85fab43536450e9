"""Small tables with the awkward cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, bucket long, part int, label string, n_lines long, term long, shard int, value string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [f"w{rng.randrange(4000)}" for _ in range(n)]
    return " ".join(w + ("\n" if k % 9 == 8 else "") for k, w in enumerate(words))


def texts() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    long = prose(2, 30000)
    shared = "The  Same LINE of all\t"
    rows = [(1, base), (2, base), (3, near), (4, prose(3, 200)), (5, None), (6, ""), (7, " \t\n \x0b"), (8, "one two"), (9, "one two"), (10, long)]
    rows += [(20 + k, f"{prose(50 + k, 40)}\n{shared if k % 2 else shared.lower().strip()}\n") for k in range(12)]
    rows += [(40, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a"), (41, "é🙂 b # $ x\né🙂 b # $ x\n\n c")]
    rows += [(4, prose(3, 200)), (None, base), (None, None), (50, "x" * 50000)]
    return rows


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, None, "s", None, "k", 1, 2, 3, "l", 4, 5, 6, "v") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return table(spark, [])
