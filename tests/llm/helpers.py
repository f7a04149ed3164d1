"""Small tables and brute-force versions for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def documents(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7) for i, t, s in rows], SCHEMA)


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, nulls, empties and repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 30)
    rows = []
    for i in range(n):
        w = words(rng, rng.randrange(3, 120))
        if i % 5 == 0:
            w = w[:40] + passage
        rows.append((i, " ".join(w), f"s{i % 3}"))
    for k in range(25):
        i, t, s = rows[rng.randrange(n)]
        w = t.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        rows.append((100 + k, (" " if k % 2 else "\n").join(w).upper(), s))
    rows += [(200, None, "s0"), (201, "", "s0"), (202, " \n\t", None), (203, "one two", "s1"), (204, "One  Two", "s1"), (205, "ab", "s1"), (206, "é ü 中文 ☃ — “q”", "s2")]
    rows += [rows[3], rows[3]]
    return rows
