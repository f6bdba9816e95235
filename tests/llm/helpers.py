"""Small tables with the awkward rows every operator must take."""

import random

LETTERS = ["the", "of", "and", "ion", "été", "straße", "x1", "%%%", "A", "né"]


def words(rng, n):
    return [rng.choice(LETTERS) + rng.choice(LETTERS) for _ in range(n)]


def documents(spark, seed=3, n=60):
    """doc_id, text and extra columns whose names clash with the operators' own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(words(rng, rng.randint(3, 25))) for _ in range(rng.randint(1, 6)))
        rows.append((i, text))
    base = rows[0][1]
    rows += [(n, base), (n + 1, base + "  \n"), (n + 2, base.replace(" ", "  ")), (n + 3, None), (n + 4, ""), (n + 5, " \t\n"),
             (n + 6, "one"), (n + 7, "one two"), (n + 8, "é" * 5000 + " " + " ".join(words(rng, 6000))), (n + 9, "\x00"),
             (n + 10, "a<|endoftext|>b <|startoftext|>"), (n + 6, "one"), (n + 6, "other text"), (None, "no id"), (None, None)]
    return spark.createDataFrame([(i, t, "en", t, 1, 0.5, 7) for i, t in rows],
                                 "doc_id long, text string, lang string, mark string, fp int, score double, shard int")


def collect(df):
    return [r.asDict() for r in df.collect()]


def components(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
