"""Small documents with nulls, ties, repeats, odd characters and very long texts."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(n=60, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = text(30)
    rows = []
    for i in range(n):
        t = text(r.choice([0, 1, 3, 10, 50, 120]))
        if i % 7 == 3:
            t = f"{t}\n{passage} {text(5)}"
        if i % 9 == 5:
            t = rows[-1][1]
        if i % 11 == 6 and rows[-2][1]:
            t = rows[-2][1].replace("a", "A", 1) + " extra"
        rows.append((i * 3, t, "en", ["a", "b", None, "z"][i % 4], len(t) if t is not None else None))
    rows += [(1000, None, None, None, None), (1001, "", "en", "", 0), (1002, " \t\n", "en", "a", 3), (1003, "日本語のテキスト" * 40, "ja", "b", 320), (1004, "x" * 9000 + " é😀", "en", "b", 9003)]
    return rows


def clashing(spark, rows):
    """The table with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("node", "key", "size", "kept", "h", "pos", "r", "mark", "base", "component", "score", "slot")})
