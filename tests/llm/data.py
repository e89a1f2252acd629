"""Small tables with the awkward rows every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, _text string"


def awkward(n=60, seed=0):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "Délta", "of", "the", "THE", "end.", "x1", "--", "日本", "a\x1cb"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))
        rows.append((i, text.replace("of the", "of\n\tthe"), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), len(text), "clash", "clash", "clash"))
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "en", "s1", 0, "", "", ""), (n + 2, " \n\t ", "en", "s3", 4, "", "", ""),
             (None, "null id text of some words here", "en", "s1", 5, "", "", ""), (None, None, None, None, None, None, None, None),
             (n + 3, "long " * 30_000 + "end", "fr", "s2", 9, "", "", "")]
    return rows + rows[:3] + rows[3:4] * 4


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
