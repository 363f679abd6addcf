"""Rows that every operator must bear: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

WORDS = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "mp", "lk")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rid string, keep string, gone int, rank int, `a.b` string, spans string, flags int, language string"


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    long = prose(1, 30_000)
    texts = [(1, prose(2, 120)), (2, prose(2, 120)), (2, prose(2, 120)), (3, None), (4, ""), (5, " \n\t "), (None, prose(3, 80)), (None, None), (6, long), (7, "x " * 300), (8, prose(4, 60) + "\n" + prose(2, 70)), (2, prose(5, 90)), (9, "naïve über 𝒳 été " * 20), (10, "word"), (11, prose(2, 119) + " other"), (12, "   . ! ?")]
    return [(i, t, None if i == 3 else "en" if (i or 0) % 2 else "fr", None if i == 4 else "s", None if t is None else len(t), "k", "r", "q", 1, 2, "dot", "s", 3, "zz") for i, t in texts]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
