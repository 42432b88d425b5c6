"""Small documents with the cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, key string, row int, votes string, word string, topic string, h string"


def sentence(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(("ba", "ne", "ti", "lo", "rus", "mek")) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def rows() -> list[tuple]:
    base = sentence(1)
    near = base.replace(base.split()[50], "changed", 1)
    texts = [
        (1, base), (2, base), (3, near), (4, sentence(2)), (4, sentence(2)), (5, None), (6, ""), (7, "   \n\t "), (8, "1234 567"), (9, "word"),
        (None, sentence(3)), (10, sentence(4, 30_000)), (11, "é ü 中文 🙂 <|endoftext|>\x85 x"), (12, "x" * 100_000), (13, "a b c\n" * 500),
    ]
    return [(i, t, "xx" if i and i % 2 else None, None if i == 4 else f"s{(i or 0) % 3}", None if t is None else len(t), "w", "k", 1, "v", "o", "t", "h") for i, t in texts]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
