"""Small corpora: all the odd rows that operators must take, and random texts that repeat each other."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, id string, t string, g int, payload string, hits int, score double, row int"


def table(spark, rows, parts: int = 3):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "id", "t", 1, "p", 2, 0.5, 3) for i, t in rows], SCHEMA).repartition(parts)


def odd_rows() -> list[tuple[int | None, str | None]]:
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "tie tie tie"), (6, "tie tie tie"), (7, "tie tie tie"), (7, "tie tie tie"), (7, "another text under the same id"),
        (None, "a row without an id"), (None, None), (8, long), (9, long), (10, "é😀 ünï " * 40), (11, "é😀 ünï " * 41), (-5, "negative ids come first " * 9), (12, "negative ids come first " * 9),
        (13, "x" * 20_000), (14, None),
    ]


def random_rows(seed: int, n: int = 120) -> list[tuple[int, str]]:
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "été", "δ", "x", "long-ish-word", "1", "be"]
    passages = [" ".join(r.choice(words) for _ in range(r.randrange(5, 40))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(0, 5))]
        out.append((i * 3 - 40, r.choice([" ", "  ", "\n"]).join(parts)))
    return out + [(i + 1, t) for i, t in out[:20]]
