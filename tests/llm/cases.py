"""Small tables with the cases every operator has to stand."""

from __future__ import annotations

import random

CLASHING = "row long, h long, n long, chunk long, id long, band string, bucket long, host string, items string, spans string, shard long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def words(n: int, seed: int, letters: str = "abcdefgh") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(n))


def table(spark, rows):
    """(doc_id, text) rows with other columns, whose names clash with those used inside."""
    extra = (7, 8, 9, 10, 11, "b", 12, "host", "items", "spans", 13)
    full = [(i, t, ("en", None, "fr")[k % 3], (None, "s1", "s2")[k % 3], None, *extra) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, white space only, odd characters."""
    long = words(6000, 1)
    passage = words(80, 2)
    return [
        (1, passage), (2, None), (3, ""), (4, " \n\t "), (5, passage + " tail"), (5, passage + " tail"), (6, long), (7, "x " + long[:9000]),
        (None, passage), (None, None), (8, "a b c"), (9, "A B C"), (10, "é ü 漢字 " * 40), (11, "\x0b\x1c a b\r\n" * 30), (12, "aaaa" * 500), (13, "aaaa" * 501),
        (-5, words(120, 3) + "\n" + passage),
    ]


def empty(spark):
    return table(spark, []).limit(0)
