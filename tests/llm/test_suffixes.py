"""Repeated byte strings against brute force; the suffix order against plain sorting."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases

from rillflow.llm import suffixes
from rillflow.llm.suffixes import repeated_spans, sorted_suffixes, without_repeats

LOW = float("-inf")


def brute(rows, width=50):
    """(id, bytes, removed, runs, hash of the rest); a null id comes first."""
    texts = [(LOW if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for key, text in texts:
        for p in range(len(text) - width + 1):
            s = text[p : p + width]
            first[s] = min(first.get(s, key), key)
    out = []
    for key, text in texts:
        gone = bytearray(len(text))
        for p in range(len(text) - width + 1):
            if first[text[p : p + width]] < key:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(text, gone) if not g)
        runs = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((None if key == LOW else key, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r) for r in df.drop("spans").collect()), key=str)


@pytest.mark.parametrize("letters,seed", [("ab", 1), ("abc ", 2), ("a", 3), ("abcdefghijklmnop é", 4)])
def test_suffix_order(letters, seed):
    draw = random.Random(seed)
    text = "".join(draw.choice(letters) for _ in range(1500)).encode()
    text += text[200:700] + b"x" + text[100:900]
    buf = np.frombuffer(text, np.uint8)
    places = np.arange(len(text) - 50)
    got = [text[p : p + 50] for p in sorted_suffixes(buf, places, 50)]
    assert got == sorted(text[p : p + 50] for p in places)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert answer(repeated_spans(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_repetitive_texts_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    draw = random.Random(5)
    parts = ["".join(draw.choice("ab") for _ in range(draw.randint(1, 90))) for _ in range(12)]
    rows = [(draw.randint(0, 60), "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))) for _ in range(150)]
    df = cases.table(spark, rows).repartition(5)
    assert answer(repeated_spans(df, min_bytes=50)) == brute(rows)
    assert answer(repeated_spans(df, min_bytes=20)) == brute(rows, 20)


def test_edges(spark):
    rows = cases.edge_rows()
    df = cases.table(spark, rows)
    assert answer(repeated_spans(df)) == brute(rows)
    cut = without_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    kept = {r.doc_id: r.text for r in cut.collect() if r.doc_id == 5}
    assert kept[5] == " tail"  # the null id comes first, and 1 before 5


def test_empty(spark):
    assert repeated_spans(cases.empty(spark)).count() == 0
    assert without_repeats(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        repeated_spans(cases.empty(spark), min_bytes=8)
