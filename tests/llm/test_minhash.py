"""Near-duplicate groups against brute force over all pairs."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases

from rillflow.llm import minhash
from rillflow.llm.components import components
from rillflow.llm.minhash import near_duplicates


def shingles(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def roots(pairs, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def brute(rows):
    """(id, size, component, kept); a null id stands alone."""
    sets = [(i, shingles(t)) for i, t in rows]
    pairs = [
        (i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a]
        if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    of = roots(pairs, {i for i, _ in sets if i is not None})
    return sorted(((i, len(x), of.get(i), i is None or of[i] == i) for i, x in sets), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(text, share, draw):
    return " ".join("zz%d" % draw.randint(0, 9999) if draw.random() < share else w for w in text.split())


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert answer(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    rows = cases.edge_rows()
    assert answer(near_duplicates(cases.table(spark, rows))) == brute(rows)
    assert near_duplicates(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_links_that_miss_the_least_member(spark, monkeypatch, block):
    """Groups of copies edited around the threshold: many links are between members that are not the least."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(4)
    rows, key = [], 0
    for group in range(3):
        text = cases.words(150, group)
        for _ in range(30):
            rows.append((key := key + 1, edited(text, draw.choice([0.01, 0.02, 0.03, 0.05]), draw)))
        line = text  # a chain: each is a near copy of the one before only
        for _ in range(12):
            line = edited(line, 0.02, draw)
            rows.append((key := key + 1, line))
    draw.shuffle(rows)
    assert answer(near_duplicates(cases.table(spark, rows))) == brute(rows)


def test_components(spark):
    draw = random.Random(2)
    path = [(i, i + 1) for i in range(40)]
    pairs = path + [(100, i) for i in range(101, 160)] + [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(40)]
    links = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in pairs] + [(None, 3), (5, 5), (1, 0)], "u long, v long")
    of = roots(pairs, {x for p in pairs for x in p})
    assert {tuple(r) for r in components(links).collect()} == {(x, r) for x, r in of.items() if x != r}
    assert components(links.limit(0)).count() == 0
