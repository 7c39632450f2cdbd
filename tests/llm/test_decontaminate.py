"""Benchmark windows in documents against brute force."""

import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases

from rillflow.llm.decontaminate import contamination, decontaminated, op4_decontaminate


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def brute(rows, items, n=10):
    windows = {}
    for key, text in items:
        x = words(text)
        for i in range(max(1, len(x) - n + 1) if x else 0):
            windows.setdefault(tuple(x[i : i + n]), set()).add("" if key is None else str(key))
    out = []
    for key, text in rows:
        x, found = words(text), set()
        hit = [False] * len(x)
        for size in {len(w) for w in windows}:
            for i in range(len(x) - size + 1):
                if tuple(x[i : i + size]) in windows:
                    found |= windows[tuple(x[i : i + size])]
                    hit[i : i + size] = [True] * size
        out.append((key, len(x), sum(hit), sorted(found)))
    return sorted(out, key=str)


def answer(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str)


def test_documents(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert answer(contamination(docs, items)) == want
    got = {r.doc_id: r for r in op4_decontaminate(spark, sf_dir).collect()}
    assert all((got[k].n_hit, got[k].n_items, got[k].contaminated) == (h, len(i), h > 0) for k, _, h, i in want)
    left = decontaminated(docs, items)
    parted = decontaminated(docs, items, part_bytes=3000)
    assert sorted(map(tuple, parted.collect()), key=str) == sorted(map(tuple, left.collect()), key=str)
    assert left.columns == docs.columns and contamination(left, items).where("n_hit > 0").count() == 0
    clean = {k for k, _, h, _ in want if not h}
    assert {r.doc_id: r.text for r in left.collect() if r.doc_id in clean} == {r.doc_id: r.text for r in docs.collect() if r.doc_id in clean}


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_short_items_and_parts(spark, part_bytes):
    draw = random.Random(1)
    items = [(i, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 14)))) for i in range(30)] + [(3, None), (None, "d d d")]
    rows = [(i, " ".join(draw.choice("abcd") for _ in range(draw.randint(0, 50)))) for i in range(150)] + cases.edge_rows()
    df = spark.createDataFrame(items, "item_id long, text string")
    assert answer(contamination(cases.table(spark, rows), df, part_bytes=part_bytes)) == brute(rows, items)


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_short_items_are_cut(spark, part_bytes):
    long = " ".join(f"w{i}" for i in range(20))
    items = [(1, "q r s"), (2, "t u"), (3, long), (4, "v")]
    draw = random.Random(2)
    rows = [(0, "a b q r s c d e q r s f g h i j"), (1, "a b q r s c d e t u f g h"), (2, "a b c d " * 10 + long + " e q r s f t u g"), (3, "a b q r s c d")]
    planted = ["q r s", "t u", "v", long, long[:30], "q r"]
    for key in range(4, 60):
        parts = [x for _ in range(draw.randint(0, 6)) for x in (cases.words(draw.randint(5, 15), draw.random()), draw.choice(planted))]
        rows.append((key, " ".join([*parts, cases.words(8, key)])))
    df = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for key, text in rows:
        x = words(text)
        hit = [False] * len(x)
        for _, item in items:
            y = words(item)
            size = min(10, len(y))
            windows = {tuple(y[i : i + size]) for i in range(len(y) - size + 1)}
            for i in range(len(x) - size + 1):
                if tuple(x[i : i + size]) in windows:
                    hit[i : i + size] = [True] * size
        if sum(hit) <= 0.5 * len(x):
            want[key] = [w for w, h in zip(x, hit) if not h]
    docs = cases.table(spark, rows)
    got = {r.doc_id: words(r.text) for r in decontaminated(docs, df, part_bytes=part_bytes).collect()}
    assert len(want) > 30 and {0, 1, 2, 3} <= set(want)
    assert got == want
    # Runs shorter than asked for stay only where more than a window is asked for.
    kept = {r.doc_id: r.text for r in decontaminated(docs, df, least_words=11).collect()}
    assert kept[0] == rows[0][1] and kept[2].split() == ("a b c d " * 10 + " e q r s f t u g").split()


def test_empty(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(cases.empty(spark), items).count() == 0
    docs = cases.table(spark, cases.edge_rows())
    assert contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminated(docs, items.limit(0)).count() == docs.count()


def test_clashing_name_stays(spark):
    passage = cases.words(40, 5)
    docs = spark.createDataFrame([(1, "a " + passage + " b " + cases.words(200, 6), "kept")], "doc_id long, text string, _hit string")
    items = spark.createDataFrame([(i, passage if i == 0 else cases.words(30, 50 + i)) for i in range(6)], "item_id long, text string")
    for part_bytes in (1 << 20, 100):
        got, = decontaminated(docs, items, part_bytes=part_bytes).collect()
        assert got._hit == "kept" and passage not in got.text
