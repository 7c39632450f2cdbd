"""Text statistics against brute force; line frequencies and depletion by hand."""

import os
import re
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases

from rillflow.llm.quality import filtered, judged


def brute(rows):
    out = []
    for key, text in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        seen, repeats = set(), 0
        for line in text.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                repeats += line in seen
                seen.add(line)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        marks = [False] * len(words)
        for i in range(len(words) - 2):
            if windows[tuple(words[i : i + 3])] > 1:
                marks[i] = marks[i + 1] = marks[i + 2] = True
        n, r = len(words), sum(marks)
        out.append((key, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, r, n < 50 or 100 * r > 50 * n))
    return sorted(out, key=str)


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_statistics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = judged(docs).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    rows = cases.edge_rows() + [(20, "# * $\na b\na b\n" + "q q q q\n" * 30)]
    got = judged(cases.table(spark, rows)).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    assert judged(cases.empty(spark)).count() == 0
    assert filtered(cases.empty(spark)).count() == 0


@pytest.fixture(scope="module")
def hosts(spark):
    """On one host every document holds a notice; some consist mostly of it. On another the notice is rare."""
    notice = cases.words(40, 99)
    rows = [(i, cases.words(100, i) + "\n" + notice.upper(), "h1") for i in range(30)]
    rows += [(100 + i, cases.words(20, 100 + i) + "\n" + notice, "h1") for i in range(3)]
    rows += [(200 + i, cases.words(100, 200 + i) + ("\n" + notice if i < 3 else ""), "h2") for i in range(40)]
    rows += [(300 + i, cases.words(70, 300), "h2") for i in range(40)]  # copies are one document
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), notice


def test_lines_above_the_limit(hosts):
    docs, _ = hosts
    got = {r.doc_id: r for r in judged(docs).collect()}
    assert all(got[i].kept and got[i].lost_words == 40 for i in range(30))
    assert all(not got[100 + i].kept and not got[100 + i].base_failed for i in range(3))
    assert all(got[200 + i].kept and got[200 + i].lost_words == 0 for i in range(40))
    assert all(got[300 + i].kept for i in range(40))


def test_filter_agrees_with_verdicts(hosts):
    docs, notice = hosts
    verdicts = {r.doc_id: r.kept for r in judged(docs).collect()}
    left = {r.doc_id: r.text for r in filtered(docs).collect()}
    assert set(left) == {i for i, kept in verdicts.items() if kept}
    assert all(notice.upper() not in left[i] for i in range(30)) and notice in left[200]
    assert filtered(docs).columns == docs.columns


def test_clashing_names_stay(hosts):
    docs, _ = hosts
    odd = docs.selectExpr("*", "'x' AS _host", "array(1L) AS _lines", "1 AS _LINES_")
    left = filtered(odd)
    assert left.columns == odd.columns and left.count() == filtered(docs).count()
    assert {(r._host, tuple(r._lines)) for r in left.select("_host", "_lines").collect()} == {("x", (1,))}
