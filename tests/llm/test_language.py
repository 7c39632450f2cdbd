"""Held-out accuracy, back-off, and the edges."""

import os
import sys
from zlib import crc32

sys.path.insert(0, os.path.dirname(__file__))
import cases

from rillflow.llm.language import Model, grams_of, predicted


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = predicted(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_backs_off_to_shorter_grams():
    entries = [("a", 0, "zab", 9), ("a", 2, "\x02q", 5), ("b", 1, "w", 5), ("a", 1, "w", 1)]
    model = Model(entries, {(lang, n): 10 for lang in "ab" for n in range(6)})
    best = lambda w: model.languages[int(model.word(w).argmax())]
    assert best("zab") == "a" and best("qqq") == "a" and best("ww") == "b" and not model.word("x").any()
    assert grams_of("ab", 2) == ["\x02a", "ab", "b\x03"]


def test_edges(spark):
    rows = cases.edge_rows() + [(50, "123 ... 7"), (51, "Ω")]
    got = predicted(cases.table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.lang_pred == "und" and r.score == 0 for k in (2, 3, 4, 50) for r in by[k]) and not by[None][0].held_out
    assert predicted(cases.empty(spark)).count() == 0
    unlabelled = cases.table(spark, rows).drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in predicted(unlabelled).collect()} == {"und"}


def test_each_fit_has_its_own_model(spark):
    """Two corpora with equal totals in one session: workers that live on must not answer with the first."""
    texts = [("ab ac ad", "aa bb cc"), ("xy xz xw", "yy zz ww")]
    for a, b in (("l1", "l2"), ("l2", "l1")):
        rows = [(i, texts[i % 2][0 if i % 4 < 2 else 1], (a, b)[i % 2], "s", 1) for i in range(80)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
        want = {r[0]: r[2] for r in rows}
        assert all(r.lang_pred == want[r.doc_id] for r in predicted(docs).collect())


def test_score_does_not_depend_on_what_came_before(spark, monkeypatch):
    from rillflow.llm import language

    entries = [("a", 0, w, t) for w, t in (("one", 3), ("two", 4), ("three", 9))] + [("b", 0, w, t) for w, t in (("two", 7), ("four", 5), ("one", 1))]
    totals = {(lang, n): 17 for lang in "ab" for n in range(6)}
    text = "one two three four two one four " * 50

    class Value:
        value = (entries, totals)

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([False])], ["doc_id", "text", "held_out"])
    scores = set()
    for known in (0, 1, 2, 100):
        monkeypatch.setattr(language, "KNOWN", known)
        language._READY.clear()
        out, = language._predict(language._Sent(Value, str(known)))(iter([batch]))
        scores.add(out.column(3)[0].as_py())
    assert len(scores) == 1
