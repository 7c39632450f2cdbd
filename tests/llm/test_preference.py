"""Quality by preferences: held-out accuracy, the loss against its definition, edges."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases

from rillflow.llm import preference
from rillflow.llm.preference import ACCEPTED, GRID, HASHED, SHAPES, _known, _places, _surprise, _threshold, features, fitted, held_out, op13_quality_preference, scored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    return op13_quality_preference(spark, SF).toPandas()


def auc(score, label):
    good, bad = score[label == 1].to_numpy(), score[label == 0].to_numpy()
    return ((good[:, None] > bad).mean() + (good[:, None] >= bad).mean()) / 2


def test_held_out_accuracy(spark, judged):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = judged.merge(labels, on="doc_id")
    unseen = both[both.held_out]
    assert len(unseen) > 50 and auc(unseen.score, unseen.quality) > 0.97 and (unseen.predicted == unseen.quality).mean() > 0.95
    assert judged.score.between(0, 1).all() and ((judged.score >= ACCEPTED) == (judged.predicted == 1)).all()
    assert len(judged) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_only_texts_and_training_labels_count(spark, judged, tmp_path):
    """Other languages, sources and lengths, and wrong labels of held-out documents, change no score."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    flipped = "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality"
    labels.selectExpr("doc_id", flipped, "1 - toxic AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    again = op13_quality_preference(spark, str(tmp_path)).toPandas().sort_values("doc_id")
    assert np.allclose(again.score.to_numpy(), judged.sort_values("doc_id").score.to_numpy(), atol=1e-6)


def test_descent_lowers_the_loss_and_cuts_at_the_share():
    draw = np.random.default_rng(3)
    rows, labels = draw.random((300, SHAPES + HASHED)), np.repeat([0, 1, 1], 100)
    rows[labels == 1, 0] += 1
    model = fitted(rows, labels, 0.25)
    raw = rows @ model.weights
    assert (raw[labels == 1][:, None] - raw[labels == 0] > 0).mean() > 0.95
    score = model.scores(rows)
    assert abs(np.where(labels == 1, 0.75 / 200, 0.25 / 100)[score < ACCEPTED].sum() - 0.25) < 0.01


def test_the_loss_is_that_of_all_pairs():
    draw = np.random.default_rng(5)
    bad, good = draw.normal(-1, 2, 70), draw.normal(1, 2, 110)
    loss, of_bad, of_good = _surprise(*_places(np.concatenate([bad, good]), np.repeat([0, 1], [70, 110])))
    apart = bad[:, None] - good
    assert abs(loss - np.logaddexp(0, apart).mean()) < 1e-4
    chance = 1 / (1 + np.exp(-apart))
    assert np.allclose(np.interp(bad, GRID, of_bad), chance.mean(1), atol=1e-2) and np.allclose(np.interp(good, GRID, of_good), chance.mean(0), atol=1e-2)


def test_threshold_among_equal_scores():
    for s, share in (([3.0, -2, -2, -2, 5, 0.5], 0.5), ([1.0] * 4, 0.3), ([-1.0, 2], 1.0), ([-7.25, -0.0, 0.0, 1e-300], 0.25)):
        rows, labels = np.array(s)[:, None], np.arange(len(s)) % 2
        got = _threshold(lambda of, join=np.add: of(rows, labels), lambda r: r[:, 0], np.full(2, 1 / len(s)), share)
        ordered = np.unique(s)
        own = np.sort(s)[min(max(1, round(share * len(s) + 0.499)), len(s)) - 1]
        k = int(np.searchsorted(ordered, own))
        other = ordered[k + 1] if k + 1 < len(ordered) else ordered[k - 1] if k else own
        assert got == (own + other) / 2


def test_every_labelled_document_is_learned_from(spark):
    """More labelled documents than any bound there was; the model is the one of all their rows."""
    rows = [(i, f"{'good words of text' if i % 3 else 'BAD %% 99'} {i * 7919 % 9973} {'x' * (i % 13)}") for i in range(13000)]
    docs, labels = cases.table(spark, rows), marks(spark, [(i, int(i % 3 > 0), 0, 0.0, "") for i, _ in rows])
    known, share = _known(docs, labels, None)
    assert known.count() == 13000 and abs(share - 1 / 3) < 1e-3
    every = features([t.encode() for _, t in rows]).astype(np.float32).astype(np.float64)
    want = fitted(every, np.array([int(i % 3 > 0) for i, _ in rows]), share).scores(every)
    got = {r.doc_id: r.score for r in scored(docs, docs, labels).collect()}
    assert np.allclose([got[i] for i, _ in rows], want, atol=1e-4)


def test_no_text_is_shuffled(spark, monkeypatch):
    """What meets the labels are features: no exchange of the written plan has the texts, and labels are not broadcast."""
    plans, write = [], preference.saved
    monkeypatch.setattr(preference, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    docs = cases.table(spark, [(i, f"{'good words' if i % 2 else 'BAD %%'} {i}") for i in range(40)])
    rows, _ = _known(docs.select("doc_id", "text"), marks(spark, [(i, i % 2, 0, 0.0, "") for i in range(0, 40, 3)]), None)
    assert rows.count() == 14 and "SortMergeJoin" in plans[-1] and "BroadcastHashJoin" not in plans[-1]
    above = plans[-1][plans[-1].index("SortMergeJoin") :]
    assert "Exchange" in above and "MapInArrow" in above[above.index("Exchange") :]


def test_features_do_not_depend_on_neighbours():
    texts = [(t or "").encode() for _, t in cases.edge_rows()]
    together, alone = features(texts), np.concatenate([features([t]) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score double, text string")


def test_edges(spark):
    docs = cases.table(spark, cases.edge_rows())
    labels = marks(spark, [(1, 1, 0, 0.0, ""), (6, 1, 0, 0.0, ""), (12, 0, 0, 0.0, ""), (13, 0, 0, 0.0, ""), (5, 0, 0, 0.0, ""), (5, 1, 0, 0.0, ""), (8, None, 0, 0.0, ""), (None, 1, 0, 0.0, ""), (9, 7, 0, 0.0, "")])
    out = scored(docs, docs, labels).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in cases.edge_rows())
    score = {r.doc_id: r.score for r in out}
    assert score[6] > score[12] and score[2] == score[3]
    assert len({r.score for r in out if r.doc_id == 5}) == 1
    bounded = scored(docs, docs, labels, fit_docs=1).collect()
    assert len(bounded) == len(out)


def test_labels_of_one_kind_or_none(spark):
    docs = cases.table(spark, cases.edge_rows())
    for rows, kept in (([(1, 1, 0, 0.0, "")], 1), ([(1, 0, 0, 0.0, "")], 0), ([], 1)):
        out = scored(docs, docs, marks(spark, rows)).collect()
        assert {r.predicted for r in out} == {kept} and len({r.score for r in out}) == 1


def test_empty(spark):
    docs = cases.empty(spark)
    assert scored(docs, docs, marks(spark, [])).count() == 0
    assert docs.select(held_out("doc_id")).count() == 0
