"""The stages one after the other, each against brute force on its own input."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import test_decontaminate
import test_minhash
import test_suffixes as suffix_cases

import corpus_pipeline
from rillflow.llm.common import saved
from rillflow.llm.quality import judged


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], sf_dir)))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(outputs):
    assert [len(corpus_pipeline.STAGES), *[df.columns for df in outputs[1:5]]] == [5] + [outputs[0].columns] * 4


def test_quality(outputs):
    kept = {r.doc_id for r in judged(outputs[0]).where("kept").collect()}
    assert {k for k, _ in rows(outputs[1])} == kept


def test_near_duplicates(outputs):
    assert sorted(k for k, _ in rows(outputs[2])) == [r[0] for r in sorted(test_minhash.brute(rows(outputs[1]))) if r[3]]


def test_suffixes(outputs):
    want = {r[0]: r[1] - r[2] for r in suffix_cases.brute(rows(outputs[2]))}
    got = {k: len(t.encode()) for k, t in rows(outputs[3])}
    assert set(got) == set(want) and all(0 <= want[k] - got[k] <= 6 for k in got)


def test_decontamination(spark, sf_dir, outputs):
    items = rows(spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    before = {k: h for k, _, h, _ in test_decontaminate.brute(rows(outputs[3]), items)}
    assert any(before.values()) and not any(h for _, _, h, _ in test_decontaminate.brute(rows(outputs[4]), items))
    assert {k for k, h in before.items() if not h} <= {k for k, _ in rows(outputs[4])}


def test_run(spark, sf_dir, outputs):
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in outputs[4].collect()}
    assert sum(r.length for r in got.collect()) == sum(r.length for r in outputs[5].collect())
    assert len({key(r) for r in got.collect()}) == got.count()
