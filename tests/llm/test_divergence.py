"""Source divergence against a plain count in whole numbers; skybands against all pairs."""

import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases

from rillflow.llm import divergence as D

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least_docs=3, k=200):
    """Ranked rows for (text, lang, source) documents."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least_docs]
        total = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def p(count, size):
            return 1 + 10**9 * (count + 1) // (size + len(kept))

        sizes = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = {s: {t: p(counts[lang, s][t], sizes[s]) for t in kept} for s in sources}
        whole = {t: p(total[t], sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((share[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and share[s][t] > whole[t]]
            for part, valued, most in (("pair", pairs, None), ("term", terms, k)):
                ranked = sorted(valued, key=lambda v: (-v[0], v[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def test_query(spark, sf_dir):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(D.op11_source_divergence(spark, sf_dir)) == brute(rows)


SCHEMA = "text string, lang string, source string, term string, n long, total long, block long, band long, size long, v long, item string, value long, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(t, *((None, "en", "fr")[i % 3], (None, "s1", "s2", "s3")[i % 4])) for i, (_, t) in enumerate(cases.edge_rows())]
    rows += [("É é Straße STRASSE é_É a1b @a[b]", "fr", s) for s in ("s1", "s2", "s2", None)] + [(None, "xx", "only"), ("", "yy", "a"), (None, "yy", "b")]
    rows += [(cases.words(60, i, "abc"), "en", f"s{i % 5}") for i in range(40)] + [("rare words here", "zz", "a")] * 2
    return rows, spark.createDataFrame([(*r, "t", 1, 2, 3, 4, 5, 6, "i", 7, 8) for r in rows], SCHEMA)


def test_edges(odd):
    rows, docs = odd
    assert got(D.divergence(docs)) == brute(rows)
    assert got(D.divergence(docs, least_docs=1, k=3)) == brute(rows, 1, 3)


def test_blocks_bands_and_small_tables(odd):
    rows, docs = odd
    assert got(D.divergence(docs, k=5, sizes=D.Sizes(entries=50, looked=30, bands=100, block=100, band=2, cells=40))) == brute(rows, k=5)


def test_empty(odd):
    assert D.divergence(odd[1].limit(0)).count() == 0


def test_terms_of_pieces(monkeypatch):
    text = ("Ab,ß漢x" + "y" * 100 + " " + "-" * 50 + "ab Z") * 20
    whole = D.terms_of(text.encode())
    monkeypatch.setattr(D, "PIECE", 7)
    assert D.terms_of(text.encode()) == whole == Counter(re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.encode().lower()))


@pytest.mark.parametrize("seed", range(6))
def test_skyband(seed):
    draw, k = random.Random(seed), seed % 3 + 1
    terms = [bytes(draw.choices(b"abz\xc3", k=3)) + str(i).encode() for i in range(700)]
    n, total = (np.array([draw.randint(1, 9) for _ in terms]) for _ in range(2))
    least = [i for i in range(700) if sum(n[j] >= n[i] and total[j] <= total[i] and terms[j] < terms[i] for j in range(700)) < k]
    assert sorted(D.skyband(pa.array(terms, pa.binary()), n, total, k).tolist()) == least


def test_shares_do_not_overflow():
    n, size = np.array([8 * 10**15, 0, 3 * 10**15]), 8 * 10**15 + 1
    assert D.p_of(n, size).tolist() == [1 + 10**9 * (int(c) + 1) // size for c in n]
