"""Ids against the library's own, exact round trips of shards and packed sequences."""

import os
import random
import sys
from collections import defaultdict
from zlib import crc32

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases
import numpy as np

P = pytest.importorskip("public_tokenizers")

from rillflow.llm import encoding, packing
from rillflow.llm.common import work_dir
from rillflow.llm.encoding import Encoder
from rillflow.llm.packing import Levels, packed
from rillflow.llm.tokenfiles import fetch_tokens, read_tokens, restored, serialised, trained, write_tokens

FILES = {"word": P.path("word_bpe_49k.json"), "byte": P.path("byte_bpe_50k.json")}


def whole(name, rows, end):
    """(id, all ids) by the library on whole texts."""
    encoder = Encoder(FILES[name])
    return [(k, raw + end.to_bytes(4, "little")) for (k, _), raw in zip(rows, encoder._whole([t or "" for _, t in rows]))]


@pytest.mark.parametrize("name", FILES)
def test_words_give_the_ids_of_whole_texts(name, sf_dir, spark, monkeypatch):
    monkeypatch.setattr(encoding, "KNOWN", 500)
    monkeypatch.setattr(encoding, "STEMS", 300)
    draw = random.Random(2)
    texts = ["", " ", "a  b", "a\n\nb", " a", "a ", "a\n", "x\ty", "x \ny", "q  r", "İ ΣΑΣ ς Σ", "it's don't", "áb é ́x", "<|endoftext|> a <|endoftext|>b", "\x1c a\x1cb", "A\r\nB", "Σ, ΑΣ. É, É. é! A1. 1a, ½. x_, a.. K, Å. ﬁ,"]
    odd = ("İ", "STANBULİ", "aİb", "\u0958", "a\u0958", "ǰ", "ΐ", "ẞ", "ŉ", "é", "e\u0301", "1İ", "½", "Å", "\u1e9e", "Ω\u0301")
    texts += [f"{w}{m}{t}" for w in odd for m in (*",.;:!?", "..", "'s", ".,", "-") for t in ("", " a", "\nb", "c")]
    texts += ["".join(draw.choice("aİ\u0958\u0307é\u0301ΣB1,.;:!? ") for _ in range(draw.randint(1, 12))) for _ in range(1500)]
    texts += ["".join(draw.choice("ab \n\t.'sé A1!\u00a0\u0301Σ") for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    encoder = Encoder(FILES[name])
    assert encoder.encode(texts) == encoder._whole(texts) and (encoder.led or encoder.free)


def test_serialised():
    for ids in ([], [1, 65535], [70000, 2]):
        assert restored(serialised(np.array(ids, "<u4"))).tolist() == ids
    assert trained([]) == b"" and trained([b"abc"]) == b"abc"


@pytest.mark.parametrize("shard_bytes", [1 << 24, 20_000])
def test_shards(spark, shard_bytes):
    rows = cases.edge_rows()
    folder = work_dir(spark)
    write_tokens(cases.table(spark, rows).repartition(3), folder, FILES["word"], 2, shard_bytes=shard_bytes)
    want, at = [], 0
    for key, raw in sorted(whole("word", rows, 2), key=lambda x: (x[0] is not None, x[0])):
        want.append((key, len(raw) // 4, crc32(raw)))
    got = [tuple(r) for r in read_tokens(spark, folder).collect()]
    assert sorted(((k, n, c) for k, _, n, c in got), key=str) == sorted(want, key=str)
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [k for k, *_ in sorted(got, key=lambda r: r[1])]
    assert order == [k for k, *_ in want]
    found = fetch_tokens(spark, folder, [8, 10, 999]).collect()
    assert {r.doc_id: bytes(r.ids) for r in found} == {k: raw for k, raw in whole("word", rows, 2) if k in (8, 10)}


def test_no_shards(spark):
    folder = work_dir(spark)
    write_tokens(cases.empty(spark), folder, FILES["word"], 2)
    assert read_tokens(spark, folder).count() == 0


def check(rows, pieces, size):
    """Every id in one piece, sequences without gaps; the ids that padding adds."""
    raws, got, lines = defaultdict(list), defaultdict(list), defaultdict(list)
    for key, raw in rows:
        raws[key].append(raw)
    for p in pieces:
        got[p.doc_id].append(p)
        lines[p.sequence_id].append(p)
    assert set(raws) == set(got)
    for key, mine in raws.items():
        want = sorted(n for r in mine for n in [len(r) // 4])
        assert sum(p.length for p in got[key]) == sum(want) and {p.doc_tokens for p in got[key]} == set(want)
        if len(mine) == 1:
            at = 0
            for p in sorted(got[key], key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == crc32(mine[0][4 * at : 4 * (at + p.length)])
                at += p.length
    pad = 0
    for pieces in lines.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
        pad += size - at
    return pad, len(lines)


@pytest.mark.parametrize("open_windows", [5, 1024])
def test_packing(spark, sf_dir, monkeypatch, open_windows):
    monkeypatch.setattr(packing, "OPEN", open_windows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pad, lines = check(whole("byte", rows, 1), packed(docs, FILES["byte"]).collect(), 2048)
    assert pad < 2048


def test_packing_edges(spark):
    rows = cases.edge_rows()
    got = packed(cases.table(spark, rows).coalesce(1), FILES["byte"], with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length for r in got)
    check(whole("byte", rows, 1), got, 2048)
    assert packed(cases.empty(spark), FILES["byte"]).count() == 0


def test_sum_of_squares():
    """The level chosen is the one that makes the sum of squared counts least."""
    draw = random.Random(1)
    levels = Levels(40)
    for i in range(400):
        n = draw.randint(1, 40)
        level = levels.level_for(n)

        def cost(h):
            counts = levels.counts.copy()
            counts[h] -= h > 0
            counts[h + n] += h + n < 40
            return int((counts[1:40] ** 2).sum())

        usable = [h for h in range(41 - n) if h == 0 or levels.counts[h]]
        assert cost(level) == min(map(cost, usable))
        levels.place((i, 0, bytes(4 * n), n))
        assert levels.open == int(levels.counts[1:40].sum())
    total = sum(len(p[2]) for ws in levels.windows for w in ws for p in w)
    out = levels.drained()
    assert sum(len(p[2]) for w in out for p in w) == total and all(sum(len(p[2]) for p in w) == 160 for w in out[:-1])
