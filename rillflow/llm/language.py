"""Language of a text, word first: known words by their frequency in each language, unseen words by their
longest character n-grams that are known, backing off to shorter ones.

The model is fitted on a bounded, hash-chosen sample of labelled documents per language and holds every word and n-gram
of theirs; as the sample is bounded, so is what is broadcast. Counts are combined inside the tasks before they are shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import small_batches

#: Labelled documents to learn from per language, longest n-gram.
FIT_DOCS, LONGEST = 600, 5
KNOWN = 300_000
HELD = 300_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between its edges."""
    edged = f"\x02{word}\x03"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (n = 0) and n-grams by language."""
    names = ["lang", "n", "gram", "times"]
    counts: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        grams: Counter = Counter()
        for (lang, word), times in counts.items():
            for n in range(1, LONGEST + 1):
                for gram in grams_of(word, n):
                    grams[lang, n, gram] += times
        rows = [(lang, 0, word, times) for (lang, word), times in counts.items()] + [(*k, v) for k, v in grams.items()]
        counts.clear()
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, times in Counter(words_of(text)).items():
                counts[lang, word] += times
            if len(counts) > HELD:
                yield from out()
    yield from out()


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, entries: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]) -> None:
        self.languages = sorted({lang for lang, _ in totals})
        place = {lang: i for i, lang in enumerate(self.languages)}
        width = len(self.languages)
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        # A word or n-gram that a language lacks counts as half an occurrence there.
        floors = np.zeros((LONGEST + 1, width))
        for (lang, n), total in totals.items():
            floors[n, place[lang]] = np.log(0.5 / total)
        kinds = []
        for _, n, gram, _ in entries:
            if gram not in self.tables[n]:
                self.tables[n][gram] = len(kinds)
                kinds.append(n)
        self.rows = floors[kinds] if kinds else np.zeros((0, width))
        for lang, n, gram, times in entries:
            self.rows[self.tables[n][gram], place[lang]] = np.log(times / totals[lang, n])
        self.blank = np.zeros(width)

    def word(self, word: str) -> np.ndarray:
        """Log score of a word in each language."""
        row = self.tables[0].get(word)
        if row is not None:
            return self.rows[row]
        for n in range(LONGEST, 0, -1):
            table = self.tables[n]
            rows = [table[g] for g in grams_of(word, n) if g in table]
            if rows:
                return self.rows[rows].mean(axis=0)
        return self.blank


_READY: dict[str, tuple] = {}


def _ready(sent: _Sent) -> tuple[Model, dict[str, int], np.ndarray]:
    if sent.id not in _READY:
        _READY.clear()
        model = Model(*sent.broadcast.value)
        _READY[sent.id] = (model, {}, np.zeros((KNOWN, len(model.languages))))
    return _READY[sent.id]


class _Sent(NamedTuple):
    """A broadcast model and a name of this fit, for workers live on and meet others."""

    broadcast: object
    id: str


def _predict(sent: _Sent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, places, table = _ready(sent)
        for batch in batches:
            found, scores = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text) if text else []
                if not words or not model.languages:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                extra = {}
                for word in set(words).difference(places):
                    if len(places) < KNOWN:
                        table[len(places)] = model.word(word)
                        places[word] = len(places)
                    else:
                        extra[word] = model.word(word)
                if extra:
                    each = np.stack([extra[w] if w in extra else table[places[w]] for w in words])
                else:
                    each = table[list(map(places.__getitem__, words))]
                total = each.sum(axis=0)
                best = int(np.argmax(total))
                found.append(model.languages[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows


def fitted(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[list, dict]:
    """Model parts from (doc_id, lang, text): the words and n-grams of about ``fit_docs`` documents of each language, chosen by the hash of their id."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], {}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_docs / n))]), F.col("lang"))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, n int, gram string, times long")
    entries = [tuple(r) for r in counts.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")).orderBy("n", "gram", "lang").collect()]
    totals: Counter = Counter()
    for lang, n, _, times in entries:
        totals[lang, n] += times
    return entries, dict(totals)


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """Rows: doc_id, held_out (crc32 of the id as text leaves 2 modulo 4), lang_pred, score.

    Learns only from texts with a language that are not held out; a null id is neither held out nor learnt
    from. A text that is null or without letters, or any text where nothing could be learnt, is ``und`` with
    score 0. Equal scores take the first name. Repeated rows are all counted and all answered; other columns
    are not read; an empty table gives no rows.
    """
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    parts = fitted(docs.where("doc_id is not null and lang is not null and text is not null and not held_out").select("doc_id", "lang", "text"), **bounds)
    sent = _Sent(docs.sparkSession.sparkContext.broadcast(parts), uuid.uuid4().hex)
    return docs.select("doc_id", "text", "held_out").mapInArrow(_predict(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return predicted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
