"""Quality rules: text statistics, and lines that many documents of one host repeat.

One pass over the texts gives the statistics and a hash of every distinct normalised line. Lines are
counted once per document and host; exact copies of a document count once, so a page that is copied often
does not turn into boilerplate. Lines in more documents than the limits allow are removed, and documents
that keep too little are rejected.

Counts are combined before the shuffle. The frequent lines are written out, so their size is known when
they are joined with the documents' lines; a host or line with a third of all rows is an ordinary join side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import _WHITE, free_name, ids_back, ids_of, saved, slices, small_batches, texts_of, window_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_CHAR = ~_WHITE & ((np.arange(256) & 0xC0) != 0x80)
LINES = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))
STATS = (
    "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "text_a long, text_b long, lines array<struct<h: long, n: long>>"
)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_key(line: bytes) -> tuple[int, int] | None:
    """Hash and word count of a line: A-Z in lower case, one space between words; None without words."""
    words = line.lower().split()
    return (_signed(xxhash.xxh64_intdigest(b" ".join(words))), len(words)) if words else None


def _lines(text: bytes) -> tuple[int, list[dict]]:
    """Lines equal to an earlier line, and the words in each distinct normalised line."""
    seen, repeats, words = set(), 0, {}
    for line in text.split(b"\n"):
        key = line_key(line)
        if key is None:
            continue
        if line in seen:
            repeats += 1
        else:
            seen.add(line)
        words[key[0]] = words.get(key[0], 0) + key[1]
    return repeats, [{"h": h, "n": n} for h, n in words.items()]


def _repeated_words(words: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For each text, words in windows of three that the text holds twice or more."""
    marks = np.zeros(len(words) + 1, np.int64)
    windows = window_hashes(words, 3)
    if len(windows):
        text = np.searchsorted(cut, np.arange(len(windows)), "right") - 1
        inside = np.flatnonzero(np.arange(len(windows)) + 3 <= cut[text + 1])
        keys = windows[inside] ^ (text[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        at = inside[order[np.append(same, False) | np.append(False, same)]]
        for i in range(3):
            marks[at + i] = 1
    total = np.concatenate([[0], np.cumsum(marks[:-1])])
    return total[cut[1:]] - total[cut[:-1]]


def measured(texts: list[bytes]) -> np.ndarray:
    """Per text: words, characters in words, symbols, words in repeated windows of three."""
    numbers = []
    for a, b in slices(np.array([len(t) for t in texts], np.int64)):
        buf = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
        starts, _, words = word_spans(buf, lower=False)
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        cut = np.searchsorted(starts, first)
        ends = np.minimum(first, len(buf))
        chars, symbols = (np.concatenate([[0], np.cumsum(table[buf])])[ends] for table in (_CHAR, _SYMBOL))
        numbers.append(np.stack([np.diff(cut), np.diff(chars), np.diff(symbols), _repeated_words(words, cut)]))
    return np.concatenate(numbers, axis=1) if numbers else np.empty((4, 0), np.int64)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids, texts, hosts = ids_of(batch.column(0)), texts_of(batch.column(1)), batch.column(2).fill_null("")
        n_words, chars, symbols, repeats = measured(texts)
        lines = [_lines(t) for t in texts]
        keys = [xxhash.xxh3_128_intdigest(t) for t in texts]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(row, row + len(texts))), ids_back(ids), hosts, *(pa.array(x, pa.int64()) for x in (n_words, chars, symbols)),
            pa.array([n for n, _ in lines], pa.int64()), pa.array(repeats, pa.int64()),
            pa.array([_signed(k >> 64) for k in keys], pa.int64()), pa.array([_signed(k & (1 << 64) - 1) for k in keys], pa.int64()),
            pa.array([x for _, x in lines], LINES),
        ], ["row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_a", "text_b", "lines"])
        row += len(texts)


def frequent_lines(stats: DataFrame, max_share: float, least_docs: int) -> DataFrame:
    """(host, h): lines in more than ``max_share`` of a host's distinct documents, and more than ``least_docs``."""
    copies = saved(stats.groupBy("host", "text_a", "text_b").agg(F.min("row").alias("row")).select("host", "row"))
    limits = copies.groupBy("host").agg(F.greatest(F.lit(float(least_docs)), F.count("*") * max_share).alias("limit"))
    counts = stats.select("row", "host", "lines").join(copies.select("row"), "row", "left_semi").select("host", F.explode("lines.h").alias("h"))
    counts = counts.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    return counts.join(limits, "host").where("n > limit").select("host", "h")


def _prepared(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_share: float, least_docs: int) -> tuple[DataFrame, DataFrame]:
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"))
    stats = saved(texts.mapInArrow(_stats, STATS))
    return stats, saved(frequent_lines(stats, max_share, least_docs))


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_share: float = 0.1, least_docs: int = 20,
    least_words: int = 50, least_kept_share: float = 0.5,
) -> DataFrame:
    """The verdict on every document.

    Rows: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words (words in
    removed lines), base_failed, kept. A document fails the base rules with fewer than ``least_words`` words or
    with more than half of them in repeated windows of three; it is depleted when removal leaves less
    than ``least_kept_share`` of its words. Null texts have no words, a null host is
    the nameless one, null ids stay null. Repeated rows are judged alike. An empty table gives no rows.
    """
    stats, frequent = _prepared(docs, id_col, text_col, host_col, max_share, least_docs)
    lines = stats.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    lost = lines.join(frequent, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("lost_words"))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("lost_words")
    out = stats.drop("lines", "text_a", "text_b").join(lost, "row", "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)))
    out = out.withColumn("base_failed", base).withColumn(
        "kept", ~base & ((left >= least_kept_share * F.col("n_words"))),
    )
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept",
    )


def filtered(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_share: float = 0.1, least_docs: int = 20,
    least_words: int = 50, least_kept_share: float = 0.5,
) -> DataFrame:
    """``docs`` without the documents that ``judged`` rejects, and without the frequent lines of their host in the others.

    All columns stay, whatever their names. Every document is judged in place: it meets its host's frequent lines, of which there
    are few, for each stands in a share of the host's documents. Null and empty texts have no words and go; a null host is the
    nameless one; null ids stay null, repeated rows are judged alike and all stay; an empty table gives no rows.
    """
    _, frequent = _prepared(docs, id_col, text_col, host_col, max_share, least_docs)
    columns = docs.columns
    host, lines = free_name(columns, "_host"), free_name(columns, "_lines")
    per_host = frequent.groupBy(F.col("host").alias(host)).agg(F.collect_set("h").alias(lines))
    joined = docs.join(per_host, F.coalesce(F.col(host_col).cast("string"), F.lit("")) == F.col(host), "left")
    place = columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = texts_of(batch.column(place)), []
            n_words, _, _, repeats = measured(texts)
            changed = batch.column(place).to_pylist()
            for i, (text, n, r, gone) in enumerate(zip(texts, n_words.tolist(), repeats.tolist(), batch.column(len(columns) + 1).to_pylist())):
                if n < least_words or 100 * r > 50 * n:
                    continue
                if gone:
                    lines = [(line, line_key(line)) for line in text.split(b"\n")]
                    lost = sum(k[1] for _, k in lines if k and k[0] in gone)
                    if n - lost < least_kept_share * n:
                        continue
                    if lost:
                        changed[i] = b"\n".join(x for x, k in lines if not (k and k[0] in gone)).decode()
                keep.append(i)
            rows = batch.select(columns).set_column(place, columns[place], pa.array(changed, pa.string()))
            yield rows.take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(cut, docs.schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
