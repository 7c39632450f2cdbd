"""Quality of a text by pairwise preferences: the Bradley-Terry model, the chance that one text is preferred to another is the
logistic function of the difference of their scores, and a score is a weighted sum of features of the text.

Features are shares of kinds of characters, word statistics and hashed runs of three bytes. They are computed where the texts
lie; only they, packed, meet the labels, and are written once for every labelled document. The loss is over all pairs of a good
and a bad document: how many of either kind have which score, on a fine grid, gives each document's pull, so a step is two
passes over the features that bring back a few numbers per task. A document is accepted above the quantile of the scores of all
labelled documents that leaves out as many as the labels call bad. Every text is scored in place by its own features, in one
pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import ids_back, ids_of, narrowed, saved, slices, texts_of
from rillflow.llm.quality import measured

#: Hashed features, steps of descent at most, those remembered, weight of the penalty, slope to stop at.
HASHED, ROUNDS, MEMORY, PENALTY, LEVEL = 512, 40, 10, 1e-3, 1e-5
#: Scores between which the loss is linear.
GRID = np.linspace(-64, 64, 8193)
#: The score at the threshold.
ACCEPTED = 0.3
KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b"!", b"?", b",;:", b"|", b"#*$%&<>", b"()[]{}\"'", b"\n", b" \t", bytes(range(128, 256)))
_KIND = np.stack([np.isin(np.arange(256), np.frombuffer(k, np.uint8)) for k in KINDS]).astype(np.float64)
SHAPES = len(KINDS) + 5
U, U64 = np.uint32, np.uint64


def _histogram(document: np.ndarray, values: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.bincount(document * width + values, minlength=n * width).reshape(n, width).astype(np.float64)


def features(texts: list[bytes]) -> np.ndarray:
    """One row a text: shares of each kind of bytes, words and their lengths, symbols, repeated words, then hashed runs of three bytes."""
    rows = np.empty((len(texts), SHAPES + HASHED))
    words, chars, symbols, repeats = measured(texts).astype(np.float64)
    for a, b in slices(np.array([len(t) for t in texts], np.int64)):
        lens = np.array([len(t) for t in texts[a:b]], np.int64)
        buf = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        document = np.repeat(np.arange(b - a), lens)
        size = np.maximum(lens, 1)[:, None]
        rows[a:b, : len(KINDS)] = np.sqrt(_histogram(document, buf, b - a, 256) @ _KIND.T / size)
        wide = buf.astype(U)
        runs = ((wide[:-2] << U(16) | wide[1:-1] << U(8) | wide[2:]) * U(0x9E3779B1) >> U(16)) % U(HASHED) if len(buf) > 2 else np.empty(0, U)
        inside = document[:-2] == document[2:] if len(buf) > 2 else np.empty(0, bool)
        rows[a:b, SHAPES:] = np.sqrt(_histogram(document[:-2][inside] if len(buf) > 2 else document[:0], runs[inside].astype(np.int64), b - a, HASHED) / size)
    n = np.maximum(words, 1)
    lens = np.array([len(t) for t in texts], np.float64)
    rows[:, len(KINDS) : SHAPES] = np.stack([np.log1p(words), np.log1p(lens) / 4, chars / n / 8, np.sqrt(symbols / n), repeats / n], axis=1)
    return rows


class Model(NamedTuple):
    mean: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; ``ACCEPTED`` at the threshold."""
        raw = (rows - self.mean) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + np.log(ACCEPTED / (1 - ACCEPTED)), -700, 700)))


#: Joins what a function of features and labels gives for each part of the labelled documents.
Over = Callable[..., np.ndarray]


def _places(s: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Bad and good documents at each score of the grid; between two scores a document counts in parts."""
    at = np.clip((s - GRID[0]) / (GRID[1] - GRID[0]), 0, len(GRID) - 1.000001)
    low = at.astype(np.int64)
    out = [np.bincount(low[mine], 1 - (at - low)[mine], len(GRID)) + np.bincount(low[mine] + 1, (at - low)[mine], len(GRID)) for mine in (labels == 0, labels == 1)]
    return np.stack(out)


def _surprise(bad: np.ndarray, good: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs, and the mean surprise of a bad and of a good document at each score of the grid."""
    lose, win = np.flatnonzero(bad), np.flatnonzero(good)
    b, g = bad[lose] / bad.sum(), good[win] / good.sum()
    loss, of_bad, of_good = 0.0, np.zeros(len(GRID)), np.zeros(len(GRID))
    for k in range(0, len(win), 256):
        apart = np.clip(GRID[lose][:, None] - GRID[win[k : k + 256]], -700, 700)
        chance = 1 / (1 + np.exp(-apart))
        loss += float(b @ np.logaddexp(0, apart) @ g[k : k + 256])
        of_bad[lose] += chance @ g[k : k + 256]
        of_good[win[k : k + 256]] = b @ chance
    return loss, of_bad, of_good


def _descended(over: Over, width: int, mean: np.ndarray, spread: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """Weights of the least loss, by the limited-memory BFGS method."""

    def places(w: np.ndarray) -> np.ndarray:
        return over(lambda rows, labels: _places((rows - mean) / spread @ w, labels).ravel()).reshape(2, -1)

    def slope(w: np.ndarray, of_bad: np.ndarray, of_good: np.ndarray) -> np.ndarray:
        def pull(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
            x = (rows - mean) / spread
            s = x @ w
            return x.T @ np.where(labels == 0, np.interp(s, GRID, of_bad) / n_bad, -np.interp(s, GRID, of_good) / n_good)

        return over(pull) + PENALTY * w

    def judged(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, of_bad, of_good = _surprise(*places(w))
        return loss + PENALTY * float(w @ w) / 2, of_bad, of_good

    w = np.zeros(width)
    loss, *surprises = judged(w)
    g, steps = slope(w, *surprises), []
    for _ in range(ROUNDS):
        if np.abs(g).max() < LEVEL:
            break
        way, used = -g, []
        for step, turn in reversed(steps):
            used.append(step @ way / (step @ turn))
            way = way - used[-1] * turn
        way = way * (steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(g))))
        for (step, turn), a in zip(steps, reversed(used)):
            way = way + (a - turn @ way / (step @ turn)) * step
        size = 1.0
        while True:
            tried, *surprises = judged(w + size * way)
            if tried <= loss + 1e-4 * size * float(g @ way) or size < 1e-3:
                break
            size /= 2
        if tried >= loss:
            break
        after = slope(w + size * way, *surprises)
        if (after - g) @ way > 0:
            steps = [*steps[1 - MEMORY :], (size * way, after - g)]
        w, g, loss = w + size * way, after, tried
    return w


def _keys(s: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores."""
    bits = (s + 0.0).view(np.uint64)
    return np.where(bits >> U64(63) == 1, ~bits, bits | U64(1 << 63))


def _threshold(over: Over, scores: Callable[[np.ndarray], np.ndarray], weight: np.ndarray, share: float) -> float:
    """The middle between the least score up to which ``share`` of the weight of all documents lies, and the next one.

    The score is found twelve bits at a time by counts of bad and good documents, so equal scores are no burden.
    """
    prefix, below = 0, 0.0
    for shift, past in ((52, 64), (40, 52), (28, 40), (16, 28), (4, 16), (0, 4)):
        width = 1 << past - shift

        def counts(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
            keys = _keys(scores(rows))
            mine = keys >> U64(past) == U64(prefix) if past < 64 else np.ones(len(keys), bool)
            place = (keys[mine] >> U64(shift) & U64(width - 1)).astype(np.int64)
            return np.bincount(labels[mine] * width + place, minlength=2 * width).astype(np.float64)

        got = weight @ over(counts).reshape(2, width)
        at = min(int(np.searchsorted(below + np.cumsum(got), share - 1e-9)), int(np.flatnonzero(got)[-1]))
        prefix, below = prefix << past - shift | at, below + float(got[:at].sum())

    def ends(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        s, keys = scores(rows), _keys(scores(rows))
        k = U64(prefix)
        # the greatest of -next, own score and the one before
        return np.array([-s[keys > k].min(initial=np.inf), s[keys == k].max(initial=-np.inf), s[keys < k].max(initial=-np.inf)])

    after, own, before = over(ends, np.maximum) * (-1, 1, 1)
    other = after if np.isfinite(after) else before if np.isfinite(before) else own
    return float(own + other) / 2


def _model(over: Over, bad_share: float) -> Model:
    width = SHAPES + HASHED

    def moments(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return np.concatenate([[(labels == 0).sum(), (labels == 1).sum()], rows.sum(0), (rows * rows).sum(0)])

    n_bad, n_good, *sums = over(moments)
    n = max(n_bad + n_good, 1)
    mean = np.array(sums[:width]) / n
    spread = np.sqrt(np.maximum(np.array(sums[width:]) / n - mean * mean, 0)) + 1e-3
    if not n_bad or not n_good:
        return Model(mean, np.zeros(width), 1.0 if n_bad else -1.0)
    w = _descended(over, width, mean, spread, n_bad, n_good) / spread

    def spans(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        s = (rows - mean) @ w
        return np.array([s.sum(), s @ s])

    total, square = over(spans) / n
    w = w / (max(np.sqrt(max(square - total * total, 0)), 1e-9) / 3)
    return Model(mean, w, _threshold(over, lambda rows: (rows - mean) @ w, np.array([bad_share / n_bad, (1 - bad_share) / n_good]), bad_share))


def fitted(rows: np.ndarray, labels: np.ndarray, bad_share: float) -> Model:
    """Weights from all pairs of a good and a bad row; the threshold leaves out ``bad_share`` of the labelled documents.

    Labels of one kind only give no pairs: all weights are 0, and all documents are accepted, or none if all are bad.
    """
    return _model(lambda of, join=np.add: of(rows, labels), bad_share)


def _known(docs: DataFrame, labels: DataFrame, fit_docs: int | None) -> tuple[DataFrame, float]:
    """Features and labels of the labelled documents, written, and the share of bad ones among all labelled."""
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = saved(docs.select("doc_id").join(marks.distinct(), "doc_id").distinct())
    sizes = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if fit_docs is not None:
        few = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(fit_docs) for k in (0, 1)]
        known = few[0].unionByName(few[1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pack = features(texts_of(batch.column(1))).astype(np.float32), zstandard.ZstdCompressor().compress
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(r.tobytes()) for r in rows], pa.binary())], ["doc_id", "row"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpack = zstandard.ZstdDecompressor().decompress
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unpack(r) for r in batch.column(1).to_pylist()], pa.binary())], ["quality", "row"])

    # The labels are never broadcast: the same plan at any size.
    read_rows = docs.where("doc_id IS NOT NULL").mapInArrow(read, "doc_id long, row binary")
    rows = saved(read_rows.join(known.hint("merge"), "doc_id").select("quality", "row").mapInArrow(opened, "quality int, row binary"))
    return rows, sizes.get(0, 0) / max(sum(sizes.values()), 1)


def _over(known: DataFrame) -> Over:
    """Parts are batches of the written features; of each task one array reaches the driver."""

    def over(of: Callable[[np.ndarray, np.ndarray], np.ndarray], join: Callable = np.add) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, SHAPES + HASHED).astype(np.float64)
                got = of(rows, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                total = got if total is None else join(total, got)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["total"])

        got = [np.frombuffer(r.total, np.float64) for r in known.mapInArrow(part, "total binary").collect()]
        return join.reduce(got) if got else of(np.empty((0, SHAPES + HASHED)), np.empty(0, np.int64))

    return over


def scored(docs: DataFrame, train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int | None = None) -> DataFrame:
    """``docs`` judged by a model fitted on ``train`` (rows of the same columns) and ``labels`` (doc_id, quality 0 or 1).

    Rows: doc_id, score from 0 to 1, predicted (1 from ``ACCEPTED`` on). A null or empty text has the features of the empty text; null ids are
    scored and never learned from; repeated rows score alike; labels that are null or neither 0 nor 1 are ignored, and documents
    with both count as both. All labelled documents are learned from, unless ``fit_docs`` bounds those of a label. Without labels of both kinds every text gets one score. Empty tables give no rows.
    """
    known, bad_share = _known(narrowed(train, id_col, text_col), labels, fit_docs)
    model = _model(_over(known), bad_share)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(features(texts_of(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [ids_back(ids_of(batch.column(0))), pa.array(score), pa.array((score >= ACCEPTED).astype(np.int32))], ["doc_id", "score", "predicted"],
            )

    return narrowed(docs, id_col, text_col).mapInArrow(judge, "doc_id long, score double, predicted int")


def held_out(doc_id) -> F.Column:
    """A fifth of the documents, by crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op13_quality_preference(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labelled ones that are not held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, docs.where(~held_out("doc_id")), labels)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
