"""Helpers the operators share: folders, written tables, batches of texts, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside arrays; it sorts before every other id.
NULL_ID = np.iinfo(np.int64).min
#: Bytes of text handled at once; the arrays made from a slice stay in the processor's cache.
SLICE_BYTES = 1 << 19
BATCH_BYTES = str(4 << 20)

_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names in ``spark.checkpoint.dir``.

    Only a local session, whose tasks run on this machine, may leave it unset.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="rillflow-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/rillflow-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete what ``saved`` wrote there, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def saved(df: DataFrame, tidy: bool = False, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back; its lineage ends there. With ``tidy`` the shuffle files that
    the write needed go with it, where Spark can do that (4.1). ``path`` is a folder of the caller's, who may remove it."""
    path, conf = path or work_dir(df.sparkSession), df.sparkSession.conf
    before = conf.get(_TIDY, None)
    try:
        if tidy:
            conf.set(_TIDY, "true")
        df.write.parquet(path)
    finally:
        if tidy:
            conf.unset(_TIDY) if before is None else conf.set(_TIDY, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands Python its rows in batches of a few megabytes, however long the texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, or one like it that no column has, in whatever case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def narrowed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id as long and the text, by position: other columns may have any names."""
    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()


def slices(lens: Sequence[int] | np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together; a longer text is alone."""
    start, size = 0, 0
    for i, n in enumerate(lens):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lens):
        yield start, len(lens)


def mixed(h: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values from 64-bit values, in place."""
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, zeros after the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf),), "<u8", padded.data, 0, (1,)).astype(np.uint64)


def word_spans(buf: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space in texts joined by it, and a hash of each.

    The hash covers every byte: eight at a time, combined by position.
    """
    white = _WHITE[buf]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(buf) and not white[0]:
        edge = np.concatenate([[0], edge])
    if len(buf) and not white[-1]:
        edge = np.concatenate([edge, [len(buf)]])
    starts, ends = edge[0::2], edge[1::2]
    eight = words_at(_LOWER[buf] if lower else buf)
    left = ends - starts
    hashes = np.full(len(starts), U(0x9E3779B97F4A7C15), np.uint64)
    active = np.arange(len(starts))
    at, step = starts, U(0xC2B2AE3D27D4EB4F)
    while len(active):
        n = np.minimum(left, 8)
        part = eight[at] & ((U(1) << (n.astype(np.uint64) * U(8) - U(1)) << U(1)) - U(1))
        hashes[active] = mixed((hashes[active] + part + n.astype(np.uint64)) * step)
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    return starts, ends, hashes


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive values."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out *= U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
        out += hashes[i : len(hashes) - n + 1 + i]
    return mixed(out)
