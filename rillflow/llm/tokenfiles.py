"""Token ids in compressed shards with one shared dictionary.

A zstandard dictionary is trained on the serialised ids of a bounded sample. Every document is a frame of its
own, compressed with that dictionary, so a short document is read without its neighbours. Shards are ranges
of document ids in ascending order; a shard's row holds its frames one after the other, the offset of each,
and the hash of the dictionary. Shards and dictionary are written as Parquet through Spark, so any
file system it knows will do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import ids_back, ids_of, narrowed, slices, texts_of, work_dir
from rillflow.llm.encoding import encoder

SAMPLE_DOCS, DICTIONARY_BYTES, SHARD_BYTES = 512, 64 << 10, 16 << 20
SHARD = "shard long, dictionary string, least_id long, largest_id long, n_docs long, n_tokens long, ids binary, counts binary, offsets binary, frames binary"


def serialised(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four, after a byte that tells which."""
    small = not len(ids) or ids.max() < 1 << 16
    return (b"\2" if small else b"\4") + ids.astype("<u2" if small else "<u4").tobytes()


def restored(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\2" else "<u4", offset=1).astype("<u4")


def _ids(texts: list[bytes], path: str, end_id: int) -> Iterator[np.ndarray]:
    end = np.array([end_id], "<u4")
    for a, b in slices([len(t) for t in texts]):
        for raw in encoder(path).encode([t.decode() for t in texts[a:b]]):
            yield np.concatenate([np.frombuffer(raw, "<u4"), end])


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialised id arrays; few or tiny samples are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data or b"\0" * 8)


def _frames(path: str, end_id: int, dictionary: bytes, bounds: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_content_size=True)
        for batch in batches:
            ids, counts, frames = ids_of(batch.column(0)), [], []
            for tokens in _ids(texts_of(batch.column(1)), path, end_id):
                counts.append(len(tokens))
                frames.append(packer.compress(serialised(tokens)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.searchsorted(bounds, ids, "left").astype(np.int64)), pa.array(ids), pa.array(counts, pa.int64()), pa.array(frames, pa.binary()),
            ], ["shard", "id", "n", "frame"])

    return rows


def _shard(name: str):
    def rows(table: pa.Table) -> pa.Table:
        # Rows of one id are ordered by their frames, so a second run writes the same shard.
        ids, frames = table.column("id").to_pylist(), table.column("frame").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], frames[i]))
        counts = table.column("n").to_numpy()[order].astype(np.int64)
        frames = [frames[i] for i in order]
        ids = np.array([ids[i] for i in order], np.int64)
        return pa.table({
            "shard": table.column("shard").slice(0, 1), "dictionary": pa.array([name]), "least_id": pa.array(ids[:1]), "largest_id": pa.array(ids[-1:]),
            "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([counts.sum()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "offsets": pa.array([np.cumsum([0, *map(len, frames)]).astype(np.int64).tobytes()], pa.binary()), "frames": pa.array([b"".join(frames)], pa.binary()),
        })

    return rows


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    sample_docs: int = SAMPLE_DOCS, shard_bytes: int = SHARD_BYTES,
) -> None:
    """Writes ``folder``/shards and ``folder``/dictionary: ids of every text and ``end_id``, by ascending id.

    ``vocabulary`` is a file of the tokenizers library that every executor can read. The dictionary comes from the
    ``sample_docs`` documents whose ids have the least hashes. A null text is empty, a null id comes first, rows that share
    an id are all written, an empty table gives no shards.
    """
    docs = narrowed(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chosen = [r[0] for r in docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    sample = [(r["text"] or "").encode() for r in docs.where(F.col("doc_id").isin(chosen)).orderBy("doc_id").limit(sample_docs).collect()] if chosen else []
    dictionary = trained([serialised(x) for x in _ids(sample, vocabulary, end_id)])
    name = hashlib.sha256(dictionary).hexdigest()
    shards = max(1, -(-size // shard_bytes))
    # One number for each shard but the last.
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / shards) for i in range(1, shards)]), 100 * shards)).first()[0] if shards > 1 else []
    spark = docs.sparkSession
    spark.createDataFrame([(name, bytearray(dictionary))], "name string, data binary").write.parquet(f"{folder}/dictionary")
    frames = docs.mapInArrow(_frames(vocabulary, end_id, dictionary, np.unique(np.array(bounds or [], np.int64))), "shard long, id long, n long, frame binary")
    frames.groupBy("shard").applyInArrow(_shard(name), SHARD).write.parquet(f"{folder}/shards")


def _opened(dictionary: bytes, name: str, starts: dict[int, int] | None, wanted: set[int] | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"shard {row['shard']} needs dictionary {row['dictionary']}, found {name}")
                ids, counts, offsets = (np.frombuffer(row[k], np.int64) for k in ("ids", "counts", "offsets"))
                before = np.cumsum(counts) - counts + (starts[row["shard"]] if starts else 0)
                out = []
                for i, (key, n, start, a, b) in enumerate(zip(ids.tolist(), counts.tolist(), before.tolist(), offsets.tolist(), offsets[1:].tolist())):
                    if wanted is not None and key not in wanted:
                        continue
                    tokens = restored(opener.decompress(row["frames"][a:b]))
                    if len(tokens) != n:
                        raise ValueError(f"document {key} in shard {row['shard']} holds {len(tokens)} ids, its index says {n}")
                    out.append((key, start, n, crc32(tokens.tobytes()), tokens.tobytes() if wanted is not None else None))
                cols = list(zip(*out)) or [[]] * 5
                arrays = [ids_back(np.array(cols[0], np.int64)), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if wanted is not None:
                    arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows


def _parts(spark, folder: str) -> tuple[DataFrame, str, bytes]:
    name, data = spark.read.parquet(f"{folder}/dictionary").first()
    return spark.read.schema(SHARD).parquet(f"{folder}/shards"), name, bytes(data)


def read_tokens(spark, folder: str) -> DataFrame:
    """Rows: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit little-endian ids)."""
    shards, name, data = _parts(spark, folder)
    starts, total = {}, 0
    for shard, n in shards.select("shard", "n_tokens").orderBy("shard").toLocalIterator():
        starts[shard], total = total, total + n
    return shards.mapInArrow(_opened(data, name, starts, None), "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch_tokens(spark, folder: str, ids: list[int]) -> DataFrame:
    """The documents of a few ids: shards are found by their id range, frames by their offset; ``ids`` holds 32-bit ids."""
    shards, name, data = _parts(spark, folder)
    near = [(F.col("least_id") <= i) & (F.col("largest_id") >= i) for i in ids]
    test = F.lit(False)
    for x in near:
        test = test | x
    found = shards.where(test).mapInArrow(_opened(data, name, None, set(ids)), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return found.drop("start")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_dir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, folder)
