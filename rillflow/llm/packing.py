"""Packing documents into windows of fixed length by the sum-of-squares rule.

Each task packs its documents as they come. A document's full windows stand alone; the rest goes to the
fill level for which the sum of the squared counts of partially filled windows becomes least, as the level
array tells. When ``OPEN`` windows are open, and at the end, the emptiest are cut up to fill the fullest, so
memory is bounded and at most one window of a task is padded. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rillflow.llm.common import ids_back, ids_of, narrowed, slices, texts_of
from rillflow.llm.encoding import encoder

OPEN = 1024
#: A piece: place of its document in the output order, first id, ids, ids of the document.
Piece = tuple[int, int, bytes, int]


class Levels:
    """Partially filled windows by fill level."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.open = 0

    def level_for(self, n: int) -> int:
        """The fill level (0: a new window) to which ``n`` ids go; among equals the fullest."""
        counts, last = self.counts, self.size - n
        # The change of the sum of squares: a level gets a window, another gives one up; full windows count no more.
        cost = 2 * counts[n:] + 1
        cost[last] = 0
        cost[1:] -= 2 * counts[1 : last + 1] - 1
        usable = counts[: last + 1] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return last - int(np.argmin(cost[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece into a window; the window, if that fills it."""
        n = len(piece[2]) // 4
        level = self.level_for(n)
        window = self.windows[level].pop() if level else []
        self.counts[level] -= level > 0
        self.open -= level > 0
        window.append(piece)
        if level + n == self.size:
            return window
        self.windows[level + n].append(window)
        self.counts[level + n] += 1
        self.open += 1
        return None

    def drained(self) -> list[list[Piece]]:
        """All open windows, the emptiest cut up to fill the fullest: at most the last is not full."""
        left = [(level, w) for level in range(self.size, 0, -1) for w in self.windows[level]]
        self.__init__(self.size)
        out: list[list[Piece]] = []
        i, j = 0, len(left) - 1
        while i <= j:
            level, window = left[i]
            while level < self.size and j > i:
                have, giver = left[j]
                doc, start, ids, total = giver.pop()
                take = min(self.size - level, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], total))
                level += take
                if 4 * take < len(ids):
                    giver.append((doc, start + take, ids[4 * take :], total))
                left[j] = (have - take, giver)
                if not giver:
                    j -= 1
            out.append(window)
            i += 1
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(vocabulary: str, end_id: int, size: int, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        levels, names = Levels(size), ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
        out: list[tuple] = []

        def close(window: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for key, start, ids, total in window:
                out.append((key, start, len(ids) // 4, crc32(ids), total, sequence, at, ids)[: 7 + with_ids])
                at += len(ids) // 4
            sequence += 1

        def ready() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [ids_back(np.array(cols[0], np.int64)), *(pa.array(c, pa.int64()) for c in cols[1:7]), *([pa.array(cols[7], pa.binary())] if with_ids else [])], names,
            )

        end = end_id.to_bytes(4, "little")
        for batch in batches:
            keys, texts = ids_of(batch.column(0)).tolist(), texts_of(batch.column(1))
            for a, b in slices([len(t) for t in texts]):
                for key, raw in zip(keys[a:b], encoder(vocabulary).encode([t.decode() for t in texts[a:b]])):
                    ids = raw + end
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        piece = (key, start, ids[4 * start : 4 * (start + size)], total)
                        full = [piece] if start + size <= total else levels.place(piece)
                        if full:
                            close(full)
                    if levels.open >= OPEN:
                        *whole, last = levels.drained()
                        for window in whole:
                            close(window)
                        n = sum(len(p[2]) // 4 for p in last)
                        if n == size:
                            close(last)
                        else:
                            levels.windows[n].append(last)
                            levels.counts[n] += 1
                            levels.open += 1
                if out:
                    yield ready()
        for window in levels.drained():
            close(window)
        if out:
            yield ready()

    return rows


def packed(
    docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Rows, one per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for.

    A document is its text's ids and ``end_id``; each id lies in one piece, and the pieces of a sequence
    follow each other without gaps up to ``size`` ids. A null text is empty and still has its end id; repeated rows are packed each; other
    columns are not read; an empty table gives no rows. ``vocabulary`` is a file of the tokenizers library
    that every executor can read.
    """
    return narrowed(docs, id_col, text_col).mapInArrow(_pack(vocabulary, end_id, size, with_ids), PIECES + ", ids binary" * with_ids)


def op9_pack_documents(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
