"""Benchmark passages in documents, found by a suffix automaton over all items.

Each task holds one automaton of the normalised items and streams the words of its documents through it:
the state after a word is the longest stretch of items that ends there. Where that is a window or longer,
or a whole shorter item, the words are hit. Only stretches of known words that are long enough to hold a
window are walked. Documents are not shuffled.

The items are broadcast, so their size is bounded: beyond ``PART_BYTES`` of item text they are dealt into
parts, searched one after the other; the hits so far travel with the rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import free_name, ids_back, ids_of, narrowed, saved, small_batches, texts_of

PART_BYTES = 1 << 20
#: A-Z in lower case; what is no digit, letter or byte of a wider character parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """The suffix automaton of several word sequences, and which items hold each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        sequences = []
        for name, text in items:
            sequence = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            if sequence:
                sequences.append((name, sequence))
                last = 0
                for word in sequence:
                    last = self._extend(last, word)
        #: Items whose windows end in a state, for states that hold strings of the window's length.
        self.items: list[set[str]] = [set() for _ in self.link]
        #: Whole items shorter than a window, by the state that holds them.
        own: dict[int, list[tuple[int, str]]] = {}
        self.least = min([window, *(len(s) for _, s in sequences)])
        for name, sequence in sequences:
            state = 0
            for i, word in enumerate(sequence, 1):
                state = self.step[state][word]
                if i >= window:
                    self.items[state].add(name)
            if len(sequence) < window:
                own.setdefault(state, []).append((len(sequence), name))
        order = sorted(range(1, len(self.link)), key=self.size.__getitem__)
        for state in reversed(order):
            up = self.link[state]
            if self.size[up] >= window:
                self.items[up] |= self.items[state]
        self.short: dict[int, list[tuple[int, str]]] = {}
        for state in order if own else ():
            every = own.get(state, []) + self.short.get(self.link[state], [])
            if every:
                self.short[state] = every

    def _add(self, size: int, step: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        return len(self.size) - 1

    def _part(self, state: int, word: int) -> int:
        """The state of exactly the longest string of ``state`` followed by ``word``, split off if needed."""
        target = self.step[state][word]
        if self.size[target] == self.size[state] + 1:
            return target
        twin = self._add(self.size[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = twin
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._part(last, word)
        new = self._add(self.size[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._part(state, word)
        return new

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words lie in an occurrence of a window, and the items with occurring windows."""
        n, found = len(words), set()
        if n < self.least or not self.number:
            return None, found
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, n)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], numbers >= 0, [False]]).astype(np.int8)))
        begins, ends = edge[0::2], edge[1::2]
        long = ends - begins >= self.least
        change = None
        step, link, size, window = self.step, self.link, self.size, self.window
        for a, b in zip(begins[long].tolist(), ends[long].tolist()):
            state = length = 0
            for i, word in enumerate(numbers[a:b].tolist(), a + 1):
                while state and word not in step[state]:
                    state = link[state]
                    length = size[state]
                if word in step[state]:
                    state, length = step[state][word], length + 1
                if length < self.least:
                    continue
                reach = 0
                if length >= window:
                    reach, at = length, state
                    while size[link[at]] >= window:
                        at = link[at]
                    found |= self.items[at]
                for k, name in self.short.get(state, ()):
                    if k <= length:
                        found.add(name)
                        reach = max(reach, k)
                if reach:
                    if change is None:
                        change = np.zeros(n + 1, np.int64)
                    change[i - reach] += 1
                    change[i] -= 1
        return (None if change is None else np.cumsum(change[:-1]) > 0), found


_BUILT: dict[bytes, Automaton] = {}


def _automaton(items: list[tuple[str, bytes]], window: int) -> Automaton:
    key = hashlib.sha256(repr((window, items)).encode()).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, window)
    return _BUILT[key]


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long, words: long>>"
SO_FAR = "doc_id long, text string, hit binary, items array<string>"


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as byte ranges."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    return [{"start": places[a][0], "end": places[b - 1][1], "words": b - a} for a, b in zip(edge[0::2], edge[1::2])]


def _search(sent, window: int, last: bool):
    """Adds the hits of one part of the items to those so far; the last part counts them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value, window)
        for batch in batches:
            out = []
            before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if batch.num_columns > 2 else repeat((None, []))
            for text, (bits, known) in zip(texts_of(batch.column(1)), before):
                words = words_of(text)
                hit, found = automaton.hits(words)
                if bits:
                    old = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                    hit = old if hit is None else hit | old
                names = sorted(found.union(known))
                if last:
                    out.append((len(words), 0 if hit is None else int(hit.sum()), names, [] if hit is None else _spans(text, hit)))
                else:
                    out.append((None if hit is None else np.packbits(hit).tobytes(), names))
            cols = list(zip(*out)) or [[]] * (4 if last else 2)
            ids, names = ids_back(ids_of(batch.column(0))), pa.list_(pa.string())
            if last:
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], names), pa.array(cols[3], SPAN)],
                    ["doc_id", "n_words", "n_hit", "items", "spans"],
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [ids, batch.column(1), pa.array(cols[0], pa.binary()), pa.array(cols[1], names)], ["doc_id", "text", "hit", "items"],
                )

    return rows


def _parts(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, part_bytes: int) -> list:
    """The items as broadcast parts of about ``part_bytes``; one empty part without items."""
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(item_text).cast("string").alias("text"))
    items = items.where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    mine = [items.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == part) for part in range(parts)]
    return [docs.sparkSession.sparkContext.broadcast(sorted((r["name"], r["text"].encode()) for r in one.toLocalIterator())) for one in mine]


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Rows: doc_id, n_words, n_hit, items (ids with occurring windows, sorted), spans (bytes and words of hit runs).

    A window is ``window`` consecutive words of an item, or a whole item of fewer words. Null texts have no
    words, items without words have no window; a null item id counts as the empty name. Repeated rows give
    repeated results, other columns are not read. No documents give no rows; no items give no hits.
    """
    docs = narrowed(docs, id_col, text_col)
    *before, last = _parts(docs, items, item_id, item_text, part_bytes)
    for sent in before:
        docs = saved(docs.mapInArrow(_search(sent, window, False), SO_FAR))
    return docs.mapInArrow(_search(last, window, True), FOUND)


def _cut(sent, window: int, columns: list[str], place: int, least_words: int, most_share: float, last: bool):
    """Adds one part's hits to the rows; after the last part the hit runs go from the texts, and with them the
    documents that are mostly hit."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value, window)
        for batch in batches:
            texts, changed, keep, bits = texts_of(batch.column(place)), batch.column(place).to_pylist(), [], []
            before = batch.column(len(columns)).to_pylist() if batch.num_columns > len(columns) else repeat(None)
            for i, (text, old) in enumerate(zip(texts, before)):
                words = words_of(text)
                hit, _ = automaton.hits(words)
                if old:
                    known = np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                    hit = known if hit is None else hit | known
                bits.append(None if hit is None else np.packbits(hit).tobytes())
                if not last or hit is None:
                    keep.append(i)
                    continue
                total = int(hit.sum())
                if total > most_share * len(words):
                    continue
                for span in reversed(_spans(text, hit)):
                    if span["words"] >= least_words or least_words <= window:
                        text = (text[: span["start"]].rstrip() + b" " + text[span["end"] :].lstrip()).strip()
                changed[i] = text.decode()
                keep.append(i)
            out = batch.select(columns)
            if last:
                yield out.set_column(place, columns[place], pa.array(changed, pa.string())).take(pa.array(keep, pa.int64()))
            else:
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(bits, pa.binary())], [*columns, free_name(columns, "_hit")])

    return rows


def decontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10,
    least_words: int = 10, most_share: float = 0.5, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``docs`` without their hit runs, and without the documents of whose words more than ``most_share`` are hit.

    A run is a window or a whole shorter item at least, so ``least_words`` spares shorter runs only where it is
    more than ``window``. All columns stay; other texts are not touched, null ones neither. Each row is judged by itself, in place.
    """
    columns = small_batches(docs).columns
    place = columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(free_name(columns, "_hit"), T.BinaryType())])
    *before, last = _parts(docs, items, item_id, item_text, part_bytes)
    for sent in before:
        marked = docs.mapInArrow(_cut(sent, window, columns, place, least_words, most_share, False), schema)
        docs = saved(marked)
    return docs.mapInArrow(_cut(last, window, columns, place, least_words, most_share, True), T.StructType(schema.fields[:-1]))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = contamination(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
