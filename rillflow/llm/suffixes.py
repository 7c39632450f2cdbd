"""Exact removal of repeated byte strings by suffix arrays, built one bucket of suffixes at a time.

Two texts that share ``min_bytes`` consecutive bytes share the gram with the least hash inside them, so
all suffixes that could agree for that long fall into the bucket of that gram. The corpus is written
once as chunks. Grams found in one document only cannot repeat and are dropped; the strings around the
others are dealt by bucket, each distinct string once per chunk. A task sorts its buckets one after the
other: suffixes by their first eight bytes, longer ties by precomputed ranks of the suffixes at the
places of a difference cover (for any two places there is a shift of at most six that brings both into
the cover). Runs of suffixes with a common prefix of ``min_bytes`` bytes give the smallest document of
each string, and one bit per string place goes back to the chunk.

Memory: a chunk, or the distinct strings of one bucket. A passage in a third of all documents is one
string per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import NULL_ID, U, ids_back, ids_of, mixed, narrowed, saved, slices, small_batches, texts_of, words_at

#: Difference cover modulo 7: every difference of places is a difference of two of these.
COVER, PERIOD = (0, 1, 3), 7
#: SHIFTS[a][b]: the least shift that brings places of both remainders into the cover.
SHIFTS = [[next(s for s in range(7) if (a + s) % 7 in COVER and (b + s) % 7 in COVER) for b in range(7)] for a in range(7)]
CHUNK_BYTES = 8 << 20
#: Text bytes for each bucket of grams, and of strings.
GRAM_BUCKET, STRING_BUCKET = 6 << 20, 2 << 20

CHUNK = "chunk long, ids binary, lens binary, body binary, rest binary"
ROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])
MARK = pa.schema([("chunk", pa.int64()), ("kind", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary())])


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _rows(batches: list[pa.RecordBatch]) -> bytes:
    """Rows of other columns as an Arrow stream; nothing where there are none."""
    if not batches[0].num_columns:
        return b""
    table = pa.Table.from_batches(batches).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    held, size = [], 0

    def row() -> pa.RecordBatch:
        held.sort(key=lambda x: x[0])
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([(part << 32) + number], pa.int64()),
            "ids": [np.array([x[0] for x in held], np.int64).tobytes()],
            "lens": [np.array([len(x[1]) for x in held], np.int64).tobytes()],
            "body": [_pack(b"".join(x[1] for x in held))],
            "rest": [_pack(_rows([x[2] for x in held]))],
        })

    for batch in batches:
        rest = batch.select(batch.schema.names[2:])
        for i, (key, text) in enumerate(zip(ids_of(batch.column(0)).tolist(), texts_of(batch.column(1)))):
            if held and size + len(text) > CHUNK_BYTES:
                yield row()
                held, size, number = [], 0, number + 1
            held.append((key, text, rest.slice(i, 1)))
            size += len(text)
    if held:
        yield row()


def chunked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents in chunks of about 8 MB, by id inside a chunk, written to the shared folder."""
    return saved(docs.mapInArrow(_chunks, CHUNK), path=path)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64), _unpack(row["body"])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    rest = width - done
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def gram_runs(lens: np.ndarray, body: bytes, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows of ``width`` bytes with one least gram: start, past the last start, text, gram hash."""
    gram = 8 * (width // 16)
    first = np.concatenate([[0], np.cumsum(lens)])
    for a, b in slices(lens):
        base, size = int(first[a]), int(first[b] - first[a])
        if size < width:
            continue
        eight = words_at(np.frombuffer(body, np.uint8, size, base))
        n = size - gram + 1
        h = eight[:n] * U(0x9E3779B97F4A7C15)
        for i in range(8, gram, 8):
            h ^= h >> U(31)
            h += eight[i : i + n]
            h *= U(0xC2B2AE3D27D4EB4F)
        h ^= h >> U(29)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
        least = _least(h, width - gram + 1)
        starts, ends = first[a:b] - base, first[a + 1 : b + 1] - base
        long = ends - starts >= width
        starts, ends = starts[long], ends[long]
        if not len(starts):
            continue
        cut = np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, starts, ends - width + 1])
        cut = np.unique(cut[cut < len(least)])
        text = np.searchsorted(starts, cut, "right") - 1
        keep = (text >= 0) & (cut + width <= ends[text])
        past = np.append(cut[1:], len(least))
        yield cut[keep] + base, past[keep] + base, np.flatnonzero(long)[text[keep]] + a, least[cut[keep]]


def _gram_rows(width: int, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lens, body = _opened(row)
                yield _by_bucket(row["chunk"], *_chunk_grams(ids, lens, body, width), buckets)

    return rows


def _chunk_grams(ids, lens, body, width) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a chunk in order, and whether several ids have it."""
    got = [(grams, ids[text]) for _, _, text, grams in gram_runs(lens, body, width)]
    if not got:
        return np.empty(0, np.uint64), np.empty(0, bool)
    grams, owner = np.concatenate([g for g, _ in got]), np.concatenate([o for _, o in got])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.append(True, grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    return grams[at], np.logical_or.reduceat(np.append(False, (owner[1:] != owner[:-1]) & ~new[1:]), at)


def _split(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each bucket's first gram in order; buckets are ranges of hashes."""
    cuts = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    at = np.searchsorted(grams, cuts)
    return np.concatenate([[0], at]), np.concatenate([at, [len(grams)]])


def _by_bucket(chunk: int, grams: np.ndarray, several: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Five bytes of each gram's hash are enough to find repeats: a false one costs time only."""
    lo, hi = _split(grams, buckets)
    five = (grams >> U(8)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    kept = [(b, i, j) for b, (i, j) in enumerate(zip(lo.tolist(), hi.tolist())) if j > i]
    return pa.RecordBatch.from_arrays([
        pa.array([b for b, _, _ in kept], pa.int64()), pa.array([chunk] * len(kept), pa.int64()),
        pa.array([np.packbits(several[i:j]).tobytes() + five[i:j].tobytes() for _, i, j in kept], pa.binary()),
    ], schema=ROW)


def _repeated(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket: which of its grams occur in two documents or more."""
    several, grams, sizes = [], [], []
    for body in table.column("body").to_pylist():
        n = next(n for n in (len(body) * 8 // 41 + d for d in (-1, 0, 1)) if n > 0 and (n + 7) // 8 + 5 * n == len(body))
        raw = np.frombuffer(body, np.uint8)
        several.append(np.unpackbits(raw[: (n + 7) // 8], count=n).astype(bool))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, 3:] = raw[(n + 7) // 8 :].reshape(n, 5)
        grams.append(wide.reshape(-1).view(">u8").astype(np.uint64))
        sizes.append(n)
    every, own = np.concatenate(grams), np.concatenate(several)
    order = np.argsort(every, kind="stable")
    new = np.append(True, every[order][1:] != every[order][:-1])
    group = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    repeated = (np.diff(np.append(at, len(every))) > 1) | np.logical_or.reduceat(own[order], at)
    out = np.empty(len(every), bool)
    out[order] = repeated[group]
    ends = np.cumsum(sizes)
    return pa.Table.from_arrays([
        table.column("chunk"), pa.array([0] * len(sizes), pa.int64()), table.column("bucket"),
        pa.array([np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, sizes)], pa.binary()),
    ], schema=MARK)


def _strings(row: dict, marks: list[dict], width: int, buckets: int):
    """The strings of a chunk's repeated grams: (start, end, id, number of the string), and the distinct strings
    in order of number with their bucket, smallest id and count of windows."""
    ids, lens, body = _opened(row)
    got = list(gram_runs(lens, body, width))
    grams = np.unique(np.concatenate([g[3] for g in got])) if got else np.empty(0, np.uint64)
    lo, hi = _split(grams, buckets)
    repeated = np.zeros(len(grams), bool)
    for m in marks:
        i, j = int(lo[m["bucket"]]), int(hi[m["bucket"]])
        repeated[i:j] = np.unpackbits(np.frombuffer(m["body"], np.uint8), count=j - i).astype(bool)
    known: dict[bytes, int] = {}
    places, gram_of, least = [], [], []
    for start, past, text, gram in got:
        keep = repeated[np.searchsorted(grams, gram)]
        for s, e, key, g in zip(start[keep].tolist(), (past[keep] + width - 1).tolist(), ids[text[keep]].tolist(), gram[keep].tolist()):
            number = known.setdefault(body[s:e], len(known))
            if number == len(gram_of):
                gram_of.append(g)
                least.append(key)
            places.append((s, e, key, number))
    return ids, lens, body, places, list(known), np.array(gram_of, np.uint64), np.array(least, np.int64)


def _string_bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return mixed(gram.copy()) % U(buckets)


def _send(width: int, gram_buckets: int, buckets: int):
    def rows(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        out = {"bucket": [], "chunk": [], "body": []}
        for row in chunk.to_pylist():
            *_, strings, gram, least = _strings(row, marks.to_pylist(), width, gram_buckets)
            bucket = _string_bucket(gram, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else []
            for i, j in zip(cuts, [*cuts[1:], len(order)]):
                mine = order[i:j]
                texts = [strings[k] for k in mine.tolist()]
                head = np.array([len(texts)], np.int64).tobytes() + np.array([len(t) for t in texts], np.int32).tobytes()
                out["bucket"].append(int(bucket[mine[0]]))
                out["chunk"].append(row["chunk"])
                out["body"].append(_pack(head + least[mine].tobytes() + b"".join(texts)))
        return pa.table(out, schema=ROW)

    return rows


def cover_ranks(buf: np.ndarray, depth: int) -> np.ndarray:
    """At the places of the difference cover: the rank of the next ``depth`` bytes or more; elsewhere 0.

    Seven bytes are ranked first; each round doubles the length from the ranks at the place and one
    length further on, which is in the cover as well.
    """
    n = len(buf)
    place = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    key = words_at(buf).byteswap()[place] >> U(8)
    length = PERIOD
    ranks = np.zeros(n + 2 * depth + 2 * PERIOD, np.int64)
    while True:
        order = np.argsort(key)
        new = np.append(True, key[order][1:] != key[order][:-1])
        ranks[place[order]] = np.cumsum(new)
        if length >= depth:
            return ranks
        key = ranks[place].astype(np.uint64) << U(32) | ranks[place + length].astype(np.uint64)
        length *= 2


def sorted_suffixes(buf: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in an order in which equal prefixes of ``depth`` bytes stand together and are ordered."""
    key = words_at(buf).byteswap()[places]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    tied = np.bincount(group)[group] > 1
    if depth <= 8 or not tied.any():
        return places[order]
    ranks = cover_ranks(buf, depth)
    at, of = places[order[tied]], group[tied]
    wide = np.int64(len(buf) + 1)
    first = np.concatenate([[0], np.cumsum(np.bincount(of))])
    rest = at % PERIOD
    before = np.zeros(len(at), np.int64)
    members = [np.flatnonzero(rest == r) for r in range(PERIOD)]
    for theirs in range(PERIOD):
        if not len(members[theirs]):
            continue
        known: dict[int, np.ndarray] = {}
        group_start = np.searchsorted(of[members[theirs]], np.arange(len(first)))
        for mine in range(PERIOD):
            shift = SHIFTS[mine][theirs]
            if shift not in known:
                known[shift] = np.sort(of[members[theirs]] * wide + ranks[at[members[theirs]] + shift])
            i = members[mine]
            before[i] += np.searchsorted(known[shift], of[i] * wide + ranks[at[i] + shift]) - group_start[of[i]]
    final = np.argsort(of * wide + before, kind="stable")
    out = order.copy()
    out[tied] = order[tied][final]
    return places[out]


def agree(buf: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` bytes at both places are equal."""
    eight = words_at(buf)
    same = np.ones(len(a), bool)
    for off in [*range(0, width - 8, 8), width - 8]:
        i = np.flatnonzero(same)
        same[i] = eight[a[i] + off] == eight[b[i] + off]
    return same


def _sort_bucket(width: int):
    def rows(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        least: list[int] = []
        sent = []
        for body in table.column("body").to_pylist():
            raw = _unpack(body)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            lens = np.frombuffer(raw, np.int32, n, 8)
            own = np.frombuffer(raw, np.int64, n, 8 + 4 * n) if n % 2 == 0 else np.frombuffer(raw[8 + 4 * n : 8 + 12 * n], np.int64)
            at, numbers = 8 + 12 * n, np.empty(n, np.int64)
            for i, (size, key) in enumerate(zip(lens.tolist(), own.tolist())):
                number = known.setdefault(raw[at : at + size], len(known))
                at += size
                if number == len(least):
                    least.append(key)
                elif key < least[number]:
                    least[number] = key
                numbers[i] = number
            sent.append((numbers, own))
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        buf = np.frombuffer(b"".join(known), np.uint8)
        first, windows = np.cumsum(sizes) - sizes, sizes - width + 1
        # The windows of all strings in a row, and where each string's begin there.
        begin = np.cumsum(windows) - windows
        places = np.arange(windows.sum()) + np.repeat(first - begin, windows)
        smallest = _smallest(buf, places, np.repeat(np.array(least, np.int64), windows), begin, windows, width)
        out = []
        for numbers, own in sent:
            n = windows[numbers]
            at = np.arange(n.sum()) + np.repeat(begin[numbers] - (np.cumsum(n) - n), n)
            out.append(_pack(np.packbits(smallest[at] < np.repeat(own, n)).tobytes()))
        return pa.Table.from_arrays(
            [table.column("chunk"), pa.array([1] * len(out), pa.int64()), table.column("bucket"), pa.array(out, pa.binary())], schema=MARK,
        )

    return rows


def _smallest(buf, places, owner, begin, windows, width) -> np.ndarray:
    """The smallest owner of the string at each place."""
    order = sorted_suffixes(buf, places, width)
    # Places rise with the windows, so a place's window is found by search.
    window = np.searchsorted(places, order)
    new = np.append(True, ~agree(buf, order[:-1], order[1:], width))
    run = np.cumsum(new) - 1
    out = np.empty(len(places), np.int64)
    out[window] = np.minimum.reduceat(owner[window], np.flatnonzero(new))[run]
    return out


def _removed(chunk: pa.Table, marks: pa.Table, width: int, gram_buckets: int, buckets: int):
    """Per document of the chunk: id, text bytes, removed spans as (start, end) in the text."""
    for row in chunk.to_pylist():
        every = marks.to_pylist()
        ids, lens, body, places, strings, gram, least = _strings(row, [m for m in every if m["kind"] == 0], width, gram_buckets)
        windows = np.array([len(t) for t in strings], np.int64) - width + 1
        order = np.argsort(_string_bucket(gram, buckets), kind="stable")
        n = windows[order]
        begin = np.empty(len(order), np.int64)
        bits, at = [], 0
        bucket = _string_bucket(gram, buckets)[order]
        answers = {m["bucket"]: m["body"] for m in every if m["kind"] == 1}
        for b in np.unique(bucket).tolist():
            mine = np.flatnonzero(bucket == b)
            begin[order[mine]] = at + np.cumsum(n[mine]) - n[mine]
            size = int(n[mine].sum())
            bits.append(np.unpackbits(np.frombuffer(_unpack(answers[b]), np.uint8), count=size))
            at += size
        flags = np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)
        change = np.zeros(len(body) + 1, np.int32)
        if places:
            start, end, key, number = np.array(places, np.int64).T
            n = end - start - width + 1
            at = np.arange(n.sum()) + np.repeat(begin[number] - (np.cumsum(n) - n), n)
            hit = flags[at] | np.repeat(key > least[number], n)
            where = (np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n))[hit]
            np.add.at(change, where, 1)
            np.add.at(change, where + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        first = np.concatenate([[0], np.cumsum(lens)])
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            i, j = np.searchsorted(edge, a, "right"), np.searchsorted(edge, b, "left")
            inside = edge[i:j].tolist()
            inside = ([a] if b > a and gone[a] else []) + inside + ([b] if b > a and gone[b - 1] else [])
            yield int(ids[k]), body[a:b], [(x - a, y - a) for x, y in zip(inside[0::2], inside[1::2])]


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def _searched(docs: DataFrame, min_bytes: int):
    """Chunks by number, their marks, and a function from both to (id, text, spans) per document."""
    if min_bytes < 16:
        raise ValueError("min_bytes must be 16 or more")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    gram_buckets, buckets = max(32, -(-size // GRAM_BUCKET)), max(32, -(-size // STRING_BUCKET))
    chunks = chunked(docs)
    grams = chunks.mapInArrow(_gram_rows(min_bytes, gram_buckets), "bucket long, chunk long, body binary")
    mark = "chunk long, kind long, bucket long, body binary"
    found = saved(grams.groupBy("bucket").applyInArrow(_repeated, mark))
    by_chunk = chunks.groupBy("chunk")
    strings = by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(
        _send(min_bytes, gram_buckets, buckets), "bucket long, chunk long, body binary",
    )
    answers = strings.groupBy("bucket").applyInArrow(_sort_bucket(min_bytes), mark)
    marks = found.unionByName(answers).groupBy("chunk")
    return by_chunk.cogroup(marks), lambda chunk, marks: _removed(chunk, marks, min_bytes, gram_buckets, buckets)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50) -> DataFrame:
    """Byte spans of each text covered by strings of ``min_bytes`` that also start in a document with a smaller id.

    Rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes), spans. Matches never cross
    documents and are judged on the input. A null text is empty; a null id comes before all others; rows with
    the same id never count against each other; other columns are not read. An empty table gives no rows.
    """
    grouped, removed = _searched(narrowed(docs, id_col, text_col), min_bytes)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def report(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        out = []
        for key, text, spans in removed(chunk, marks):
            kept = hashlib.sha256(_without(text, spans)).hexdigest()
            out.append((key, len(text), sum(b - a for a, b in spans), len(spans), kept, [{"start": a, "end": b} for a, b in spans]))
        cols = list(zip(*out)) if out else [[]] * 6
        return pa.Table.from_arrays(
            [ids_back(np.array(cols[0], np.int64)), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], span)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )

    return grouped.applyInArrow(report, SPANS)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50) -> DataFrame:
    """``docs`` with the spans of ``repeated_spans`` cut from the texts; all rows and columns stay.

    A cut inside a character takes the rest of that character along. A null text becomes empty.
    """
    columns = docs.columns
    renamed = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c for c, n in zip(renamed, columns) if n != text_col])
    grouped, removed = _searched(texts, min_bytes)

    def cut(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        tables = []
        for row in chunk.to_pylist():
            kept = [_without(text, spans).decode("utf-8", "ignore") for _, text, spans in removed(chunk, marks)]
            rest = pa.ipc.open_stream(_unpack(row["rest"])).read_all() if row["rest"] else None
            cols = {n: pa.chunked_array([pa.array(kept, pa.string())]) if n == text_col else rest.column(f"c{i}") for i, n in enumerate(columns)}
            tables.append(pa.table(list(cols.values()), names=columns))
        return pa.concat_tables(tables)

    return grouped.applyInArrow(cut, docs.schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
