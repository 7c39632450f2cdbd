"""Near-duplicate groups: universal hash minima, banding, verification, connected components.

1. A document's set of word shingles gives 128 minima, 32 band keys of four minima, and a 128-bit key of
   the set. Documents with equal sets are one class from here on.
2. Classes that share a band key are linked to the least of them: as many candidates as members. What
   agrees in enough minima is confirmed on the full sets; confirmed links give the first components.
3. A band that still holds several components may hide a link between two members that are not its
   least. Its members are compared by their minima, in pairs of blocks of bounded size, and a forest of
   the similar ones sent on; each tree with several components is confirmed on the full sets, again
   in blocks. Groups that step 2 has joined, whatever their size, never come here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import ids_back, ids_of, narrowed, saved, texts_of
from rillflow.llm.components import components
from rillflow.llm.shingles import bands, families, set_key, shingle_sets, signature

HASHES, ROWS_PER_BAND = 128, 4
#: Of 128 minima, pairs at the threshold of 0.75 agree in 96 on average; fewer than 76 is below four deviations.
AGREE = 76
BLOCK = 2048


def _describe(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = families(HASHES)
        for batch in batches:
            ids = ids_of(batch.column(0))
            sizes, keys, signs, marks = [], [], [], []
            for one in shingle_sets(texts_of(batch.column(1)), width):
                sizes.append(len(one))
                keys.append(set_key(one) if len(one) else (None, None))
                sign = signature(one, factors, offsets) if len(one) else np.zeros(HASHES, np.uint32)
                signs.append(sign.astype(np.uint8).tobytes())
                marks.append(sign)
            keys_of = bands(np.array(marks).reshape(len(marks), HASHES), ROWS_PER_BAND)
            yield pa.RecordBatch.from_arrays([
                ids_back(ids), pa.array(sizes, pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()),
                pa.array(signs, pa.binary()), pa.array(list(keys_of), pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "set_a", "set_b", "sign", "bands"])

    return rows


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(width: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = ids_of(batch.column(0)), ids_of(batch.column(1))
            left, right = texts_of(batch.column(2)), texts_of(batch.column(3))
            last, known, keep = None, None, []
            for i, (center, other) in enumerate(zip(left, shingle_sets(right, width))):
                if last != center:
                    last, known = center, next(shingle_sets([center], width))
                if _linked(known, other, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return rows


class _Forest:
    """Which members are joined already."""

    def __init__(self, labels: list) -> None:
        self.up: dict = {x: x for x in labels}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _joined(table: pa.Table, test) -> pa.Table:
    """Links between members of different components of one block pair: each one joins two trees.

    Members of the largest component are only compared with others. ``test(i, j)`` confirms a candidate.
    """
    ids, comps = ids_of(table.column("id").combine_chunks()), ids_of(table.column("component").combine_chunks())
    signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint8).reshape(-1, HASHES)
    labels, inverse, counts = np.unique(comps, return_inverse=True, return_counts=True)
    forest, found = _Forest(labels.tolist()), []
    for i in np.flatnonzero(inverse != counts.argmax()).tolist():
        alike = (signs == signs[i]).sum(axis=1)
        alike[inverse == inverse[i]] = 0
        for j in np.argsort(-alike, kind="stable")[: int((alike >= AGREE).sum())].tolist():
            a, b = comps[i].item(), comps[j].item()
            if forest.root(a) != forest.root(b) and test(i, j):
                forest.join(a, b)
                found.append((ids[i], ids[j]))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def _similar(table: pa.Table) -> pa.Table:
    return _joined(table, lambda i, j: True)


def _exact(width: int, percent: int):
    def rows(table: pa.Table) -> pa.Table:
        sets = list(shingle_sets(texts_of(table.column("text").combine_chunks()), width))
        return _joined(table, lambda i, j: _linked(sets[i], sets[j], percent))

    return rows


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """Members of a key in pairs of blocks of at most about ``BLOCK``: every two meet in one (key, lo, hi)."""
    sized = members.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.join(sized, key).withColumn("block", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("block", "other", "blocks")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Rows: doc_id, n_shingles, component_id (the smallest id reachable over links, itself included), kept.

    Two documents are linked when 100 times the shingles they share is at least ``percent`` times those of
    either; shingles are ``width`` consecutive words, a shorter text is one shingle, and a text without words
    (or null) is linked with nothing. Rows with one id are one document: they share its component. A null id
    is linked with nothing, takes no part for others and is kept. Other columns are not read. An empty table
    gives no rows.
    """
    docs = narrowed(docs, id_col, text_col)
    described = saved(docs.mapInArrow(_describe(width), "doc_id long, n_shingles long, set_a long, set_b long, sign binary, bands array<long>"))
    full = described.where("n_shingles > 0 and doc_id is not null")
    classes = saved(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id")))
    # One row per class: equal ids with equal sets are one row.
    chosen = saved(full.join(classes.withColumnRenamed("id", "least"), ["set_a", "set_b"]).where("doc_id = least")
                   .select(F.col("doc_id").alias("id"), "sign", "bands").dropDuplicates(["id", "sign"]))
    banded = chosen.select("id", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = saved(banded.join(heads, "band"))
    signs = chosen.select("id", "sign")
    alike = F.aggregate(
        F.sequence(F.lit(1), F.lit(HASHES)), F.lit(0),
        lambda n, i: n + (F.substring(F.col("sign"), i, F.lit(1)) == F.substring(F.col("head_sign"), i, F.lit(1))).cast("int"),
    )
    candidates = saved(
        shared.where("id != head").select("head", "id").distinct()
        .join(signs, "id").join(signs.select(F.col("id").alias("head"), F.col("sign").alias("head_sign")), "head")
        .where(alike >= AGREE).select("head", "id")
    )
    # The texts of all that share a band, taken once: steps 2 and 3 compare only these.
    texts = docs.withColumnRenamed("doc_id", "id")
    involved = saved(texts.join(shared.select("id").distinct(), "id", "left_semi"))
    pairs = candidates.join(involved, "id").join(involved.select(F.col("id").alias("head"), F.col("text").alias("head_text")), "head")
    links = saved(pairs.select("head", "id", "head_text", "text").mapInArrow(_confirm(width, percent), "u long, v long"))
    first = components(links)

    def labelled(frame: DataFrame, comps: DataFrame) -> DataFrame:
        comps = comps.select(F.col("node").alias("id"), "component")
        return frame.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))

    members = labelled(shared.select("band", "id"), first)
    open_bands = members.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("band")
    rest = members.join(open_bands, "band").join(signs, "id")
    similar = saved(_blocks(rest, "band").groupBy("band", "lo", "hi").applyInArrow(_similar, "u long, v long"))
    # Trees of similar members and of confirmed links together, then those with several components.
    trees = components(similar.unionByName(first.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    grouped = labelled(trees.select(F.col("node").alias("id"), F.col("component").alias("tree"))
                       .unionByName(trees.select(F.col("component").alias("id"), F.col("component").alias("tree")).distinct()), first)
    open_trees = grouped.groupBy("tree").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("tree")
    rest = grouped.join(open_trees, "tree").join(signs, "id").join(involved, "id")
    more = saved(_blocks(rest, "tree").groupBy("tree", "lo", "hi").applyInArrow(_exact(width, percent), "u long, v long"))
    final = components(more.unionByName(first.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    by_class = labelled(classes, final)
    out = described.select("doc_id", "n_shingles", "set_a", "set_b").join(by_class.drop("id"), ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
