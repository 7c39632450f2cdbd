"""How far the sources of a language diverge from each other and from their language, by the terms they use.

Terms are counted in the tasks and leave them combined; one shuffle by (lang, term) gives the counts per source and,
in the same partitions, the totals that decide which terms are kept. The most divergent terms of a source come from
skybands: more occurrences in the group, fewer in the language and an earlier term never rank lower, so a term that k others
dominate in all three is not among the first k. Each partition keeps the skybands of its groups, a second pass merges
them, and the few thousand terms left of a group are ranked exactly. Pairs of sources are sums over all kept terms, taken by
blocks of terms and bands of sources.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import saved, small_batches, texts_of

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = 1_000_000_000
#: Bytes of a text read at once.
PIECE = 1 << 20


class Sizes(NamedTuple):
    """What a task holds at once; results do not depend on it."""

    entries: int = 300_000  # of the table of counts before it is passed on
    looked: int = 100_000  # rows looked through for skybands
    bands: int = 500_000  # rows of skybands
    block: int = 200_000  # rows of a block of terms
    band: int = 256  # sources compared with all others
    cells: int = 1 << 20  # of a matrix of terms and sources


def terms_of(text: bytes) -> Counter:
    """Terms of a text with their numbers of occurrences, ``PIECE`` bytes at a time (a longer term whole)."""
    text, found, at = text.lower(), Counter(), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            last = TERM.match(text, end)
            end = last.end() if last else end
        found.update(TERM.findall(text, at, end))
        at = end
    return found


def _counts(entries: int):
    """Partial counts: lang, source, term, occurrences, documents."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, bytes], list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            langs, sources, terms = zip(*held)
            n, docs = zip(*held.values())
            held.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs), pa.array(sources), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

        for batch in batches:
            for text, lang, source in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for term, n in terms_of(text).items():
                    entry = held.get((lang, source, term))
                    if entry is None:
                        held[lang, source, term] = [n, 1]
                    else:
                        entry[0] += n
                        entry[1] += 1
                if len(held) > entries:
                    yield from out()
        if held:
            yield from out()

    return counts


def _read(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))
    return small_batches(docs).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in named))


def _kept(texts: DataFrame, least_docs: int, sizes: Sizes) -> DataFrame:
    """lang, source, term, n, total (in the language) of the terms in ``least_docs`` documents of their language."""
    partial = texts.mapInArrow(_counts(sizes.entries), "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    counts = counts.withColumn("total", F.sum("n").over(whole)).withColumn("docs", F.sum("docs").over(whole))
    return counts.where(F.col("docs") >= least_docs).drop("docs")


def _p(n: Column, size: Column) -> Column:
    """Smoothed share in thousand millionths, rounded down, and one; in whole numbers throughout."""
    return F.call_function("div", F.lit(UNIT).cast("decimal(20,0)") * (n + 1), size.cast("decimal(20,0)")) + 1


def p_of(n: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """As ``_p``: long division by thousands, so that nothing overflows while ``size`` is below 9 * 10^15."""
    left, out = n + 1, np.zeros_like(n)
    for _ in range(3):
        out, left = out * 1000 + left * 1000 // size, left * 1000 % size
    return out + 1


def skyband(terms: pa.Array, n: np.ndarray, total: np.ndarray, k: int) -> np.ndarray:
    """Places of the entries that fewer than ``k`` others dominate: n not less, total not more, term earlier.

    Entries are taken by descending n, so what dominates an entry comes before it. Of at least ``k`` dominators the first
    ``k`` are in the skyband themselves, hence counting those kept so far, and all of the same slice, is enough.
    """
    rank = np.empty(len(n), np.int64)
    rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(n))
    order = np.lexsort((rank, total, -n))
    small = np.uint16 if len(n) < 1 << 16 else np.uint32
    t, r = np.unique(total, return_inverse=True)[1][order].astype(small), rank[order].astype(small)
    kept, kept_t, kept_r = np.empty(0, np.int64), np.empty(0, small), np.empty(0, small)
    for at in range(0, len(order), 512):
        part, pt, pr = np.arange(at, min(at + 512, len(order))), t[at : at + 512], r[at : at + 512]
        found = np.tril((pt <= pt[:, None]) & (pr < pr[:, None]), -1).sum(1)
        for i in range(0, len(kept), 255):  # a sum of 255 bytes of 0 or 1 fits a byte
            live = found < k
            if 2 * live.sum() < len(live):
                part, pt, pr, found = part[live], pt[live], pr[live], found[live]
            before = (kept_t[i : i + 255, None] <= pt) & (kept_r[i : i + 255, None] < pr)
            found = found + np.add.reduce(before.view(np.uint8), axis=0, dtype=np.uint8)
        live = found < k
        kept, kept_t, kept_r = (np.concatenate(x) for x in ((kept, part[live]), (kept_t, pt[live]), (kept_r, pr[live])))
    return order[kept]


def _skybands(k: int, looked: int, bands: int):
    names = ["lang", "source", "term", "n", "total"]

    def skybands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], pa.Table] = {}
        waiting: list[pa.Table] = []

        def look() -> None:
            table = pa.concat_tables(waiting).combine_chunks().sort_by([("lang", "ascending"), ("source", "ascending")])
            waiting.clear()
            keys = list(zip(table.column("lang").to_pylist(), table.column("source").to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                mine = table.slice(a, b - a)
                if keys[a] in held:
                    mine = pa.concat_tables([held[keys[a]], mine])
                mine = mine.combine_chunks()
                binary = mine.column("term").combine_chunks().cast(pa.binary())
                held[keys[a]] = mine.take(skyband(binary, mine.column("n").to_numpy(), mine.column("total").to_numpy(), k))

        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]).select(names))
            if sum(map(len, waiting)) > looked:
                look()
                if sum(map(len, held.values())) > bands:
                    yield from pa.concat_tables(held.values()).to_batches()
                    held.clear()
        if waiting:
            look()
        if held:
            yield from pa.concat_tables(held.values()).to_batches()

    return skybands


def _facts(texts: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every (lang, source) with the size N + V of its group, and every lang with its own; V is 0 where no term is kept."""
    langs = kept.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    langs = langs.withColumn("lang_size", F.col("lang_size") + F.col("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    return saved(groups.select("lang", "source", (F.coalesce("size", F.lit(0)) + v).alias("size"), v.alias("v"))), saved(langs.select("lang", "lang_size"))


def top_terms(kept: DataFrame, groups: DataFrame, langs: DataFrame, k: int, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, source, item, value, rank of the ``k`` terms whose share in the group most exceeds that in the language."""
    skybands = _skybands(k, sizes.looked, sizes.bands)
    merged = kept.mapInArrow(skybands, kept.schema).repartition("lang", "source").mapInArrow(skybands, kept.schema)
    shares = merged.join(groups.select("lang", "source", "size"), ["lang", "source"]).join(langs, "lang")
    shares = shares.select("lang", "source", F.col("term").alias("item"), _p(F.col("n"), F.col("size")).alias("p"), _p(F.col("total"), F.col("lang_size")).alias("q"))
    valued = shares.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) DIV q").alias("value"))
    return _ranked(valued).where(F.col("rank") <= k)


def _ranked(valued: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return valued.withColumn("rank", F.row_number().over(order))


def _sums(band: int, cells: int):
    """Sums over the terms of a block, for each source of a band against each other source of the language; block 0 names all pairs."""

    def sums_of(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
        sources = sources.sort_by("source")
        names, size = sources.column("source").to_pylist(), sources.column("size").to_numpy().astype(np.int64)
        first = key[2].as_py() * band
        mine = range(first, min(first + band, len(names)))
        sums = np.zeros((len(mine), len(names)), np.int64)
        if len(terms):
            term = terms.column("term").combine_chunks().dictionary_encode()
            place = {name: i for i, name in enumerate(names)}
            row, n = term.indices.to_numpy(), terms.column("n").to_numpy()
            column = np.array([place[s] for s in terms.column("source").to_pylist()])
            order = np.argsort(row, kind="stable")
            row, column, n = row[order], column[order], n[order]
            step = max(1, cells // len(names))
            for at in range(0, len(term.dictionary), step):
                a, b = np.searchsorted(row, (at, at + step))
                counts = np.zeros((min(step, len(term.dictionary) - at), len(names)), np.int64)
                counts[row[a:b] - at, column[a:b]] = n[a:b]
                shares = p_of(counts, size)
                for i, g in enumerate(mine):
                    far = shares[:, g : g + 1] - shares
                    sums[i] += (far * far // shares).sum(0)
        told = len(terms) or key[1].as_py() == 0
        pairs = [(names[g], names[o], int(sums[i, o])) for i, g in enumerate(mine) for o in range(len(names)) if o != g] if told else []
        lang = [key[0].as_py()] * len(pairs)
        a, b, value = zip(*pairs) if pairs else ((), (), ())
        return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array(a, pa.string()), "item": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    return sums_of


def pairs(kept: DataFrame, groups: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language by its divergence over all kept terms."""
    blocks = max(1, -(-kept.count() // sizes.block))
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    bands = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-widest // sizes.band) - 1)))).alias("band")
    terms = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), bands, "source", "term", "n")
    sources = groups.select("lang", "source", "size", bands).select("lang", "band", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    keys = ("lang", "block", "band")
    parts = terms.groupBy(*keys).cogroup(sources.groupBy(*keys)).applyInArrow(_sums(sizes.band, sizes.cells), "lang string, source string, item string, value long")
    return _ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, k: int = 200, sizes: Sizes = Sizes(),
) -> DataFrame:
    """Divergence of every source from the others of its language (part ``pair``) and its ``k`` most typical terms (part ``term``).

    Rows: lang, source, part, item, value, rank. A null text, lang or source is empty text. Every row is a document, repeated
    ones and those without an id too. A language without kept terms has pairs of value 0 and no terms; a language with
    one source has no pairs; ties are ranked by the bytes of the item. An empty table gives no rows.
    """
    texts = _read(docs, text_col, lang_col, source_col)
    kept = saved(_kept(texts, least_docs, sizes))
    groups, langs = _facts(texts, kept)
    parts = [pairs(kept, groups, sizes).withColumn("part", F.lit("pair")), top_terms(kept, groups, langs, k, sizes).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", F.col("value").cast("long"), "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The sources of ``documents`` by language."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
totals AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN totals USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, sum(n)::HUGEINT + count(*) AS size FROM totals GROUP BY lang),
kept AS (SELECT lang, count(*) AS v FROM totals GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(any_value(kept.v), 0) + coalesce(sum(c.n), 0)::HUGEINT AS size
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) LEFT JOIN kept ON kept.lang = g.lang GROUP BY g.lang, g.source
),
shares AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // g.size AS p,
    1 + 1000000000::HUGEINT * (t.n + 1) // langs.size AS q
  FROM groups g JOIN totals t USING (lang) JOIN langs USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
),
paired AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN paired p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
