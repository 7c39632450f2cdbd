"""Main text of web pages by a site style tree.

The element trees of all pages of a host are merged: a node of the site tree is the chain of block elements
(name and class) down to it. Two entropies say how important a node is. Its presentation: how evenly the
orders of child elements under it are spread over the pages. Its content: how far its text blocks repeat
over the pages, a block on n of m pages counting log n / log m. Both are combined bottom-up, and a page
loses the highest branches of low importance. Elements whose name, role or class states that they are no
content (navigation, footers, adverts, forms, scripts) have no importance from the start.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import saved, small_batches, texts_of

# Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
NO_CONTENT = frozenset(
    "nav footer header aside form script style noscript template textarea title iframe noembed noframes xmp head menu dialog button select "
    "object svg canvas audio video map".split()
)
NO_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe share sharing social related "
    "recommended comment comments respond login signup search widget pagination copyright disclaimer".split()
)
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: An opening tag of the key ends an open element of these names.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",),
}
#: Elements that an implied end doesn't reach beyond.
FENCE = frozenset("html body article section main div ul ol dl table td th nav footer header aside form".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Za-z]+")
CUT_TAG = re.compile(r"<[/!?A-Za-z][^<>]*\Z")
SPACE = re.compile(r"\s+")
ROOT = 0x51ED27


class _Node:
    __slots__ = ("children", "name", "path", "silent")

    def __init__(self, name: str, path: int, silent: bool) -> None:
        self.name, self.path, self.silent, self.children = name, path, silent, 0


def _down(path: int, label: str) -> int:
    """The path hash of a child, 63 bits."""
    h = (path ^ crc32(label.encode("utf-8", "replace"))) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 32) & 0x7FFFFFFFFFFFFFFF


def _silent(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element states that it is no content, and its class."""
    label, silent = "", name in NO_CONTENT
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "class":
            label = value
        if key == "hidden":
            silent = True
        elif key == "role":
            silent |= value.lower() in NO_CONTENT_ROLES
        elif name not in ("html", "body", "article", "main"):
            silent |= any(w.lower() in NO_CONTENT_WORDS for w in WORD.findall(value))
    return silent, label


def walked(page: str, leave=None) -> Iterator[tuple[int, str]]:
    """Text blocks of a page in order: path and text of each, without silent elements.

    ``leave(path, parent, children)`` is told of every element that ends, ``children`` being a hash of the
    child elements' paths in order.
    """
    cut = CUT_TAG.search(page)
    if cut:
        page = page[: cut.start()]
    stack = [_Node("", ROOT, False)]
    held: list[str] = []
    at, size = 0, len(page)

    def block() -> tuple[int, str] | None:
        if not held:
            return None
        text = SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        return (stack[-1].path, text) if text else None

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if leave and not node.silent:
                leave(node.path, stack[-1].path, node.children)

    while at < size:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not stack[-1].silent:
            held.append(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in INLINE and stack[-1].name != name:
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                if got := block():
                    yield got
                close(depth)
            continue
        attributes = m[3]
        if name in INLINE and not attributes:
            continue
        silent, label = _silent(name, attributes)
        if name in INLINE and not silent:
            continue
        if got := block():
            yield got
        if name in VOID:
            continue
        ends = ENDS.get(name, ("p",) if name not in INLINE else ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in ends:
                close(i)
                break
            if stack[i].name in FENCE:
                break
        top = stack[-1]
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        path = _down(top.path, f"{name}.{label}")
        if not (silent or top.silent):
            top.children = _down(top.children, name) if top.children else _down(7, name)
        if not attributes.endswith("/") or name not in ("path", "circle", "rect"):
            stack.append(_Node(name, path, silent or top.silent))
    if got := block():
        yield got
    close(1)


def host_of(url: str | None) -> str:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    _, mark, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0] if mark else ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)


PRESENT, STYLE, BLOCK = 0, 1, 2
COUNTS = pa.schema([("host", pa.string()), ("path", pa.int64()), ("parent", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("n", pa.int64())])
HELD = 200_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """On how many pages of a host each node, child order and text block stands; partial sums."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        cols = list(zip(*counts))
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, list(counts.values())], COUNTS)], schema=COUNTS)
        counts.clear()
        return batch

    for batch in batches:
        for url, raw in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            host, seen, parents = host_of(url), set(), {ROOT: 0}

            def leave(path: int, parent: int, children: int) -> None:
                parents[path] = parent
                seen.add((path, PRESENT, 0))
                seen.add((path, STYLE, children))

            blocks = [(path, BLOCK, _down(len(text), text)) for path, text in walked(raw.decode("utf-8", "replace"), leave)]
            seen.update(blocks)
            counts.update((host, path, parents.get(path, 0), kind, value) for path, kind, value in seen)
            if len(counts) > HELD:
                yield out()
    if counts:
        yield out()


def importance(nodes: pd.DataFrame, damping: float, least_pages: int) -> dict[int, float]:
    """Composite importance of each path of one host's style tree."""
    pages = {r.path: r.pages for r in nodes.itertuples()}
    children: dict[int, list[int]] = {}
    for r in nodes.itertuples():
        children.setdefault(r.parent, []).append(r.path)
    by_path = {r.path: r for r in nodes.itertuples()}
    done: dict[int, float] = {}
    todo = [(p, False) for p in children.get(ROOT, [])]
    while todo:
        path, ready = todo.pop()
        if not ready:
            todo.append((path, True))
            todo.extend((c, False) for c in children.get(path, []))
            continue
        r, below = by_path[path], [(done[c], pages[c]) for c in children.get(path, []) if c in done]
        scale = math.log(r.pages) if r.pages > 1 else 0.0
        if r.blocks:
            below.append((1.0 - r.block_logs / r.blocks / scale if scale else 1.0, r.pages))
        if r.pages < least_pages or not below:
            done[path] = 1.0
            continue
        style = (math.log(r.styles_n) - r.style_logs / r.styles_n) / scale
        inner = sum(x * n for x, n in below) / sum(n for _, n in below)
        share = damping ** len(below) if len(below) > 1 else 1.0
        done[path] = (1 - share) * style + share * inner
    return done


def _low(limit: float, damping: float, least_pages: int):
    def of_host(nodes: pa.Table) -> pa.Table:
        low = [p for p, x in importance(nodes.to_pandas(), damping, least_pages).items() if x < limit]
        hosts = nodes.column("host").slice(0, 1 if low else 0)
        return pa.table({"host": hosts, "low": pa.array([low] if low else [], pa.list_(pa.int64()))})

    return of_host


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, low = batch.column(0), batch.column(1), batch.column(3).to_pylist()
        texts = []
        for raw, paths in zip(texts_of(batch.column(2)), low):
            page = raw.decode("utf-8", "replace")
            every = list(walked(page)) if not paths else _above(page, set(paths))
            texts.append(" ".join(text for _, text in every))
        yield pa.RecordBatch.from_arrays(
            [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"],
        )


def _above(page: str, low: set[int]) -> list[tuple[int, str]]:
    """Blocks outside branches of low importance; all blocks where nothing else is left."""
    parents: dict[int, int] = {}
    every = list(walked(page, lambda path, parent, _: parents.__setitem__(path, parent)))

    def cut(path: int) -> bool:
        while path in parents:
            if path in low:
                return True
            path = parents[path]
        return False

    return [b for b in every if not cut(b[0])] or every


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limit: float = 0.2, damping: float = 0.9, least_pages: int = 30,
) -> DataFrame:
    """Rows: page_id, url, text (main text, empty if none), n_chars.

    White space inside a block becomes one space, blocks are joined by one space in page order, character
    references are decoded. Null html is empty; a url that is null or has no ``://`` belongs to the nameless
    host. Nodes on fewer than ``least_pages`` pages of a host are never of low importance, and a page of
    nothing else keeps its text. Repeated rows give repeated results; other columns are not read. An
    empty table gives no rows.
    """
    pages = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    counts = pages.select("url", "html").mapInArrow(_count, "host string, path long, parent long, kind int, value long, n long")
    whole = counts.groupBy("host", "path", "parent", "kind", "value").agg(F.sum("n").alias("n"))
    log_n = F.log(F.col("n").cast("double"))
    nodes = whole.groupBy("host", "path", "parent").agg(
        F.max(F.when(F.col("kind") == PRESENT, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == STYLE, F.col("n")).otherwise(0)).cast("double").alias("styles_n"),
        F.sum(F.when(F.col("kind") == STYLE, F.col("n") * log_n).otherwise(0.0)).alias("style_logs"),
        F.sum(F.when(F.col("kind") == BLOCK, 1).otherwise(0)).alias("blocks"),
        F.sum(F.when(F.col("kind") == BLOCK, log_n).otherwise(0.0)).alias("block_logs"),
    ).where("pages is not null")
    # Written out, its size is known: a short list joins without moving the pages.
    low = saved(nodes.groupBy("host").applyInArrow(_low(limit, damping, least_pages), "host string, low array<long>"))
    mark = F.instr("url", "://")
    rest = F.when(mark > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", host).join(low, "host", "left").select("page_id", "url", "html", "low").mapInArrow(
        _texts, "page_id long, url string, text string, n_chars long",
    )


def op5_site_tree(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
