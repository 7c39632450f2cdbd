"""Which items of a poll are new, and the cursor the next poll starts from.

An item row has ``source_key``, ``poll_id`` (unique per source), ``pos`` (0-based place in the poll)
and ``external_id``. A seen row has ``source_key``, ``external_id`` and ``rank`` (1 is the newest).
Selections return the chosen items and one row per poll. ``polls(source_key, poll_id, page_items)`` names every
poll with the number of entries it had, usable or not, so that polls without a new or any item have a row too;
without it the polls are those that occur in the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.plans import top_per_key

POLL = ["source_key", "poll_id"]
ITEM = ["source_key", "external_id"]

# Sizes of the remembered windows and of a drain.
SEEN_WINDOW, SEEN_FLOOR = 500, 50
MAPPED_WINDOW, MAPPED_FLOOR = 2000, 100
REFRESH = 10
MAX_PAGES = 100
SEARCH_DEPTH = 1000
ANCHOR_MOVED = (
    "the entry before the stored offset is not the one seen last; reading from the first entry again"
)
OFFSET_BEYOND = "the stored offset lies past the last entry; reading from the first entry again"
ZERO_ITEMS = "a page without items announced another one; the run ends here"
STUCK = "the page left the cursor where it was; the run ends here"


def _by_pos() -> list[Column]:
    return [F.col("pos").asc()]


def _flag(items: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Add a boolean: whether the item is among ``ids``. Both key columns spread a hot source."""
    marks = ids.select(*ITEM).distinct().withColumn(name, F.lit(True))
    return items.join(marks, ITEM, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def _every(items: DataFrame, polls: DataFrame | None) -> DataFrame:
    if polls is not None:
        return polls.select(*POLL, F.col("page_items").cast("bigint").alias("page_items"))
    return items.groupBy(*POLL).agg((F.max("pos") + 1).cast("bigint").alias("page_items"))


def skip_seen(
    items: DataFrame, seen: DataFrame, limit: int | Column, polls: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Drop seen ids, keep the first ``limit`` of the rest in order."""
    fresh = items.join(seen.select(*ITEM).distinct(), ITEM, "left_anti")
    chosen = top_per_key(fresh, POLL, _by_pos(), limit)
    cap = F.lit(limit) if isinstance(limit, int) else F.max(limit)
    counts = fresh.groupBy(*POLL).agg(F.count("*").alias("_n"), F.max(cap).alias("_l") if isinstance(limit, int) else cap.alias("_l"))
    pages = _every(items, polls).join(counts, POLL, "left").select(
        *POLL,
        F.coalesce(F.least("_n", F.col("_l").cast("bigint")), F.lit(0)).alias("primary_count"),
        F.coalesce(F.col("_n") > F.col("_l"), F.lit(False)).alias("has_more"),
    )
    return chosen, pages


def take_until_known(
    items: DataFrame, watermark: DataFrame, seen: DataFrame, limit: int, polls: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Items in order up to the first watermark id; earlier seen ids count but are not emitted.

    The next offset is behind the item that ended the scan; where neither the watermark nor the limit ended it, the
    whole page is read, entries that are no items included.

    Nothing past the first ``limit`` items of a poll can matter, so only those are looked up, and the
    window over a poll holds at most ``limit`` rows.
    """
    head = top_per_key(items, POLL, _by_pos(), limit)
    flagged = _flag(_flag(head, watermark, "_known"), seen, "_seen")
    whole = Window.partitionBy(*POLL)
    cut = flagged.withColumn("_first", F.min(F.when(F.col("_known"), F.col("pos"))).over(whole))
    passed = F.col("_first").isNull() | (F.col("pos") < F.col("_first"))
    chosen = cut.filter(passed & ~F.col("_seen")).drop("_known", "_seen", "_first", "rank")
    counts = cut.groupBy(*POLL).agg(
        F.count_if(passed).alias("_n"), F.count_if(passed & ~F.col("_seen")).alias("_emitted"), F.bool_or("_known").alias("_hit"),
        F.when(F.bool_or("_known"), F.max("_first")).when(F.count("*") >= limit, F.max("pos")).alias("_last"),
    )
    pages = _every(items, polls).join(counts, POLL, "left").select(
        *POLL, F.coalesce("_n", F.lit(0)).alias("primary_count"), F.coalesce("_emitted", F.lit(0)).alias("emitted"),
        F.coalesce("_hit", F.lit(False)).alias("reached_known"),
        F.coalesce((F.col("_last") + 1).cast("bigint"), F.col("page_items")).alias("next_offset"),
    )
    return chosen, pages


def take_until_known_page(
    items: DataFrame, watermark: DataFrame, seen: DataFrame, polls: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The same for listings, whose request already bounded the page: no limit inside the poll."""
    known = items.join(watermark.select(*ITEM).distinct(), ITEM, "left_semi")
    first = known.groupBy(*POLL).agg(F.min("pos").alias("_first"))
    cut = _flag(items.join(first, POLL, "left"), seen, "_seen")
    passed = F.col("_first").isNull() | (F.col("pos") < F.col("_first"))
    chosen = cut.filter(passed & ~F.col("_seen")).drop("_first", "_seen")
    counts = cut.groupBy(*POLL).agg(
        F.count_if(passed).alias("_n"), F.count_if(passed & ~F.col("_seen")).alias("_emitted"), F.max("_first").isNotNull().alias("_hit")
    )
    pages = _every(items, polls).join(counts, POLL, "left").select(
        *POLL, F.coalesce("_n", F.lit(0)).alias("primary_count"), F.coalesce("_emitted", F.lit(0)).alias("emitted"),
        F.coalesce("_hit", F.lit(False)).alias("reached_known"),
    )
    return chosen, pages


def take_new(
    items: DataFrame, seen: DataFrame, cycle: DataFrame, sources: DataFrame, limit: int, polls: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Mapped endpoints: the stop rule holds only for initialised sources.

    Ids emitted earlier in the cycle, or earlier on the page, are skipped without stopping.
    ``sources(source_key, initialized)`` has one row per source.
    """
    rest = items.join(cycle.select(*ITEM).distinct(), ITEM, "left_anti")
    once = top_per_key(rest, [*POLL, "external_id"], _by_pos(), 1).drop("rank")
    head = top_per_key(once, POLL, _by_pos(), limit + 1)
    flagged = _flag(head, seen, "_seen").join(
        sources.select("source_key", F.col("initialized").alias("_init")), "source_key", "left"
    )
    known = flagged.withColumn("_known", F.col("_seen") & F.coalesce("_init", F.lit(False)))
    cut = known.withColumn(
        "_first", F.min(F.when(F.col("_known"), F.col("rank"))).over(Window.partitionBy(*POLL))
    )
    emitted = (F.col("rank") <= limit) & (F.col("_first").isNull() | (F.col("rank") < F.col("_first")))
    chosen = cut.filter(emitted).drop("_seen", "_init", "_known", "_first", "rank")
    counts = cut.groupBy(*POLL).agg(
        F.count_if(emitted).alias("_n"), F.max("_first").isNotNull().alias("_hit"),
        (F.max("_first").isNotNull() | (F.max("rank") <= limit)).alias("_whole"),
    )
    pages = _every(items, polls).join(counts, POLL, "left").select(
        *POLL, F.coalesce("_n", F.lit(0)).alias("primary_count"), F.coalesce("_hit", F.lit(False)).alias("reached_known"),
        F.coalesce("_whole", F.lit(True)).alias("fully_scanned"),
    )
    return chosen, pages


def merge_seen(
    prior: DataFrame, processed: DataFrame, window: int = SEEN_WINDOW, prepend: bool = True, floor: int = SEEN_FLOOR
) -> DataFrame:
    """The remembered ids after a page: each once, the first ``window`` of the joined order, ``floor`` at least
    (``MAPPED_FLOOR`` for mapped endpoints).

    A new cycle puts its ids in front, a continued page puts them at the end.
    """
    front, back = (0, 1) if prepend else (1, 0)
    both = processed.select(*ITEM, F.struct(F.lit(front).alias("g"), F.col("pos").cast("long").alias("p")).alias("o")).unionByName(
        prior.select(*ITEM, F.struct(F.lit(back).alias("g"), F.col("rank").cast("long").alias("p")).alias("o"))
    )
    once = both.groupBy(*ITEM).agg(F.min("o").alias("o"))
    kept = top_per_key(once, ["source_key"], [F.col("o"), F.col("external_id")], max(window, floor))
    return kept.select(*ITEM, "rank")


def merge_seen_lists(prior: Column, processed: Column, window: int, prepend: bool = True, floor: int = SEEN_FLOOR) -> Column:
    """The same on arrays, for cursor state."""
    joined = F.concat(processed, prior) if prepend else F.concat(prior, processed)
    return F.slice(F.array_distinct(joined), 1, max(window, floor))


def validate_anchor(items: DataFrame, cursors: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """The offset each poll really starts from, with a warning where it restarts.

    ``cursors(source_key, offset, page_anchor)``. The anchor is the last entry of the page before; if
    it is not right before the offset any more, the feed has moved.
    """
    anchors = cursors.filter(F.coalesce(F.trim("page_anchor"), F.lit("")) != "").select(
        "source_key", F.trim("page_anchor").alias("external_id")
    )
    at = items.join(anchors, ITEM).groupBy(*POLL).agg(F.min("pos").alias("anchor_pos"))
    sizes = items.groupBy(*POLL).agg(F.count("*").alias("entries"))
    if polls is not None:
        sizes = polls.select(*POLL).join(sizes, POLL, "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    state = (
        sizes.join(cursors.select("source_key", "offset", "page_anchor"), "source_key", "left")
        .join(at, POLL, "left")
        .withColumn("offset", F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)).cast("bigint"))
    )
    anchored = (F.col("offset") > 0) & (F.coalesce(F.trim("page_anchor"), F.lit("")) != "")
    moved = anchored & ~F.col("anchor_pos").eqNullSafe(F.col("offset") - 1)
    beyond = ~anchored & (F.col("offset") > F.col("entries"))
    return state.select(
        *POLL, "entries",
        F.when(moved | beyond, 0).otherwise(F.col("offset")).cast("bigint").alias("start"),
        F.when(moved, ANCHOR_MOVED).when(beyond, OFFSET_BEYOND).alias("warning"),
    )


def page_slice(items: DataFrame, starts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Items ``[start, start + limit)`` of each poll and the offset and anchor that follow.

    ``starts`` is the result of :func:`validate_anchor`.
    """
    joined = items.join(starts.select(*POLL, "start", "entries"), POLL)
    chosen = joined.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + limit))
    last = chosen.groupBy(*POLL).agg(
        F.count("*").alias("primary_count"), F.max_by("external_id", "pos").alias("_anchor")
    )
    end = F.col("start") + F.coalesce("primary_count", F.lit(0))
    more = end < F.col("entries")
    pages = starts.join(last, POLL, "left").select(
        *POLL,
        F.coalesce("primary_count", F.lit(0)).alias("primary_count"),
        more.alias("has_more"),
        F.when(more, end).otherwise(0).alias("next_offset"),
        F.when(more, F.col("_anchor")).alias("page_anchor"),
    )
    return chosen.drop("start", "entries"), pages


def advance_watermark(items: DataFrame, cursors: DataFrame, complete: Column | None = None) -> DataFrame:
    """Per source the newest of the stored mark and the cycle's update times.

    ``complete`` (over ``cursors``) holds the mark where the cycle is not finished.
    """
    newest = items.groupBy("source_key").agg(
        F.max(F.coalesce("updated_at", "created_at")).alias("_newest")
    )
    done = F.lit(True) if complete is None else complete
    return (
        cursors.withColumn("_done", done)
        .join(newest, "source_key", "full_outer")
        .select(
            "source_key",
            F.when(F.coalesce("_done", F.lit(True)), F.greatest("watermark", "_newest"))
            .otherwise(F.col("watermark")).alias("watermark"),
        )
    )


def since_watermark(items: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows updated at or after the mark cut to the second; the overlap is read again on purpose."""
    marks = cursors.select("source_key", F.date_trunc("second", "watermark").alias("_mark"))
    at = F.coalesce("updated_at", "created_at")
    return (
        items.join(marks, "source_key", "left")
        .filter(F.col("_mark").isNull() | (at >= F.col("_mark")))
        .drop("_mark")
    )


def next_search_state(pages: DataFrame, depth: int = SEARCH_DEPTH) -> DataFrame:
    """Numbered search pages: the rest of this page, else the next page, else start over.

    ``pages`` has ``page``, ``per_page``, ``end_offset``, ``page_items``, ``total_count``,
    ``watermark`` and ``batch_watermark``; the mark moves only when the cycle ends.
    """
    rest = F.col("end_offset") < F.col("page_items")
    onward = (
        (F.col("page_items") > 0)
        & (F.col("page_items") == F.col("per_page"))
        & (F.col("page") * F.col("per_page") < F.least(F.coalesce("total_count", "page_items"), F.lit(depth)))
    )
    return (
        pages.withColumn("has_more", rest | onward)
        .withColumn(
            "next_page", F.when(rest, F.col("page")).when(onward, F.col("page") + 1).otherwise(1)
        )
        .withColumn("next_offset", F.when(rest, F.col("end_offset")).otherwise(0))
        .withColumn(
            "next_watermark",
            F.when(rest | onward, F.col("watermark"))
            .otherwise(F.coalesce(F.greatest("watermark", "batch_watermark"), "watermark")),
        )
    )


def next_feed_state(pages: DataFrame) -> DataFrame:
    """Linked feed pages: stop at the watermark, finish this page, follow ``next_url``, or end.

    ``pages`` has ``reached_known``, ``next_offset``, ``page_items``, ``page_url`` and ``next_url``.
    The cycle's watermark ids are carried only while there is more.
    """
    open_page = ~F.col("reached_known")
    rest = open_page & (F.col("next_offset") < F.col("page_items"))
    url = F.when(rest, F.col("page_url")).when(open_page, F.col("next_url"))
    return (
        pages.withColumn("cursor_url", url)
        .withColumn("cursor_offset", F.when(rest, F.col("next_offset")).otherwise(0))
        .withColumn("has_more", F.col("cursor_url").isNotNull())
        .withColumn("keeps_watermark", F.col("has_more"))
    )


def next_listing_state(pages: DataFrame) -> DataFrame:
    """Listing pages: the ``after`` token and running count live only while there is more.

    ``pages`` has ``reached_known``, ``after``, ``count`` and ``primary_count``.
    """
    after = F.when(~F.col("reached_known"), F.col("after"))
    return (
        pages.withColumn("next_after", after)
        .withColumn("has_more", F.col("next_after").isNotNull())
        .withColumn(
            "next_count",
            F.when(F.col("has_more"), F.col("count") + F.col("primary_count")).otherwise(0),
        )
        .withColumn("keeps_watermark", F.col("has_more"))
    )


def next_mapped_state(pages: DataFrame, pagination: str, page_start: int = 1) -> DataFrame:
    """Mapped endpoints: whether the cycle is complete, and the next page or token if not.

    ``pages`` has ``initialized``, ``backfill``, ``reached_known``, ``fully_scanned``, ``page``,
    ``page_items``, ``api_cursor`` and ``next_cursor``. A first poll without backfill completes at
    once: it is the baseline.
    """
    if pagination == "page":
        onward = F.col("page_items") > 0
    elif pagination == "cursor":
        onward = F.col("next_cursor").isNotNull()
    else:
        onward = F.lit(False)
    complete = (~F.col("initialized") & ~F.col("backfill")) | F.col("reached_known") | (
        F.col("fully_scanned") & ~onward
    )
    moves = ~F.col("complete") & F.col("fully_scanned")
    step = 1 if pagination == "page" else 0
    return (
        pages.withColumn("complete", complete)
        .withColumn("has_more", ~F.col("complete"))
        .withColumn(
            "next_page",
            F.when(F.col("complete"), page_start)
            .when(moves, F.col("page") + step)
            .otherwise(F.col("page")),
        )
        .withColumn(
            "next_api_cursor",
            F.when(F.col("complete"), F.lit(None).cast("string"))
            .when(moves & F.lit(pagination == "cursor"), F.col("next_cursor"))
            .otherwise(F.col("api_cursor")),
        )
        .withColumn("next_initialized", F.col("complete") | F.col("initialized"))
    )


def top_k_children(children: DataFrame, k: int, order: str = "newest") -> DataFrame:
    """The ``k`` chosen children of each ``(source_key, parent_id)``.

    ``highest`` takes the highest numeric ids once each and drops ids that are no number; ``newest``
    takes the latest ``created_at``; ``first`` keeps list order by ``pos``. Ranks count from 1.
    """
    keys = ["source_key", "parent_id"]
    if order == "highest":
        numeric = children.withColumn("child_id", F.col("child_id").try_cast("bigint"))
        once = numeric.filter("child_id IS NOT NULL").dropDuplicates([*keys, "child_id"])
        return top_per_key(once, keys, [F.col("child_id").desc()], k)
    if order == "newest":
        return top_per_key(
            children, keys, [F.col("created_at").desc(), F.col("child_id").desc()], k
        )
    if order == "first":
        return top_per_key(children, keys, _by_pos(), k)
    raise ValueError("order must be highest, newest or first")


def refresh_candidates(seen: DataFrame, processed: DataFrame, n: int = REFRESH) -> DataFrame:
    """The ``n`` most recently seen parents per source that are not in this batch; 0 disables."""
    rest = seen.join(processed.select(*ITEM).distinct(), ITEM, "left_anti").withColumnRenamed("rank", "seen_rank")
    return top_per_key(rest, ["source_key"], [F.col("seen_rank"), F.col("external_id")], max(0, n))


def drain_pages(pages: DataFrame, limit: int, max_pages: int = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """The pages a run takes before something stops it, and the warning it ends with.

    ``pages`` has ``source_key``, ``run_id``, ``page_no`` (from 1), ``primary_count``, ``has_more``,
    ``cursor_json`` and ``start_cursor``. At most ``max_pages`` rows per run enter the windows.
    """
    keys = ["source_key", "run_id"]
    head = top_per_key(pages, keys, [F.col("page_no").asc()], max_pages, rank="_n")
    run = Window.partitionBy(*keys).orderBy("page_no")
    before = F.coalesce(F.lag("cursor_json").over(run), F.col("start_cursor"))
    total = F.sum("primary_count").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stuck = F.col("cursor_json").eqNullSafe(F.col("_before"))
    flagged = head.withColumn("_before", before).withColumn("_total", total).withColumn(
        "_stop",
        (~F.col("has_more"))
        | (F.col("primary_count") == 0)
        | stuck
        | (F.col("_total") >= limit),
    )
    earlier = F.coalesce(
        F.max(F.col("_stop").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    taken = flagged.withColumn("_earlier", earlier).filter("_earlier = 0")
    ends = taken.groupBy(*keys).agg(
        F.count("*").alias("pages"),
        F.sum("primary_count").alias("primary_count"),
        F.max_by("has_more", "page_no").alias("has_more"),
        F.max_by("cursor_json", "page_no").alias("cursor_json"),
        F.max_by(
            F.when(F.col("has_more") & (F.col("primary_count") == 0), ZERO_ITEMS).when(
                F.col("has_more") & stuck, STUCK
            ),
            "page_no",
        ).alias("stop_warning"),
    ).withColumn(
        "depth_warning",
        F.when((F.col("pages") >= max_pages) & F.col("has_more"), f"stopped after max_pages={max_pages}"),
    )
    return taken.drop("_n", "_before", "_total", "_stop", "_earlier"), ends


def stored_cursors(checkpoints: DataFrame, resume: bool = True) -> DataFrame:
    """Cursors a run starts from; a fresh run ignores what is stored."""
    rows = checkpoints.select("source_key", "cursor_json")
    return rows if resume else rows.limit(0)
