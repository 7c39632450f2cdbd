"""Plain text helpers, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times inside ``fn``."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends (``trim`` only knows the space)."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def optional_text(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, as the substring search compares."""
    return F.translate(c, UPPER, UPPER.lower())


def join_authors(authors: Column, author: Column) -> Column:
    """Names (or URLs) of an ``authors`` array, or of the single legacy ``author``.

    Both arguments are arrays of ``struct<name, url>``; the second is used when the first is empty.
    """
    chosen = F.when(F.size(F.coalesce(authors, F.array())) > 0, authors).otherwise(author)
    return F.filter(
        F.transform(chosen, lambda a: F.coalesce(optional_text(a["name"]), optional_text(a["url"]))),
        lambda n: n.isNotNull(),
    )


def forum_url(permalink: Column, fallback: Column, root: str = "https://www.reddit.com") -> Column:
    """Site URL for a rooted permalink, else the fallback."""
    path = F.coalesce(strip(permalink), F.lit(""))
    return F.when(path.startswith("/"), F.concat(F.lit(root), path)).otherwise(fallback)


def prom_escape(c: Column) -> Column:
    """Escape a metrics label: backslash, quote, newline."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def truncate(c: Column, length: int = 120) -> Column:
    """White space collapsed; longer text ends in an ellipsis."""
    text = collapse(F.coalesce(c, F.lit("")))
    cut = F.concat(F.substring(text, 1, length - 1), F.lit("…"))
    return F.when(F.length(text) > length, cut).otherwise(text)


def age_text(ts: Column, now: Column) -> Column:
    """How long before ``now``, as a count of seconds, minutes, hours or days.

    Beyond 30 days the date itself is shown; a missing time reads ``Never``.
    """
    sec = F.round((F.unix_micros(now) - F.unix_micros(ts)) / 1e6).cast("long")
    minutes = F.round(sec / 60).cast("long")
    hours = F.round(minutes / 60).cast("long")
    days = F.round(hours / 24).cast("long")

    def unit(n: Column, name: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return (
        F.when(ts.isNull(), "Never")
        .when(F.abs(sec) < 60, unit(sec, "second"))
        .when(F.abs(minutes) < 60, unit(minutes, "minute"))
        .when(F.abs(hours) < 24, unit(hours, "hour"))
        .when(F.abs(days) < 30, unit(days, "day"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )


def initials(source: Column) -> Column:
    """Two upper-case letters: of the first two parts, else the first two characters."""
    name = F.when(F.coalesce(source, F.lit("")) == "", "?").otherwise(source)
    parts = F.filter(F.split(name, "[-_:/]"), lambda p: p != "")
    two = F.array_join(F.transform(F.slice(parts, 1, 2), lambda p: F.substring(p, 1, 1)), "")
    return F.upper(F.when(F.size(parts) > 1, two).otherwise(F.substring(name, 1, 2)))
