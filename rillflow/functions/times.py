"""Timestamps out of text and numbers. The session zone is UTC, so zoneless input reads as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.functions.text import let, strip

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
_MAIL = (
    r"(?i)^(?:[a-z]{3,9}\.?,?\s+)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*\.?[\s-]+(\d{2}|\d{4})"
    r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(.*)$"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# Hour offsets of the zone names mail dates may carry.
_ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}


def to_utc(c: Column) -> Column:
    """A zoneless timestamp read as UTC."""
    return c.cast("timestamp")


def parse_iso(c: Column) -> Column:
    """ISO-8601 date or date-time; null when the text is anything else."""
    def read(t: Column) -> Column:
        # A colon in the zone and a point before the fraction, as the cast wants them.
        zoned = F.regexp_replace(F.replace(t, F.lit(","), F.lit(".")), r"(:\d{2}.*[+-]\d{2})(\d{2})$", "$1:$2")
        return F.when(t.rlike(_ISO), zoned.try_cast("timestamp"))

    return let(strip(c), read)


def parse_epoch(c: Column) -> Column:
    """Seconds since 1970, with fraction; null when not a number."""
    micros = F.round(c.try_cast("double") * 1_000_000)
    return F.timestamp_micros(micros.try_cast("long"))


def parse_mail_date(c: Column) -> Column:
    """RFC-822 style dates with numeric or named zones; an unknown zone reads as UTC."""
    return let(strip(c), lambda t: F.when(t.rlike(_MAIL), let(_fields(t), _utc_of_fields)))


def _fields(text: Column) -> Column:
    """Day, month, year, hour, minute, second and zone of a date that matches the pattern."""
    return F.split(F.regexp_replace(text, _MAIL, "$1|$2|$3|$4|$5|$6|$7"), r"\|")


def _utc_of_fields(f: Column) -> Column:
    year = f[2].try_cast("int")
    year = F.when(F.length(f[2]) == 4, year).when(year > 68, year + 1900).otherwise(year + 2000)
    month = F.floor((F.instr(F.lit(_MONTHS), F.lower(f[1])) + 2) / 3)
    stamp = F.format_string(
        "%04d-%02d-%02d %02d:%02d:%02d",
        year.cast("int"), month.cast("int"), f[0].try_cast("int"), f[3].try_cast("int"),
        f[4].try_cast("int"), F.coalesce(f[5].try_cast("int"), F.lit(0)),
    )
    local = F.when(month >= 1, stamp.try_cast("timestamp"))
    offset = let(F.upper(F.regexp_extract(f[6], r"^\(?([A-Za-z]+|[+-]\d{4})", 1)), _zone_seconds)
    return F.timestamp_micros(F.unix_micros(local) - offset * 1_000_000)


def _zone_seconds(zone: Column) -> Column:
    hours = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    numeric = F.when(zone.rlike(r"^[+-]\d{4}$"), sign * minutes * 60)
    return F.coalesce(numeric, F.try_element_at(hours, zone) * 3600, F.lit(0)).cast("bigint")


def feed_time(c: Column, fetched_at: Column) -> Column:
    """Mail date, else ISO, else the time the payload was fetched."""
    return F.coalesce(parse_mail_date(c), parse_iso(c), fetched_at)
