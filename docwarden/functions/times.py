"""Timestamps with offsets, kept as text next to the instant."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docwarden import vocab

OFFSET_ISO = (
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2}(?::\d{2})?)\z"
)


def is_offset_iso(text: Column) -> Column:
    """ISO-8601 with an offset, and a date and time that exist."""
    seconds = F.regexp_replace(text, r"^(.{10}[T ]\d{2}:\d{2})(?=[Z+-])", "$1:00")
    return F.coalesce(
        text.rlike(OFFSET_ISO) & seconds.try_cast("timestamp").isNotNull(), F.lit(False)
    )


def iso_utc(ts: Column) -> Column:
    """``2026-09-01T13:50:00+00:00``, with microseconds only when there are any."""
    micros = F.unix_micros(ts) % 1_000_000
    fraction = F.when(micros == 0, "").otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00")
    )


def _instant(local: Column, zone: str) -> Column:
    part = lambda start, size: F.substring(local, start, size).try_cast("int")
    return F.try_make_timestamp(
        part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), F.lit(0), F.lit(zone)
    )


def local_to_offset_iso(local: Column, zone: str = vocab.LOGBOOK_ZONE) -> Column:
    """``2026-09-01 15:50`` in a zone as ISO text with that zone's offset; null if no such date.

    Of two instants in an autumn overlap the first is taken."""
    offset = (F.unix_seconds(_instant(local, "UTC")) - F.unix_seconds(_instant(local, zone))) / 60
    minutes = F.abs(offset).cast("int")
    two = lambda value: F.lpad(value.cast("int").cast("string"), 2, "0")
    return F.concat(
        F.replace(local, F.lit(" "), F.lit("T")),
        F.lit(":00"),
        F.when(offset < 0, "-").otherwise("+"),
        two(F.floor(minutes / 60)),
        F.lit(":"),
        two(minutes % 60),
    )


def is_zone_offset(text: Column, zone: str = vocab.LOGBOOK_ZONE) -> Column:
    """Whether the offset in ISO text is the one the zone has at that instant, which excludes
    times inside a spring gap."""
    instant = text.try_cast("timestamp")
    actual = F.unix_seconds(F.from_utc_timestamp(instant, zone)) - F.unix_seconds(instant)
    sign = F.when(F.substring(text, -6, 1) == "-", -1).otherwise(1)
    stated = sign * (
        F.substring(text, -5, 2).try_cast("int") * 3600
        + F.substring(text, -2, 2).try_cast("int") * 60
    )
    return F.coalesce(is_offset_iso(text) & (actual == stated), F.lit(False))
