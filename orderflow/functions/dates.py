"""Dates and durations. Invalid dates become NULL, never the current time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.text import let, rx

# Date shapes found in order documents (day, month, year).
ANY_DATE = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
LONG_YEAR_DATE = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
FULL_DATE = r"(\d{2})[/-](\d{2})[/-](\d{4})"
SLASH_DATE = r"(\d{2}/\d{2}/\d{4})"
LOOSE_SLASH_DATE = r"(\d{1,2}/\d{1,2}/\d{4})"


def day_month_year(text: Column) -> Column:
    """First ``d/m/y`` or ``d-m-y`` in the text as a date; two-digit years are 2000+."""

    def build(part: Column) -> Column:
        number = lambda i: F.get(part, F.lit(i)).try_cast("int")
        century = F.when(F.length(F.get(part, F.lit(2))) < 3, 2000).otherwise(0)
        zero = F.lit(0)
        return F.try_make_timestamp(
            number(2) + century, number(1), number(0), zero, zero, zero
        ).cast("date")

    return let(F.split(F.regexp_extract(text, rx(ANY_DATE), 0), "[/-]"), build)


def iso_day(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def iso_time(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def italian_day(value: Column) -> Column:
    return F.date_format(value, "d/M/yyyy")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, rounded; NULL unless both ends exist."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    # Halves go up, also below zero.
    return F.floor(micros / F.lit(1_000_000.0) + F.lit(0.5)).cast("long")


def duration_text(seconds: Column) -> Column:
    """``45s``, ``3m 5s`` or ``2h 10m``."""
    s = seconds.cast("long")
    minutes = F.floor(s / 60).cast("string")
    hours = F.floor(s / 3600).cast("string")
    rest = F.floor((s % 3600) / 60).cast("string")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(minutes, F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .when(s.isNotNull(), F.concat(hours, F.lit("h "), rest, F.lit("m")))
    )


def clock_text(seconds: Column) -> Column:
    """Elapsed time as ``mm:ss``, zero-padded; minutes may exceed two digits."""
    s = seconds.cast("long")
    minutes = F.floor(s / 60).cast("string")
    width = F.greatest(F.length(minutes), F.lit(2))
    return F.concat(
        F.lpad(minutes, width, F.lit("0")),
        F.lit(":"),
        F.lpad((s % 60).cast("string"), 2, "0"),
    )
