"""Dates: parsing ladders, windows, weekends, seasons. Nothing reads the clock: `as_of` is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinelake.functions.text import col, is_blankish, squash

#: Tried after the ISO form, in this order: months come before days where slashes leave both open. Fixed values.
FORMATS = ("dd-MM-yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd")


def parse_date(c: Column | str) -> Column:
    """ISO date in the first ten characters (or eight digits), else the first format that fits the whole text; null for blankish cells."""
    text = squash(c)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")).when(text.rlike(r"^\d{8}(\D|$)"), F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))
    shapes = {"dd-MM-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "MM/dd/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "dd/MM/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "yyyy/MM/dd": r"^\d{4}/\d{1,2}/\d{1,2}$"}
    loose = {f: f.replace("dd", "d").replace("MM", "M") for f in FORMATS}
    return F.when(~is_blankish(c), F.coalesce(iso, *(F.when(text.rlike(shapes[f]), F.try_to_date(text, loose[f])) for f in FORMATS)))


def parse_long_date(c: Column | str) -> Column:
    """`Jan 5, 2026` or `January 5, 2026`."""
    text = squash(c)
    return F.coalesce(F.try_to_date(text, "MMM d, yyyy"), F.try_to_date(text, "MMMM d, yyyy"))


def article_date(c: Column | str, year: int | Column, as_of: dt.date) -> Column:
    """`Mon d` in the given year; a year later if that is over 45 days before as_of."""
    text = squash(c)
    full = F.concat(text, F.lit(", "), F.lit(year).cast("string") if isinstance(year, int) else year.cast("string"))
    found = F.when(text.rlike(r"\d{4}$"), parse_long_date(text)).otherwise(parse_long_date(full))
    return F.when(found < F.date_sub(F.lit(as_of), 45), F.add_months(found, 12)).otherwise(found)


def in_window(c: Column | str, start: dt.date, end: dt.date) -> Column:
    """Both ends included."""
    if end < start:
        raise ValueError("the end of a window is before its start")
    return col(c).between(F.lit(start), F.lit(end))


def window(kind: str, as_of: dt.date, start: dt.date | None = None, end: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """current, next_7, one_year or custom (which needs both dates)."""
    if kind == "current":
        return as_of, as_of
    if kind == "next_7":
        return as_of, as_of + dt.timedelta(days=7)
    if kind == "one_year":
        return as_of, as_of + dt.timedelta(days=365)
    if kind == "custom":
        if start is None or end is None:
            raise ValueError("a custom window needs both dates")
        if end < start:
            raise ValueError("the end of a window is before its start")
        return start, end
    raise ValueError(f"no such window: {kind}")


def opening_sunday(c: Column | str) -> Column:
    """The Sunday of the weekend that a film opens in: Monday to Thursday look ahead, Friday to Sunday are in it."""
    return F.date_add(col(c), F.lit(6) - F.weekday(col(c)))


def month_starts(start: Column | str, end: Column | str) -> Column:
    return F.sequence(F.trunc(col(start), "MM"), F.trunc(col(end), "MM"), F.expr("interval 1 month"))


def weekly_dates(start: Column | str, end: Column | str, most: int = 27) -> Column:
    """Every seventh day from start, then the end if the last step passed it; at most `most`."""
    steps = F.sequence(col(start), col(end), F.expr("interval 7 days"))
    whole = F.when(F.element_at(steps, -1) < col(end), F.array_append(steps, col(end))).otherwise(steps)
    return F.slice(whole, 1, most)


def season_end(start: Column | str, dates: Column | str) -> Column:
    """No episode dates: null; one day: thirty days after the start; several: the last."""
    days = F.array_distinct(F.array_compact(col(dates)))
    return F.when(F.size(days) == 1, F.date_add(F.coalesce(col(start), days[0]), 30)).when(F.size(days) > 1, F.array_max(days))


def change_label(old: Column | str, new: Column | str) -> Column:
    days = F.datediff(col(new), col(old))
    unit = F.when(F.abs(days) == 1, " day").otherwise(" days")
    return F.when(days == 0, "No change").when(days.isNotNull(), F.concat(F.lit("Moved "), F.when(days > 0, "later").otherwise("earlier"), F.lit(" by "), F.abs(days).cast("string"), unit)).otherwise("")


def hour_24(c: Column | str) -> Column:
    """Hour of `9p`, `9:30 am`, or `8/7c`, which from 7 to 11 is an evening hour; null if there is none."""
    text = F.coalesce(col(c), F.lit(""))
    pattern = r"(?i)\b(1[0-2]|0?[1-9])(?::[0-5]\d)?\s*([ap])(?:\.?m\.?)?\b"
    hour, half = F.regexp_extract(text, pattern, 1).try_cast("int"), F.lower(F.regexp_extract(text, pattern, 2))
    eastern = F.regexp_extract(text, r"(?i)\b(1[0-2]|0?[1-9])/(?:1[0-2]|0?[1-9])c\b", 1).try_cast("int")
    return F.coalesce(hour % 12 + F.when(half == "p", 12).otherwise(0), F.when(eastern.between(7, 11), eastern + 12).otherwise(eastern))


def daypart_of_hour(hour: Column) -> Column:
    return (
        F.when(hour.between(5, 8), "Early Morning").when(hour.between(9, 15), "Daytime").when(hour.between(16, 18), "Early Fringe")
        .when(hour.between(19, 22), "Primetime").when(hour.isNotNull(), "Late Night")
    )


def display_date(c: Column | str) -> Column:
    return F.coalesce(F.date_format(col(c), "dd-MM-yyyy"), F.lit(""))
