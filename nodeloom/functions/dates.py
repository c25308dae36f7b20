"""Time buckets and relative dates over epoch milliseconds, all in UTC; ``as_of`` is always given, never the clock."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(ms: Column, period: str) -> Column:
    """Key of the bucket: hour, day, week (Monday-based, 00 before the first Monday), week_iso, month, quarter or year."""
    t = F.timestamp_millis(ms)
    if period == "week":
        number = F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7).cast("int")
        return F.concat(F.date_format(t, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))
    if period == "week_iso":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    if period == "quarter":
        return F.concat(F.date_format(t, "yyyy"), F.lit("-Q"), F.quarter(t).cast("string"))
    formats = {"hour": "yyyy-MM-dd'T'HH':00:00'", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
    return F.date_format(t, formats[period])


def buckets_between(first: Column, last: Column, period: str) -> Column:
    """Start of every bucket from the one of ``first`` to the one of ``last`` (dates)."""
    step = {"day": "interval 1 day", "week_iso": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[period]
    unit = "week" if period == "week_iso" else period
    cut = lambda c: F.trunc(c, unit) if period != "day" else F.to_date(c)
    return F.sequence(cut(first), cut(last), F.expr(step))


def resolve_date(text: str, as_of: datetime) -> int:
    """Milliseconds of ``today``, ``yesterday``, ``7d``, ``2w``, ``1m``, ``1y`` (midnight of that day) or of an ISO date."""
    day = as_of.astimezone(timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
    if m := re.fullmatch(r"(\d+)([dwmy])", text):
        n, unit = int(m[1]), m[2]
        if unit in "dw":
            day -= timedelta(days=n * (7 if unit == "w" else 1))
        else:
            months = day.year * 12 + day.month - 1 - n * (12 if unit == "y" else 1)
            year, month = divmod(months, 12)
            last = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month]
            day = day.replace(year=year, month=month + 1, day=min(day.day, last))
    elif text in ("today", "yesterday"):
        day -= timedelta(days=int(text == "yesterday"))
    else:
        day = datetime.fromisoformat(text.replace("Z", "+00:00"))
        day = day if day.tzinfo else day.replace(tzinfo=timezone.utc)
    return int(day.timestamp() * 1000)


def bucket_range(ms: Column, period: str) -> tuple[Column, Column]:
    """First millisecond of the bucket and of the next one."""
    t = F.timestamp_millis(ms)
    unit, step = {"hour": ("hour", "interval 1 hour"), "day": ("day", "interval 1 day"), "week_iso": ("week", "interval 7 days"), "month": ("month", "interval 1 month"), "quarter": ("quarter", "interval 3 months"), "year": ("year", "interval 1 year")}[period]
    start = F.date_trunc(unit, t)
    return F.unix_millis(start), F.unix_millis(start + F.expr(step))


def period_ms(text: str) -> int:
    """Milliseconds of ``6h``, ``7d``, ``2w``, ``1m`` (30 days), ``1y`` (365 days)."""
    m = re.fullmatch(r"(\d+)([hdwmy])", text)
    if not m:
        raise ValueError(f"{text!r} is no period")
    return int(m[1]) * {"h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "m": 2_592_000_000, "y": 31_536_000_000}[m[2]]


def resolve_range(first: int | None, last: int | None, as_of_ms: int, days: int = 30) -> tuple[int, int, list[str]]:
    """A range in order that ends by ``as_of_ms``, the last ``days`` by default, with what was mended."""
    notes = []
    last = as_of_ms if last is None else last
    first = last - days * 86_400_000 if first is None else first
    if first > last:
        first, last = last, first
        notes.append("the ends were swapped")
    if last > as_of_ms:
        last = as_of_ms
        notes.append("the end lay in the future")
    return min(first, last), last, notes


def human_date(ms: Column) -> Column:
    """``Dec 17, 2025``."""
    return F.date_format(F.timestamp_millis(ms), "MMM d, yyyy")


def relative_date(ms: Column, as_of_ms: int) -> Column:
    """How long ago up to seven days (``just now``, ``5 minutes ago``, ``yesterday``), else the date."""
    gone = F.lit(as_of_ms) - ms
    whole = lambda unit: F.floor(gone / unit)
    said = lambda n, one, many: F.when(n == 1, one).otherwise(F.concat(n.cast("string"), F.lit(f" {many} ago")))
    minutes, hours, days = whole(60_000), whole(3_600_000), whole(86_400_000)
    return F.when(whole(1000) < 60, "just now").when(minutes < 60, said(minutes, "1 minute ago", "minutes")).when(hours < 24, said(hours, "1 hour ago", "hours")).when(days <= 7, said(days, "yesterday", "days")).otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"))
