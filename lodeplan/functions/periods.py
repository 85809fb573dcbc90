"""Calendar buckets, half-open periods and point-in-interval conditions."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeplan.plans.errors import Reason, Refused

GRAINS = ("day", "week", "month", "quarter", "year")
_QUARTER = re.compile(r"\bq([1-4])\s+(\d{4})\b", re.IGNORECASE)


def bucket(at: Column, grain: str, zone: str = "UTC") -> Column:
    """Start of the bucket ``at`` falls in, as wall-clock time of the zone; weeks begin on Monday."""
    if grain not in GRAINS:
        raise Refused(Reason.UNSUPPORTED_CAPABILITY, f"grain {grain!r}")
    local = at if zone == "UTC" else F.from_utc_timestamp(at, zone)
    return F.date_trunc(grain, local)


def fiscal_bucket(at: Column, grain: str, first_month: int, zone: str = "UTC") -> Column:
    """First day of the fiscal quarter or year ``at`` falls in, by the zone's clock, for years that
    begin on the first of ``first_month``; null for null."""
    if grain not in ("quarter", "year") or not 1 <= first_month <= 12:
        raise Refused(Reason.UNSUPPORTED_CAPABILITY, f"fiscal {grain!r} from month {first_month}")
    local = at if zone == "UTC" else F.from_utc_timestamp(at, zone)
    return F.add_months(F.trunc(F.add_months(local, 1 - first_month), grain), first_month - 1)


def within(at: Column, start: Column, end: Column) -> Column:
    """Half-open period: start <= at < end."""
    return (at >= start) & (at < end)


def valid_at(at: Column, valid_from: Column, valid_to: Column) -> Column:
    """Half-open validity whose null end is open."""
    return (at >= valid_from) & ((at < valid_to) | valid_to.isNull())


def utc_month(at: Column) -> Column:
    """``yyyy-MM`` of an instant in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM")


def quarter_in(text: str) -> tuple[datetime, datetime] | None:
    """The UTC period of a quarter named in a text, such as ``Q2 2026``."""
    match = _QUARTER.search(text)
    if not match:
        return None
    first, year = int(match[1]) * 3 - 2, int(match[2])
    end = (year + 1, 1) if first == 10 else (year, first + 3)
    return datetime(year, first, 1, tzinfo=timezone.utc), datetime(*end, 1, tzinfo=timezone.utc)
