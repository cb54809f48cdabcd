"""Numbers and dates: change, rounding, periods and comparison windows.

No operator reads the wall clock: every window hangs on an explicit `as_of` date.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed period lengths in days.
PERIODS = {"24h": 1, "7d": 7, "28d": 28, "30d": 30, "90d": 90, "3m": 90, "6m": 180, "12m": 365, "16m": 480, "2y": 730, "3y": 1095}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(x: Column | str, digits: int = 0) -> Column:
    """Half-up rounding toward plus infinity."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.5) / F.lit(scale)


def pct_change(now: Column | str, before: Column | str, zero_baseline: str = "full") -> Column:
    """Change in percent; over a zero baseline 100 ("full", where there is anything now), 0 ("zero") or null ("null")."""
    n, b = col(now).cast("double"), col(before).cast("double")
    at_zero = {"full": F.when(n > 0, 100.0).otherwise(0.0), "zero": F.lit(0.0), "null": F.lit(None).cast("double")}[zero_baseline]
    return F.when(b == 0, at_zero).otherwise((n - b) / b * 100)


def ctr(clicks: Column | str, impressions: Column | str) -> Column:
    return F.when(col(impressions) > 0, col(clicks) / col(impressions)).otherwise(0.0)


def exact_sum(x: Column | str) -> Column:
    """Sum of doubles that does not depend on the order of rows."""
    return F.sum(col(x).cast("decimal(28,6)")).cast("double")


def mean_position(position: Column | str, weight: Column | str | None = None) -> Column:
    """Mean of rows, or weighted by impressions; null without rows or weight."""
    p = col(position)
    if weight is None:
        return exact_sum(p) / F.count(p)
    total = F.sum(F.when(p.isNotNull(), col(weight)))
    return F.when(total > 0, exact_sum(p * col(weight)) / total)


def period_days(name: str, as_of: date) -> int:
    """Days of a named period; ytd and this_month count up to as_of."""
    if name == "ytd":
        return (as_of - date(as_of.year, 1, 1)).days + 1
    if name == "this_month":
        return as_of.day
    return PERIODS[name]


@dataclass(frozen=True)
class Windows:
    """A window and the one before it, both ends included."""

    start: date
    end: date
    before_start: date
    before_end: date

    def when(self, day: Column | str) -> Column:
        """'now', 'before' or null."""
        d = col(day)
        return F.when(d.between(F.lit(self.start), F.lit(self.end)), "now").when(d.between(F.lit(self.before_start), F.lit(self.before_end)), "before")

    def covers(self, day: Column | str) -> Column:
        return col(day).between(F.lit(self.before_start), F.lit(self.end))


def windows(as_of: date, days: int | str, lag: int = 0, match_weekday: bool = False) -> Windows:
    """The last `days` days up to as_of - lag, and as many before; match_weekday moves those back to whole weeks."""
    n = period_days(days, as_of) if isinstance(days, str) else days
    end = as_of - timedelta(days=lag)
    start = end - timedelta(days=n - 1)
    shift = -n % 7 if match_weekday else 0
    return Windows(start, end, start - timedelta(days=n + shift), start - timedelta(days=1 + shift))


def week_key(day: Column | str) -> Column:
    """Year and week number counted from 1 January, for weekly de-duplication."""
    d = col(day)
    return F.concat_ws("-W", F.year(d).cast("string"), F.lpad(F.floor((F.dayofyear(d) - 1) / 7 + 1).cast("string"), 2, "0"))


def rank_potential(volume: Column | str, clicks: Column | str) -> Column:
    """A tenth of the volume that clicks do not reach yet."""
    return F.greatest(F.lit(0.0), js_round(col(volume) * 0.1) - col(clicks))


def checkpoint_due(live_at: Column | str, day: Column | str | int, as_of: date, settle: int = 3) -> Column:
    d = F.lit(day) if isinstance(day, int) else col(day)
    return F.datediff(F.lit(as_of), F.to_date(col(live_at))) >= d + settle


def parse_moment(text: Column | str) -> Column:
    """Timestamp from epoch milliseconds or ISO text in one string column; null where it is neither."""
    s = F.trim(col(text))
    millis = F.when(s.rlike("^-?[0-9]{10,16}$"), F.timestamp_millis(s.try_cast("bigint")))
    return F.coalesce(millis, F.try_to_timestamp(F.regexp_replace(s, "T", " ")))
