"""Calendar intervals over timestamps (UTC): floor, ceil, round, offset, range, count, every."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIXED = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
_WEEKDAYS = {name: i for i, name in enumerate("sunday monday tuesday wednesday thursday friday saturday".split())}


class Interval:
    """One unit: millisecond to year, week (from Sunday) or a weekday name (weeks from that day)."""

    def __init__(self, unit: str):
        self.unit = "week" if unit in _WEEKDAYS else unit
        self.start = _WEEKDAYS.get(unit, 0)
        if self.unit not in (*_FIXED, "month", "year"):
            raise ValueError(f"unknown unit {unit!r}")

    def floor(self, ts: Column) -> Column:
        ts = ts.cast("timestamp")
        if self.unit == "week":
            shift = (8 - self.start) % 7  # days that bring the week's start to a Monday
            return (F.date_trunc("week", F.timestamp_add("DAY", F.lit(shift), ts)) if shift else F.date_trunc("week", ts)) - F.make_dt_interval(F.lit(shift))
        return F.date_trunc(self.unit, ts)

    def offset(self, ts: Column, step: Column | int) -> Column:
        """Adds units; the day of a month that is too short rolls over into the next."""
        step = F.floor(F.lit(step) if isinstance(step, (int, float)) else step).cast("int")
        ts = ts.cast("timestamp")
        if self.unit in ("month", "year"):
            months = step * (12 if self.unit == "year" else 1)
            first = F.add_months(F.trunc(ts.cast("date"), "month"), months)
            day = F.date_add(first, F.dayofmonth(ts) - 1)
            return F.timestamp_add("MICROSECOND", F.timestamp_diff("MICROSECOND", F.date_trunc("day", ts), ts), day.cast("timestamp"))
        return F.timestamp_millis(F.unix_millis(ts) + step.cast("long") * F.lit(_FIXED[self.unit])) + F.make_dt_interval(secs=(F.unix_micros(ts) % 1000 / F.lit(1_000_000)).cast("decimal(18,6)"))

    def ceil(self, ts: Column) -> Column:
        """The first boundary not before ts; ts counts in whole milliseconds."""
        ms = F.timestamp_millis(F.unix_millis(ts.cast("timestamp")))
        return self.offset(self.floor(F.timestamp_millis(F.unix_millis(ms) - 1)), 1)

    def round(self, ts: Column) -> Column:
        """The nearer boundary; the later one on a tie."""
        ms = F.timestamp_millis(F.unix_millis(ts.cast("timestamp")))
        low, high = self.floor(ms), self.ceil(ms)
        return F.when(F.unix_millis(ms) - F.unix_millis(low) < F.unix_millis(high) - F.unix_millis(ms), low).otherwise(high)

    def count(self, start: Column, end: Column) -> Column:
        """Boundaries after start and up to end."""
        a, b = self.floor(start), self.floor(end)
        if self.unit == "month":
            return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")
        if self.unit == "year":
            return (F.year(b) - F.year(a)).cast("long")
        return F.floor((F.unix_millis(b) - F.unix_millis(a)) / F.lit(_FIXED[self.unit])).cast("long")

    def range(self, start: Column, stop: Column, step: int = 1) -> Column:
        """Every step-th boundary from start, before stop; empty if there are none, or for a step below 1."""
        first, last = self.ceil(start), self.ceil(stop)
        n = F.ceil(self.count(first, last) / step) if step >= 1 else F.lit(0)
        steps = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: self.offset(first, i * step))
        return F.when(n > 0, steps).otherwise(F.array().cast("array<timestamp>"))

    def floor_where(self, ts: Column, test, reach: int) -> Column:
        """The latest of the `reach` boundaries at or before ts that passes the test; null if none does."""
        low = self.floor(ts)
        return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(reach - 1)), lambda i: self.offset(low, -i)), test), F.lit(0))

    def ceil_where(self, ts: Column, test, reach: int) -> Column:
        """The first of the `reach` boundaries at or after ts that passes the test; null if none does."""
        high = self.ceil(ts)
        return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(reach - 1)), lambda i: self.offset(high, i)), test), F.lit(0))

    def every(self, ts: Column, k: int) -> Column:
        """The boundary at or before ts whose field is a multiple of k (days restart each month)."""
        ts = ts.cast("timestamp")
        if k < 1:
            return F.lit(None).cast("timestamp")
        if self.unit == "year":
            return F.make_date(F.floor(F.year(ts) / k).cast("int") * k, F.lit(1), F.lit(1)).cast("timestamp")
        if self.unit == "month":
            return F.make_date(F.year(ts), F.floor((F.month(ts) - 1) / k).cast("int") * k + 1, F.lit(1)).cast("timestamp")
        if self.unit == "day":
            return F.date_sub(ts.cast("date"), (F.dayofmonth(ts) - 1) % k).cast("timestamp")
        field = {"millisecond": F.unix_millis(ts), "second": F.second(ts), "minute": F.minute(ts), "hour": F.hour(ts), "week": F.floor(F.unix_millis(self.floor(ts)) / F.lit(_FIXED["week"]))}[self.unit]
        low = F.timestamp_millis(F.unix_millis(ts)) if self.unit == "millisecond" else self.floor(ts)
        return self.offset(low, -(field % k).cast("int"))
