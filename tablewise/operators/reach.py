"""Distinct users over any range of hours, from sketches kept per hour.

Distinct counts of hours cannot be added up, sketches can: a theta sketch per hour and kind of event is
a bounded number of bytes, sketches of new hours are appended, and any range is a union. The users
who came but did not click are a difference of two unions.

Up to ``2 ** size`` users per range the figures are exact, beyond it their relative standard error is
``error(size)`` of the larger set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.engagement import CLICKED, ENTERED

SIZE = 12
_HOUR = 3_600_000


def error(size: int = SIZE) -> float:
    """Relative standard error of a full sketch."""
    return 1 / (2**size - 2) ** 0.5


def hourly_sketches(events: DataFrame, size: int = SIZE) -> DataFrame:
    """``(hour, event_type, users)``: a sketch of the users with an event of that kind in that hour (since
    the epoch). Several sketches of one hour, as from batches of a stream, are as good as one."""
    kept = events.where(F.col("event_type").isin(ENTERED, CLICKED) & F.col("user_id").isNotNull())
    hour = F.floor(F.unix_millis("ts") / _HOUR).alias("hour")
    return kept.groupBy(hour, "event_type").agg(F.theta_sketch_agg("user_id", size).alias("users"))


def _estimate(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("bigint")


def reach(sketches: DataFrame, ranges: DataFrame, size: int = SIZE) -> DataFrame:
    """Per range (columns ``first_hour`` and ``end_hour``, the end left out, and any others): users who
    entered, users who clicked, both, and users who entered without a click. A range without events has zeros."""
    keys = ranges.columns
    hours = ranges.where("end_hour > first_hour").select("*", F.explode(F.sequence(F.col("first_hour"), F.col("end_hour") - 1)).alias("hour"))
    of_kind = {
        name: F.theta_union_agg(F.when(F.col("event_type") == kind, F.col("users")), size).alias(name)
        for name, kind in (("entered", ENTERED), ("clicked", CLICKED))
    }
    met = hours.join(sketches, "hour").groupBy(*keys).agg(*of_kind.values())
    e, c = F.col("entered"), F.col("clicked")
    figures = met.select(
        *keys,
        _estimate(e).alias("users_entered"),
        _estimate(c).alias("users_clicked"),
        _estimate(F.theta_intersection(e, c)).alias("users_both"),
        _estimate(F.theta_difference(e, c)).alias("users_without_click"),
    )
    names = figures.columns[len(keys) :]
    return ranges.join(figures, keys, "left").select(*keys, *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])
