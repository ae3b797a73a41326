"""How users engage with the recommendations, from their events.

``events`` has ``event_type, user_id, gmap_id, ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.operators.ranking import top_n

# Fixed values
ENTERED, CLICKED, EXITED = "user_entered", "url_click", "user_exited"

VISIT_GAP_SECONDS = 30 * 60
ENGAGED_SECONDS = 60 * 60


def is_click() -> Column:
    return F.col("event_type") == CLICKED


def clicks_per_item(events: DataFrame, n: int | None = None) -> DataFrame:
    """Clicks per recommended item, the ``n`` most clicked ones if given."""
    counts = events.where(is_click()).groupBy("gmap_id").agg(F.count(F.lit(1)).alias("n_clicks"))
    return counts if n is None else top_n(counts, n, F.desc("n_clicks"), "gmap_id")


def click_through(events: DataFrame) -> DataFrame:
    """Per day: users who entered, users who clicked, and their ratio.

    One row per day and user first, so a busy user is combined in the map tasks and no distinct is
    left to count.
    """
    flags = events.groupBy(F.unix_date(F.to_date(F.window("ts", "1 day")["start"])).alias("day"), "user_id").agg(
        F.max(F.when(F.col("event_type") == ENTERED, 1).otherwise(0)).alias("entered"),
        F.max(F.when(is_click(), 1).otherwise(0)).alias("clicked"),
    )
    return flags.groupBy("day").agg(
        F.sum("entered").alias("users_entered"),
        F.sum("clicked").alias("users_clicked"),
        F.try_divide(F.sum("clicked"), F.sum("entered")).alias("click_through"),
    )


def visits(events: DataFrame, gap_seconds: int = VISIT_GAP_SECONDS) -> DataFrame:
    """Visits: events of one user with less than the gap between neighbours, with clicks.

    Two events in the same slot of one gap's width belong to one visit. Slots are summed first, with
    map-side combining; what a user's visits are then found from has one row per slot at most,
    however many events the user sent.
    """
    gap = gap_seconds * 1000
    ms = F.unix_millis("ts")
    slots = events.groupBy("user_id", F.floor(ms / gap).alias("slot")).agg(
        F.min(ms).alias("first"),
        F.max(ms).alias("last"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(is_click()).alias("n_clicks"),
    )
    in_order = Window.partitionBy("user_id").orderBy("slot")
    opens = F.col("first") - F.lag("last").over(in_order) >= gap
    numbered = slots.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn(
        "visit", F.sum("opens").over(in_order)
    )
    return (
        numbered.groupBy("user_id", "visit")
        .agg(
            F.min("first").alias("start_ms"),
            F.max("last").alias("last_ms"),
            F.sum("n_events").alias("n_events"),
            F.sum("n_clicks").alias("n_clicks"),
        )
        .drop("visit")
    )


def engaged_clicks(events: DataFrame, within_seconds: int = ENGAGED_SECONDS) -> DataFrame:
    """Clicks at most this long after an enter of the same user, each once.

    In slots of that width an enter that fits is in the click's slot or in the one before. It is there
    just when the first enter of the slot is not after the click, or the last one of the slot before
    is not too early. So enters are one row per user and slot, and no pair is emitted.
    """
    span = within_seconds * 1000
    ms = F.unix_millis("ts")
    slot = F.floor(ms / span)
    none = F.lit(None).cast("bigint")
    here = F.struct(slot.alias("slot"), ms.alias("own"), none.alias("before"))
    later = F.struct((slot + 1).alias("slot"), none.alias("own"), ms.alias("before"))
    enters = (
        events.where(F.col("event_type") == ENTERED)
        .select("user_id", F.explode(F.array(here, later)).alias("e"))
        .groupBy("user_id", F.col("e.slot").alias("slot"))
        .agg(F.min("e.own").alias("first_here"), F.max("e.before").alias("last_before"))
    )
    clicks = events.where(is_click()).select("user_id", "gmap_id", ms.alias("click_ms"), slot.alias("slot"))
    click = F.col("click_ms")
    fits = (F.col("first_here") <= click) | (F.col("last_before") >= click - span)
    return clicks.join(enters, ["user_id", "slot"]).where(fits).select("user_id", "gmap_id", "click_ms")
