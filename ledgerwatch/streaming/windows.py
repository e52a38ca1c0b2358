"""Sliding windows over micro-batches, and optional removal of repeated ids.

A batch is reduced to additive rows per pane, the span of one slide: (key, pane, kind; count,
amount), at most one row per event. Reading adds the panes of all batches up and forms windows
as running differences: a pane enters at the first window that covers it and leaves after the
last. However the input is cut into batches, and however late a row comes, the result is the same;
nothing is dropped and no state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, SLIDE = "48 hours", "15 minutes"


def pane_totals(batch: DataFrame, key: str, ts: str, amount: str, kind: str, slide: str = SLIDE) -> DataFrame:
    """Count and amount per key, pane and kind of one batch."""
    return (
        batch.groupBy(key, F.window(ts, slide), F.col(kind).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"))
        .select(key, F.col("window.start").alias("pane"), "kind", "n", "amount")
    )


def _changes(panes: DataFrame, key: str, window: str, slide: str) -> DataFrame:
    """When counts and amounts of a (key, kind) rise and fall, one row per time."""
    span, step = (F.expr(f"INTERVAL {x}") for x in (window, slide))
    zero = F.lit(0).cast("bigint")

    def change(at: Column, sign: int) -> Column:
        return F.struct(at.alias("at"), (zero + sign * F.col("n")).alias("n"), (sign * F.col("amount")).alias("amount"))

    both = F.array(change(F.col("pane") - span + step, 1), change(F.col("pane") + step, -1))
    return panes.select(key, "kind", F.explode(both).alias("c")).groupBy(key, "kind", "c.at").agg(F.sum("c.n").alias("n"), F.sum("c.amount").alias("amount"))


def window_totals(panes: DataFrame, key: str, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """Count, amount and distinct kinds per key and window that holds an event, over the panes of all batches.

    ``window`` is a multiple of ``slide``. Sums run over panes of one (key, kind), whose number is
    bounded by the time covered, not by events; between two changes all windows have the same sums.
    """
    order = Window.partitionBy(key, "kind").orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = _changes(panes, key, window, slide).select(
        key, "kind", "at", F.lead("at").over(order).alias("next"), F.sum("n").over(running).alias("n"), F.sum("amount").over(running).alias("amount")
    )
    starts = F.sequence("at", F.col("next") - F.expr(f"INTERVAL {slide}"), F.expr(f"INTERVAL {slide}"))
    by_kind = steps.where("n > 0").select(key, F.explode(starts).alias("window_start"), "kind", "n", "amount")
    return by_kind.groupBy(key, "window_start").agg(
        F.sum("n").alias("txn_count"), F.sum("amount").alias("amount"), F.count("kind").alias("distinct_types")
    )


def deduplicated(stream: DataFrame, key: str = "txn_id", ts: str = "txn_ts", late: str = "1 hour") -> DataFrame:
    """Optionally drop repeated ids that arrive within the watermark (a check counts them otherwise)."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
