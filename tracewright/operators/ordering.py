"""Event order, time features and remaining time.

Ordinary cases are ordered by one window, one shuffle on the case. A case above
``HOT_CASE_EVENTS`` never enters such a window: its events are spread by range
over (time, input order), numbered inside each range, and the range totals are
added. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.scale import BROADCAST_ROWS, broadcast_if_small, checkpoint
from tracewright.schema import CASE

HOT_CASE_EVENTS = 2_000_000

# Seconds per unit.
UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


@dataclass(frozen=True)
class HotCases:
    """Cases too large for one task: at most (rows / limit) of them."""

    frame: DataFrame | None
    events: int
    limit: int

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(ordinary events, hot events or None)."""
        if self.frame is None:
            return df, None
        return df.join(self.frame, CASE, "left_anti"), df.join(self.frame, CASE, "left_semi")


def find_hot_cases(events: DataFrame, limit: int = HOT_CASE_EVENTS) -> HotCases:
    """Count events per case (two columns read, combined map-side) and keep the large.

    Call once per log and pass the result on when several operators need it.
    """
    large = events.groupBy(*CASE).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    n_cases, n_events = large.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_cases == 0:
        return HotCases(None, 0, limit)
    keys = large.select(*CASE)
    if n_cases <= BROADCAST_ROWS:
        keys = broadcast_if_small(keys)
    return HotCases(keys, n_events, limit)


def days_between(later: Column, earlier: Column, unit: str = "days") -> Column:
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return micros / F.lit(1e6) / F.lit(float(UNIT_SECONDS[unit]))


def _not_negative(days: Column) -> Column:
    return F.greatest(F.coalesce(days, F.lit(0.0)), F.lit(0.0))


def event_order() -> list[Column]:
    """By time, null times last, ties by input order."""
    return [F.col("ts").asc_nulls_last(), F.col("in_order").asc()]


def with_case_columns(
    df: DataFrame, columns: Mapping[str, Column], hot: HotCases | None = None
) -> DataFrame:
    """Add aggregates of the whole case to each of its events.

    Ordinary cases take them from a window over the case, which reuses its
    shuffle; hot cases from a combined aggregate joined back.
    """
    if not columns:
        return df
    hot = hot or find_hot_cases(df)
    cold, large = hot.split(df)
    whole = W.partitionBy(*CASE)
    out = cold.select("*", *[c.over(whole).alias(n) for n, c in columns.items()])
    if large is None:
        return out
    per_case = large.groupBy(*CASE).agg(*[c.alias(n) for n, c in columns.items()])
    return out.unionByName(large.join(broadcast_if_small(per_case), CASE))


def order_events(
    events: DataFrame,
    hot: HotCases | None = None,
    case_columns: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ``seq`` (from 0), ``elapsed_time`` and ``interval_time`` in days, ``trace_len``.

    When the log already has both time columns they are kept, cleaned, and the
    events stay in input order. ``case_columns`` are aggregates over the case
    that may use the new columns.
    """
    hot = hot or find_hot_cases(events)
    precomputed = {"elapsed_time", "interval_time"} <= set(events.columns)
    cold, large = hot.split(events)
    out = _order_by_window(cold, precomputed)
    if large is not None:
        out = out.unionByName(_order_by_range(large, hot, precomputed))
    columns = {"trace_len": F.count(F.lit(1)), **(case_columns or {})}
    return with_case_columns(out, columns, hot)


def _sort_columns(precomputed: bool) -> list[Column]:
    return [F.col("in_order").asc()] if precomputed else event_order()


def _clean_precomputed(df: DataFrame) -> DataFrame:
    def clean(name: str) -> Column:
        x = F.col(name).try_cast("double")
        return _not_negative(F.when(~F.isnan(x), x))

    return df.withColumns({n: clean(n) for n in ("elapsed_time", "interval_time")})


def _order_by_window(df: DataFrame, precomputed: bool) -> DataFrame:
    w = W.partitionBy(*CASE).orderBy(*_sort_columns(precomputed))
    seq = (F.row_number().over(w) - 1).cast("long").alias("seq")
    if precomputed:
        return _clean_precomputed(df.select("*", seq))
    start = F.min("ts").over(W.partitionBy(*CASE))
    return df.select(
        "*", seq,
        _not_negative(days_between(F.col("ts"), F.lag("ts").over(w))).alias("interval_time"),
        _not_negative(days_between(F.col("ts"), start)).alias("elapsed_time"),
    )


def _order_by_range(df: DataFrame, hot: HotCases, precomputed: bool) -> DataFrame:
    order = _sort_columns(precomputed)
    pieces = int(hot.events // hot.limit) + 1
    # Range bounds come from a sample, so the pieces must be frozen before their
    # number is used twice.
    spread = checkpoint(
        df.repartitionByRange(pieces, *[F.col(k) for k in CASE], *order).withColumn(
            "_piece", F.spark_partition_id()
        )
    )
    key = [*CASE, "_piece"]
    w = W.partitionBy(*key).orderBy(*order)
    totals = spread.groupBy(*key).agg(
        F.count("*").alias("_n"), F.max("ts").alias("_last"), F.min("ts").alias("_first")
    )
    # One row per case and piece; a case has at most ``pieces`` of them.
    before = W.partitionBy(*CASE).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *key,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.max("_last").over(before).alias("_before"),
        F.min("_first").over(W.partitionBy(*CASE)).alias("_start"),
    )
    local = spread.select(
        "*", (F.row_number().over(w) - 1).alias("_at"), F.lag("ts").over(w).alias("_prev")
    ).join(broadcast_if_small(totals), key)
    seq = (F.col("_offset") + F.col("_at")).cast("long")
    if precomputed:
        out = _clean_precomputed(local.withColumn("seq", seq))
    else:
        # Null times come last, so the event before a timed one is timed.
        previous = F.when(F.col("_at") > 0, F.col("_prev")).otherwise(F.col("_before"))
        out = local.withColumns({
            "seq": seq,
            "interval_time": _not_negative(days_between(F.col("ts"), previous)),
            "elapsed_time": _not_negative(days_between(F.col("ts"), F.col("_start"))),
        })
    return out.drop("_piece", "_at", "_prev", "_offset", "_before", "_start")


def add_remaining_time(
    events: DataFrame,
    unit: str = "days",
    round_digits: int | None = 0,
    out: str = "remaining_time",
    hot: HotCases | None = None,
) -> DataFrame:
    """Time from each event to the last of its case; null where the time is null.

    Rounded half to even; ``round_digits=None`` keeps the fraction.
    """
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unit must be one of {sorted(UNIT_SECONDS)}")
    df = with_case_columns(events, {"_end": F.max("ts")}, hot)
    left = days_between(F.col("_end"), F.col("ts"), unit)
    left = F.when(left.isNotNull(), F.greatest(left, F.lit(0.0)))
    if round_digits is not None:
        left = F.bround(left, round_digits)
    return df.withColumn(out, left).drop("_end")
