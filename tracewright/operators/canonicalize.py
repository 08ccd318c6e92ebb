"""Activity names to a canonical vocabulary, with coverage and bijection checks.

The vocabulary is a table ``dataset, raw, canonical`` the caller supplies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import collapse, norm_key, quoted, strip
from tracewright.scale import broadcast_if_small
from tracewright.schema import ACTIVITY_NAMES, resolve_column


def normal_map(activity_map: DataFrame) -> DataFrame:
    """Keys and values in lookup form, one row per key."""
    return activity_map.select(
        "dataset",
        norm_key(F.col("raw")).alias("_key"),
        F.lower(collapse(F.col("canonical"))).alias("canonical"),
    ).distinct()


def canonicalize(
    events: DataFrame, activity_map: DataFrame, strict: bool = False
) -> DataFrame:
    """Replace ``activity``; names outside the map keep their lower-cased text.

    ``strict`` raises when a name is not covered or two names fall together.
    """
    if strict:
        _raise_if_any(check_activity_map(activity_map), "activity map is not one-to-one")
        _raise_if_any(unknown_activities(events, activity_map), "activities outside the map")
    lookup = broadcast_if_small(normal_map(activity_map))
    keyed = events.withColumn("_key", norm_key(F.col("activity")))
    return (
        keyed.join(lookup, ["dataset", "_key"], "left")
        .withColumn("activity", F.coalesce("canonical", F.lower("_key")))
        .select(*events.columns)
    )


def unknown_activities(events: DataFrame, activity_map: DataFrame) -> DataFrame:
    """Distinct names per dataset that the map does not cover, with event counts."""
    names = (
        events.groupBy("dataset", "activity").agg(F.count("*").alias("n"))
        .groupBy("dataset", norm_key(F.col("activity")).alias("_key"))
        .agg(F.sum("n").alias("n_events"))
        .where("_key <> ''")
    )
    return names.join(normal_map(activity_map), ["dataset", "_key"], "left_anti").select(
        "dataset", F.col("_key").alias("activity"), "n_events"
    )


def check_activity_map(activity_map: DataFrame) -> DataFrame:
    """Keys with several names and names with several keys; empty when one-to-one."""
    m = normal_map(activity_map)

    def repeated(by: str, other: str, problem: str) -> DataFrame:
        return (
            m.groupBy("dataset", F.col(by).alias("name"))
            .agg(F.array_sort(F.collect_set(other)).alias("others"))
            .where(F.size("others") > 1)
            .select("dataset", F.lit(problem).alias("problem"), "name", "others")
        )

    return repeated("_key", "canonical", "key with several names").unionByName(
        repeated("canonical", "_key", "name with several keys")
    )


def mapping_summary(events: DataFrame, activity_map: DataFrame) -> DataFrame:
    """Per dataset: distinct raw and canonical names, and whether they pair up.

    The map is joined to the distinct names only, after they are combined.
    """
    names = (
        events.select("dataset", "activity").distinct()
        .select("dataset", norm_key(F.col("activity")).alias("_key"))
        .where("_key <> ''").distinct()
    )
    mapped = names.join(normal_map(activity_map), ["dataset", "_key"], "left").withColumn(
        "name", F.coalesce("canonical", F.lower("_key"))
    )
    return mapped.groupBy("dataset").agg(
        F.count_distinct("_key").alias("raw_activity_types"),
        F.count_distinct("name").alias("mapped_activity_types"),
    ).withColumn(
        "one_to_one", F.col("raw_activity_types") == F.col("mapped_activity_types")
    )


def rank_activity_columns(
    df: DataFrame, activity_map: DataFrame, dataset: str,
    preferred: Sequence[str] = tuple(ACTIVITY_NAMES),
) -> DataFrame:
    """String columns whose values occur in the map, best first.

    Ranked by: all values covered, preferred name, number of covered values, name.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    values = (
        df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), norm_key(F.col(quoted(c))).alias("_key"))
            for c in texts
        ])).alias("v"))
        .select("v.*").where("_key <> ''").distinct()
    )
    keys = normal_map(activity_map.where(F.col("dataset") == dataset)).select(
        "_key", F.lit(1).alias("hit")
    ).distinct()
    liked: Column = F.lower("column").isin([p.lower() for p in preferred])
    return (
        values.join(broadcast_if_small(keys), "_key", "left")
        .groupBy("column")
        .agg(F.count("*").alias("n_values"), F.count("hit").alias("overlap"))
        .where("overlap > 0")
        .select(
            "column",
            (F.col("overlap") == F.col("n_values")).cast("int").alias("all_covered"),
            liked.cast("int").alias("preferred"),
            "overlap", "n_values",
        )
    )


def detect_activity_column(
    df: DataFrame, activity_map: DataFrame, dataset: str, preferred: Sequence[str] = tuple(ACTIVITY_NAMES)
) -> str:
    """Name of the best ranked column, else of the first preferred one present."""
    best = (
        rank_activity_columns(df, activity_map, dataset, preferred)
        .orderBy(*[F.desc(c) for c in ("all_covered", "preferred", "overlap", "column")])
        .first()
    )
    if best is not None:
        return best["column"]
    return resolve_column(df.columns, preferred)


def activity_inventory(events: DataFrame) -> DataFrame:
    """Per dataset the sorted distinct non-blank activities.

    Names are combined before they are stripped, so text work is per name.
    """
    return (
        events.select("dataset", "activity").distinct()
        .select("dataset", strip(F.col("activity")).alias("activity"))
        .where("activity <> ''").distinct()
        .groupBy("dataset")
        .agg(F.array_sort(F.collect_list("activity")).alias("activities"))
    )


def _raise_if_any(problems: DataFrame, message: str) -> None:
    rows = problems.limit(20).collect()
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")
