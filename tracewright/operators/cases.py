"""One row per case, from aggregates that never gather its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.structs import record
from tracewright.functions.text import label_word, strip
from tracewright.operators.blocks import BLOCK_EVENTS
from tracewright.schema import CASE


def target_activity() -> Column:
    """Activity as a prediction target: stripped, case and inner blanks kept."""
    return strip(F.coalesce(F.col("activity"), F.lit("nan")))


def variant_id() -> Column:
    """Aggregate: fingerprint of the activity sequence, 120 bits and the length.

    Sums of md5 parts of (position, activity): equal sequences give equal ids,
    no order or gathering is needed, and map tasks combine.
    """
    digest = F.md5(F.concat_ws("|", F.col("seq").cast("string"), target_activity()))

    def part(at: int) -> Column:
        return F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)"))

    return F.concat_ws(
        "-", F.count("*").cast("string"), part(1).cast("string"), part(16).cast("string")
    )


def case_table(ordered: DataFrame, min_events: int = 3, label: str | None = "label") -> DataFrame:
    """Cases of at least ``min_events`` with length, variant and outcome.

    Cases without one clear outcome are dropped; ``outcomes.check_labels`` lists them.
    """
    aggs = [
        F.count("*").alias("trace_len"), variant_id().alias("variant_id"),
        F.min("in_order").alias("case_order"),
    ]
    if label:
        good = label_word(F.col(label)) == "success"
        unknown = F.count_if(F.col(label).isNotNull() & good.isNull())
        aggs += [F.min(good).alias("_low"), F.max(good).alias("_high"), unknown.alias("_unknown")]
    cases = ordered.groupBy(*CASE).agg(*aggs).where(F.col("trace_len") >= min_events)
    if not label:
        return cases
    word = F.when(F.col("_low"), "success").otherwise("failure")
    clear = cases.where("_low = _high AND _unknown = 0").withColumn("label", word)
    return clear.drop("_low", "_high", "_unknown")


def variant_texts(ordered: DataFrame, block: int = BLOCK_EVENTS) -> DataFrame:
    """The variant of every case written out, with its length.

    The text is as long as the case, whatever its length; use ``variant_id`` as a
    key. Names are joined block by block, so no list grows with the case.
    """
    event = record(seq=F.col("seq"), name=target_activity())
    blocks = ordered.groupBy(*CASE, F.floor(F.col("seq") / block).alias("block")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(event)).alias("events"))
    said = F.array_join(F.transform("events", lambda s: s["name"]), " || ")
    parts = blocks.select(*CASE, "n", record(block=F.col("block"), said=said).alias("part"))
    return parts.groupBy(*CASE).agg(
        F.sum("n").alias("trace_len"),
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["said"]), " || ").alias("variant"),
    )
