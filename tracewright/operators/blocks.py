"""Cases as arrays of bounded size.

A story needs its events side by side, but a case may hold most of a log. So a
case is cut into blocks of ``block`` events; each block also carries the last
``halo`` events of the one before, enough for any window or prompt that ends in
the block. A case of up to ``block`` events is a single row. Grouping by block
reuses the case shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.structs import record
from tracewright.schema import CASE

BLOCK_EVENTS = 256


def case_blocks(
    ordered: DataFrame, element: Mapping[str, Column], halo: int,
    case_columns: Sequence[str] = (), block: int | None = BLOCK_EVENTS,
    told: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``dataset, case_id, block, first_seq, trace_len, events, <case_columns>``.

    ``events`` are structs of ``seq`` and ``element``, in order; ``first_seq`` is
    the position of the first. ``block=None`` keeps each case in one row. ``told``
    gives the same events a second array of that name: the optimizer cannot drop a
    field of an array, but an array that nobody reads, and what was made for it.
    """
    if block is not None and halo > block:
        raise ValueError("halo must not exceed block")
    seq = F.col("seq")
    constant = ["trace_len", *case_columns]
    lists = {"events": record(seq=seq, **element), **({"told": record(seq=seq, **told)} if told else {})}
    event = [c.alias(f"_{n}") for n, c in lists.items()]
    if block is None:
        placed = ordered.select(*CASE, *constant, *event, F.lit(0).cast("long").alias("block"))
    else:
        own = F.floor(seq / block)
        reused = (seq % block >= block - halo) & ((own + 1) * block < F.col("trace_len"))
        placed = ordered.select(
            *CASE, *constant, *event,
            F.explode(F.when(reused, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"),
        )
    return (
        placed.groupBy(*CASE, "block")
        .agg(
            *[F.sort_array(F.collect_list(f"_{n}")).alias(n) for n in lists],  # array_sort runs a lambda per comparison
            *[F.first(c).alias(c) for c in constant],
        )
        .withColumn("first_seq", F.get("events", F.lit(0))["seq"])
    )


def between(start: Column, end: Column, events: str = "events") -> Column:
    """Events [start, end) of the case, from the block's array."""
    at = (start - F.col("first_seq") + 1).cast("int")
    return F.slice(events, at, (end - start).cast("int"))


def story_text(events: Column, case_sentence: Column) -> Column:
    """Case sentence, if any, head of the first event and the rest, joined by blanks."""
    parts = F.transform(events, lambda e, i: F.when(i == 0, e["head"]).otherwise(e["mid"]))
    parts = F.concat(F.array(case_sentence), parts)
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")
