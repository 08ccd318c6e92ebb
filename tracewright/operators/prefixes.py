"""Prefixes of running cases: which lengths, and what is told and asked of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.narrative import (
    SENTENCES, Narrative, case_field_columns, case_sentence, with_event_sentences,
)
from tracewright.functions.structs import record
from tracewright.functions.text import hash_order, quoted
from tracewright.operators.blocks import BLOCK_EVENTS, between, case_blocks, story_text
from tracewright.operators.cases import target_activity
from tracewright.operators.ordering import HotCases, order_events
from tracewright.operators.sampling import balanced_sample, shuffled
from tracewright.scale import BROADCAST_BYTES, broadcast_if_small
from tracewright.schema import CASE, REMAINING_NAMES, resolve_column

DEFAULT_RATIOS = (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9)
# The stride of the walk over the open lengths: a prime, so that each comes once.
_STRIDE = (1 << 31) - 1


def thin_evenly(values: Column, n: int) -> Column:
    """At most n of a sorted array, evenly spread with both ends; n <= 1 keeps the last."""
    last = F.size(values) - 1
    if n <= 1:
        spread = F.array(F.get(values, last))
    else:
        spread = F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.get(values, F.bround(i * last / F.lit(n - 1)).cast("int")),
        ))
    return F.when(F.size(values) <= n, values).otherwise(spread)


def prefix_lengths(n: Column, cap: int, ratios: Sequence[float], seed: int) -> Column:
    """Lengths in 2 .. n-1, at most ``cap``: ends and anchors first, then random ones."""
    end = (n - 1).cast("long")
    two = F.lit(2).cast("long")
    anchors = F.array_sort(F.array_distinct(F.array(two, end, *[
        F.least(F.greatest(F.bround(n * F.lit(r)).cast("long"), two), end) for r in ratios
    ])))
    chosen = thin_evenly(anchors, cap)
    key = [F.col(c) for c in CASE]
    open_n = n - 2

    # A walk from a start drawn by hash, with a fixed stride: short for cases of any length.
    start = F.conv(F.substring(hash_order(seed, "prefix-walk", *key), 1, 7), 16, 10).cast("long")
    steps = F.least(open_n, F.lit(2 * cap + len(ratios) + 3)) - 1
    walk = F.transform(
        F.sequence(F.lit(0).cast("long"), F.greatest(steps, F.lit(0)).cast("long")),
        lambda t: 2 + (start + (F.lit(_STRIDE) % open_n) * t) % open_n,
    )
    more = F.array_except(walk, chosen)
    topped = F.concat(chosen, F.slice(more, F.lit(1), F.greatest(F.lit(cap) - F.size(chosen), F.lit(0))))
    return (
        F.when(n < 3, F.array().cast("array<bigint>"))
        .when(n - 2 <= cap, F.sequence(two, end))
        .otherwise(F.array_sort(topped))
    )


def plan_prefixes(
    cases: DataFrame, cap: int = 6, ratios: Sequence[float] = DEFAULT_RATIOS, seed: int = 3407
) -> DataFrame:
    """One row per planned prefix of each case (``cap`` per case; all when cap <= 0)."""
    n = F.col("trace_len")
    if cap > 0:
        lengths = prefix_lengths(n, cap, ratios, seed)
    else:
        # Two levels, so that no array grows with the case.
        width = F.lit(4096).cast("long")
        first = F.lit(2).cast("long")
        starts = F.when(n > 2, F.sequence(first, n - 1, width))
        cases = cases.withColumn("_from", F.explode(starts))
        lengths = F.sequence("_from", F.least(F.col("_from") + width - 1, n - 1))
    return cases.withColumn("prefix_len", F.explode(lengths)).drop("_from")


def cap_prefixes(plan: DataFrame, n: int, seed: int, ratio: float | None = None) -> DataFrame:
    """At most n prefixes per dataset and split, round-robin over cases; n <= 0 keeps all.

    With ``ratio``, the validation split gets max(1, round(n * ratio)).
    """
    if n <= 0:
        return plan
    keys = ["dataset", "split"]
    small = n if ratio is None else max(1, round(n * ratio))
    targets = plan.select(*keys).distinct().withColumn(
        "target", F.when(F.col("split") == "validation", small).otherwise(n).cast("long")
    )
    place = hash_order(seed, "plan", *[F.col(c) for c in CASE], F.col("prefix_len"))
    return balanced_sample(
        plan, None, -1, "case_id", [place, F.col("prefix_len")],
        hash_order(seed, "plan-round", *[F.col(c) for c in CASE]),
        keys=keys, targets=targets,
    )


def prefix_blocks(
    events: DataFrame, narratives: Mapping[str, Narrative], max_events: int = 40,
    quote: bool = True, hot: HotCases | None = None, remaining: str | None = None,
    case_columns: Mapping[str, Column] | None = None, story: bool = True,
) -> DataFrame:
    """Blocks of told events, from which any prefix of the case can be cut.

    A prefix of length k lies in the block of event k (the one to predict) and
    reaches back ``max_events``. With ``max_events <= 0`` whole prefixes are
    told, so each case stays in one row: for logs of short cases only.
    """
    fields = case_field_columns(events, narratives)
    remaining = remaining or resolve_column(events.columns, REMAINING_NAMES, required=False)
    ordered = order_events(events, hot, {
        **fields, **(case_columns or {}), "_last": F.max_by("elapsed_time", "seq"),
    })
    left = F.col("_last") - F.col("elapsed_time")
    if remaining:
        known = F.col(quoted(remaining)).try_cast("double")
        left = F.coalesce(F.when(~F.isnan(known), known), left)
    if story:
        ordered = with_event_sentences(ordered, narratives, quote)
    sentences = {c: F.col(c) for c in SENTENCES} if story else {}
    return case_blocks(
        ordered,
        {"name": target_activity(), "left": F.floor(F.greatest(left, F.lit(0.0)))},
        halo=max(max_events, 0), case_columns=[*fields, *(case_columns or {})],
        block=None if max_events <= 0 else max(BLOCK_EVENTS, max_events), told=sentences,
    )


def _block_size(max_events: int) -> int | None:
    return None if max_events <= 0 else max(BLOCK_EVENTS, max_events)


def prefix_fields(k: Column, max_events: int, case_text) -> dict[str, Column]:
    """What is known of the prefix of length k, from the block that holds event k.

    Without ``case_text`` no story is told.
    """
    start = F.greatest(k - max_events, F.lit(0)) if max_events > 0 else F.lit(0).cast("long")
    n = F.col("trace_len")
    at = (k - F.col("first_seq")).cast("int")
    story = {} if case_text is None else {"input_story": story_text(between(start, k, "told"), case_text(k))}
    return {
        "prefix_len": k.cast("int"),
        "trace_len": n.cast("int"),
        "prefix_ratio": F.bround(k / F.greatest(n, F.lit(1)), 4),
        "story_segment_start": start.cast("int"),
        "story_n_events": (k - start).cast("int"),
        **story,
        "next_activity": F.get("events", at)["name"],
        "last_activity": F.get("events", at - 1)["name"],
        "remaining_time_days": F.get("events", at - 1)["left"].cast("long"),
    }


def planned_examples(
    events: DataFrame, plan: DataFrame, narratives: Mapping[str, Narrative],
    max_events: int = 40, intro: bool = True, quote: bool = True,
    hot: HotCases | None = None, remaining: str | None = None,
) -> DataFrame:
    """Story, targets and position of each planned prefix; plan columns are kept.

    Attributes told about the case come from the prefix only.
    """
    # Caps leave few cases: drop the others before anything is shuffled or told.
    told = events.join(broadcast_if_small(plan.select(*CASE).distinct()), CASE, "left_semi")
    blocks = prefix_blocks(told, narratives, max_events, quote, hot, remaining)
    size = _block_size(max_events)
    block = F.floor(F.col("_k") / size) if size else F.lit(0).cast("long")
    wanted = plan.drop("trace_len").withColumnRenamed("prefix_len", "_k").withColumn(
        "block", block
    )
    k = F.col("_k").cast("long")
    text = lambda n: case_sentence(events, narratives, intro, n)
    kept = [c for c in wanted.columns if c not in (*CASE, "_k", "block")]
    return wanted.join(blocks, [*CASE, "block"]).select(
        *CASE, *kept,
        *[c.alias(name) for name, c in prefix_fields(k, max_events, text).items()],
    )


def all_examples(
    events: DataFrame, cases: DataFrame | None, narratives: Mapping[str, Narrative],
    min_len: int = 2, max_events: int = 40, intro: bool = True, quote: bool = True,
    hot: HotCases | None = None, remaining: str | None = None, story: bool = True,
) -> DataFrame:
    """Every prefix from ``min_len`` to all but the last event, of the given cases or all.

    Prefixes are cut from each block in place; nothing is shuffled per prefix.
    ``story=False`` leaves the text out.
    """
    told, kept = events, []
    if cases is not None:
        kept = [c for c in cases.columns if c not in (*CASE, "trace_len")]
        chosen = broadcast_if_small(cases.drop("trace_len"))
        told = events.join(chosen.select(*CASE), CASE, "left_semi")
    blocks = prefix_blocks(
        told, narratives if story else {}, max_events, quote, hot, remaining, story=story
    )
    size = _block_size(max_events)
    first = F.lit(min_len).cast("long")
    last = F.col("trace_len") - 1
    if size:
        first = F.greatest(first, F.col("block") * size)
        last = F.least(last, F.col("block") * size + size - 1)
    text = (lambda n: case_sentence(events, narratives, intro, n)) if story else None
    examples = F.when(
        first <= last,
        F.transform(F.sequence(first, last), lambda k: record(**prefix_fields(k, max_events, text))),
    )
    if cases is not None:
        blocks = blocks.join(chosen, CASE)
    return blocks.select(*CASE, *kept, F.inline(examples))


def add_candidates(
    examples: DataFrame, inventory: DataFrame, outcomes: Sequence[str] = ("success", "failure"),
    seed: int = 3407, shuffle: bool = True,
) -> DataFrame:
    """Next-activity and outcome candidates of each prefix, in their own random order.

    ``inventory`` is ``canonicalize.activity_inventory`` of the whole log.
    """
    key = [F.col("dataset"), F.col("case_id"), F.col("prefix_len")]
    both = F.array(*[F.lit(o) for o in outcomes])
    out = examples.join(broadcast_if_small(inventory, max_bytes=BROADCAST_BYTES), "dataset")
    if not shuffle:
        return out.withColumnRenamed("activities", "next_candidates").withColumn(
            "outcome_candidates", both
        )
    return out.withColumns({
        "next_candidates": shuffled(F.col("activities"), seed, "next", *key),
        "outcome_candidates": shuffled(both, seed, "outcome", *key),
    }).drop("activities")
