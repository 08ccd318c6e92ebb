"""Segments of long cases: the full case and evenly thinned sliding windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.narrative import (
    SENTENCES, Narrative, case_field_columns, case_sentence, with_event_sentences,
)
from tracewright.functions.structs import let, record
from tracewright.functions.text import compact_text
from tracewright.operators.blocks import BLOCK_EVENTS, between, case_blocks, story_text
from tracewright.operators.ordering import HotCases, order_events
from tracewright.scale import broadcast_if_small
from tracewright.schema import CASE


@dataclass(frozen=True)
class Windows:
    """Segmentation settings; the defaults are those of the corpus flow."""

    full_max: int = 40
    trigger: int = 40
    sizes: Sequence[int] = (16, 24, 32)
    stride: float = 0.5
    min_window: int = 8
    max_windows: int = 20
    full_with_windows_max: int = 64

    @property
    def usable(self) -> list[int]:
        return sorted({w for w in self.sizes if w >= self.min_window}, reverse=True)

    def step(self, size: int) -> int:
        return max(1, int(size * self.stride))

    @property
    def halo(self) -> int:
        return max(self.usable, default=1) - 1

    @property
    def block(self) -> int | None:
        """Smallest block holding any full story; None when cases of any length stay full."""
        if not self.usable:
            return None
        longest = max(self.full_max, self.trigger, self.full_with_windows_max, self.usable[-1])
        return max(BLOCK_EVENTS, longest, self.halo)


_RAW = "struct<position:bigint,slice_type:string,slice_start:bigint,slice_end:bigint>"


def with_segments(df: DataFrame, w: Windows) -> DataFrame:
    """Add ``segments``: those whose last event lies in the row's block.

    Needs ``trace_len`` and ``block``; gives an array of ``slice_id, slice_type,
    slice_start, slice_end``. Positions are computed, never enumerated over the
    case, so a case of any length yields a bounded array per block.
    """
    n, block = F.col("trace_len"), F.col("block")
    zero = F.lit(0).cast("long")
    lo = block * (w.block or 0)
    hi = F.least(n, lo + w.block) if w.block else n  # ends in (lo, hi]
    sliding = n > max(w.full_max, w.trigger)

    def count(s: int) -> Column:
        spare = n - s
        starts = F.floor(spare / w.step(s)) + 1 + F.when(spare % w.step(s) != 0, 1).otherwise(0)
        return F.when(sliding & (spare > 0), starts).otherwise(zero)

    # Columns _n<size> hold the windows per size, _windows those of this block.
    out = df.withColumns({f"_n{s}": count(s) for s in w.usable})
    total = sum((F.col(f"_n{s}") for s in w.usable), zero)
    none = F.array().cast(f"array<{_RAW}>")

    def of_size(s: int, offset: Column) -> list[Column]:
        step, windows = w.step(s), F.col(f"_n{s}")
        first = F.ceil(F.greatest(lo + 1 - s, zero) / step)
        last = F.floor(F.least(hi - s, n - s) / step)

        def at(position: Column, start: Column) -> Column:
            return record(
                position=position.cast("long"), slice_type=F.lit(f"window_{s}"),
                slice_start=start.cast("long"), slice_end=(start + s).cast("long"),
            )

        regular = F.when(
            (windows > 0) & (first <= last),
            F.transform(F.sequence(first, last), lambda j: at(offset + j, j * step)),
        ).otherwise(none)
        final = F.when(
            (windows > 0) & ((n - s) % step != 0) & (hi == n),
            F.array(at(offset + windows - 1, n - s)),
        ).otherwise(none)
        return [regular, final]

    parts, before = [none], zero
    for s in w.usable:
        parts += of_size(s, before)
        before = before + F.col(f"_n{s}")
    full = (~sliding) | (n <= w.full_with_windows_max) | (F.col("_total") == 0)
    out = (
        out.withColumns({"_total": total, "_windows": F.concat(*parts)})
        .withColumns({"_full": full, "_kept": _kept_positions(F.col("_total"), w.max_windows)})
    )
    windows, kept = F.col("_windows"), F.col("_kept")
    shift = F.when(F.col("_full"), 1).otherwise(0)
    if w.max_windows >= 0:
        windows = F.filter(windows, lambda x: kept.isNull() | F.array_contains(kept, x["position"]))

    def segment(x: Column) -> Column:
        place = F.when(kept.isNull(), x["position"]).otherwise(
            F.array_position(kept, x["position"]) - 1)
        return record(
            slice_id=(place + shift).cast("int"), slice_type=x["slice_type"],
            slice_start=x["slice_start"].cast("int"), slice_end=x["slice_end"].cast("int"),
        )

    whole = F.when(F.col("_full") & (block == 0), F.array(record(
        slice_id=F.lit(0), slice_type=F.lit("full"), slice_start=F.lit(0), slice_end=n.cast("int"),
    ))).otherwise(F.array().cast(
        "array<struct<slice_id:int,slice_type:string,slice_start:int,slice_end:int>>"))
    return out.withColumn("segments", F.concat(whole, F.transform(windows, segment))).drop(
        "_total", "_windows", "_full", "_kept", *[f"_n{s}" for s in w.usable]
    )


def _kept_positions(total: Column, m: int) -> Column:
    """Evenly spread positions when there are more than m windows; null keeps all."""
    if m < 0:
        return F.lit(None).cast("array<bigint>")
    if m == 0:
        even = F.array().cast("array<bigint>")
    elif m == 1:
        even = F.array(F.lit(0).cast("long"))
    else:
        even = F.transform(
            F.sequence(F.lit(0), F.lit(m - 1)),
            lambda i: F.when(i == m - 1, total - 1).otherwise(F.floor(i * ((total - 1) / (m - 1)))),
        )
    return F.when(total > m, even)


def segment_cases(
    ordered: DataFrame, w: Windows = Windows()
) -> DataFrame:
    """Segments of every case, without text: one row per segment.

    Needs only ``trace_len``; one row per block of a case, no event leaves its task.
    """
    size = w.block
    own = F.floor(F.col("seq") / size) if size else F.lit(0).cast("long")
    first = (F.col("seq") % size == 0) if size else (F.col("seq") == 0)
    blocks = ordered.where(first).select(*CASE, "trace_len", own.alias("block"))
    return with_segments(blocks, w).select(*CASE, "trace_len", F.inline("segments")).withColumn(
        "n_events", F.col("slice_end") - F.col("slice_start")
    )


def segment_stories(
    events: DataFrame,
    narratives: Mapping[str, Narrative],
    w: Windows = Windows(),
    intro: bool = True,
    quote: bool = True,
    hot: HotCases | None = None,
    story: bool = True,
) -> DataFrame:
    """Every segment told as text: the candidates of the story corpus.

    Case attributes come from the whole case. Sentences are rendered once per
    event and then sliced; one shuffle on the case. ``story=False`` leaves the text
    out: the same segments, to choose from before they are told.
    """
    ordered_columns = {"case_order": F.min("in_order")}
    fields = case_field_columns(events, narratives) if story else {}
    ordered = order_events(events, hot, {**ordered_columns, **fields})
    if story:
        ordered = with_event_sentences(ordered, narratives, quote)
    blocks = case_blocks(
        ordered, {**({c: F.col(c) for c in SENTENCES} if story else {}), "name": variant_name()},
        halo=w.halo, case_columns=["case_order", *fields], block=w.block,
    )
    if story:
        blocks = blocks.withColumn("case_text", case_sentence(events, narratives, intro))

    def tell(s: Column) -> Column:
        return let(between(s["slice_start"], s["slice_end"]), lambda part: record(
            slice_id=s["slice_id"], slice_type=s["slice_type"],
            slice_start=s["slice_start"], slice_end=s["slice_end"],
            n_events=s["slice_end"] - s["slice_start"],
            variant_key=F.array_join(F.transform(part, lambda e: e["name"]), " || "),
            **({"text": story_text(part, F.col("case_text"))} if story else {}),
        ))

    told = with_segments(blocks, w).select(
        *CASE, "case_order", F.inline(F.transform("segments", tell))
    )
    return told.where("text <> ''") if story else told


def tell_segments(
    events: DataFrame, chosen: DataFrame, narratives: Mapping[str, Narrative],
    w: Windows = Windows(), intro: bool = True, quote: bool = True, hot: HotCases | None = None,
) -> DataFrame:
    """``segment_stories`` of the chosen segments (``dataset, case_id, slice_id``) alone.

    Events of other cases are dropped before anything is shuffled or told.
    """
    cases = broadcast_if_small(chosen.select(*CASE).distinct())
    told = segment_stories(events.join(cases, CASE, "left_semi"), narratives, w, intro, quote, hot)
    return told.join(chosen.select(*CASE, "slice_id"), [*CASE, "slice_id"], "left_semi")


def case_stories(
    events: DataFrame, narratives: Mapping[str, Narrative], intro: bool = True, quote: bool = True,
    hot: HotCases | None = None,
) -> DataFrame:
    """``dataset, case_id, n_events, text``: every case told whole, whatever its length.

    Sentences are joined block by block and the blocks in order, so no list of
    events grows with the case; the text does.
    """
    fields = case_field_columns(events, narratives)
    ordered = order_events(events, hot, fields)
    blocks = case_blocks(
        with_event_sentences(ordered, narratives, quote), {c: F.col(c) for c in SENTENCES},
        halo=0, case_columns=list(fields),
    ).withColumn("case_text", case_sentence(events, narratives, intro))
    said = F.transform("events", lambda e: F.when(e["seq"] == 0, e["head"]).otherwise(e["mid"]))
    part = record(block=F.col("block"), said=F.array_join(F.filter(said, lambda x: x != ""), " "))
    whole = blocks.groupBy(*CASE).agg(
        F.sum(F.size("events")).alias("n_events"), F.first("case_text").alias("case_text"),
        F.array_sort(F.collect_list(part)).alias("parts"))
    said = F.concat(F.array("case_text"), F.transform("parts", lambda p: p["said"]))
    return whole.select(*CASE, "n_events", F.array_join(F.filter(said, lambda x: x != ""), " ").alias("text"))


def variant_name() -> Column:
    """Activity as it enters a segment's variant: compacted, lower case."""
    return F.lower(compact_text(F.coalesce(F.col("activity"), F.lit("nan"))))
