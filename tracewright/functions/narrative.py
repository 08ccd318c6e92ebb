"""Readable sentences for events and cases, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.structs import record
from tracewright.functions.text import (
    compact_text, end_compact, end_sentence, floor_days, join_phrases, quoted, value_text,
)


@dataclass(frozen=True)
class Field:
    """How one attribute is told: a template around the value, or two flag phrases.

    ``columns`` are tried in order; the first with a usable value is taken.
    """

    columns: Sequence[str]
    template: str | None = None
    lower: bool = False
    true: str | None = None
    false: str | None = None

    def phrase(self, value: Column) -> Column:
        text = F.lower(value) if self.lower else value
        if self.template:
            before, after = self.template.split("{value}")
            text = F.concat(F.lit(before), text, F.lit(after))
        if self.true is None and self.false is None:
            return text
        low = F.lower(value)
        return (
            F.when(low.isin("yes", "true", "1"), F.lit(self.true))
            .when(low.isin("no", "false", "0"), F.lit(self.false))
            .otherwise(text)
        )


@dataclass(frozen=True)
class Narrative:
    """What a dataset's stories tell besides activities and times."""

    intro: str = ""
    case_fields: Sequence[Field] = field(default_factory=list)
    event_fields: Sequence[Field] = field(default_factory=list)


def _by_dataset(parts: Mapping[str, Column], default: Column) -> Column:
    out = default
    for dataset, col in parts.items():
        out = F.when(F.col("dataset") == dataset, col).otherwise(out)
    return out


def _columns_of(df: DataFrame, names: Sequence[str]) -> list[str]:
    by_lower = {c.lower(): c for c in df.columns}
    return [by_lower[n.lower()] for n in names if n.lower() in by_lower]


# ---- event sentences -------------------------------------------------------

SENTENCES = ["head", "mid"]


def with_event_sentences(
    df: DataFrame, narratives: Mapping[str, Narrative], quote: bool = True
) -> DataFrame:
    """Add ``head`` and ``mid``: the event told as first of a segment, or later in it.

    Needs ``activity, seq, elapsed_time, interval_time`` and the attributes. Built
    in steps, so that each part is computed once per event.
    """
    mark = '"' if quote else ""
    extras = _by_dataset(
        {d: _extras(df, n.event_fields) for d, n in narratives.items() if n.event_fields},
        F.lit(""),
    )
    days = F.col("_days")

    def gap(same_day: str, later: str) -> Column:
        return (
            F.when(days <= 0, same_day)
            .when(days == 1, f"1 day {later}")
            .otherwise(F.concat(days.cast("string"), F.lit(f" days {later}")))
        )

    tail = F.concat(
        F.lit(mark), compact_text(F.coalesce(F.col("activity"), F.lit("nan"))),
        F.lit(f"{mark} on day "), floor_days(F.col("elapsed_time")).cast("string"),
        F.when(F.col("_extras") != "", F.concat(F.lit(", with "), F.col("_extras"))).otherwise(""),
    )
    opening = F.when(F.col("seq") == 0, "The case started with ").otherwise(F.concat(
        gap("Later the same day in the case", "after the previous event"),
        F.lit(", the case resumed with "),
    ))
    later = F.concat(gap("Later the same day", "later"), F.lit(", it went through "))
    return (
        df.withColumns({"_extras": extras, "_days": floor_days(F.col("interval_time"))})
        .withColumn("_tail", tail)
        .withColumns({
            "head": F.concat(opening, F.col("_tail")), "mid": F.concat(later, F.col("_tail")),
        })
        .withColumns({c: end_compact(F.col(c)) for c in SENTENCES})
        .drop("_extras", "_days", "_tail")
    )


def _extras(df: DataFrame, fields: Sequence[Field]) -> Column:
    phrases = [
        f.phrase(F.coalesce(*[value_text(df, c) for c in cols]))
        for f in fields if (cols := _columns_of(df, f.columns))
    ]
    if not phrases:
        return F.lit("")
    return join_phrases(phrases)


# ---- case sentence ---------------------------------------------------------

def case_field_columns(df: DataFrame, narratives: Mapping[str, Narrative]) -> dict[str, Column]:
    """Aggregates over a case: per attribute the first non-null value and its ``seq``.

    Only the first non-null value of a column counts, even when it is blank.
    """
    names = [c for n in narratives.values() for f in n.case_fields for c in f.columns]
    return {
        f"case_{i}": F.min(F.when(
            F.col(quoted(c)).isNotNull(),
            record(seq=F.col("seq"), value=value_text(df, c)),
        ))
        for i, c in enumerate(_columns_of(df, list(dict.fromkeys(names))))
    }


def case_sentence(
    df_columns: DataFrame, narratives: Mapping[str, Narrative], intro: bool = True,
    before: Column | None = None,
) -> Column:
    """Introduction and case attributes; '' when there is nothing to tell.

    ``before`` limits the attributes to events with a smaller ``seq``, so a
    prefix never shows what came later. ``df_columns`` is the log the columns of
    ``case_field_columns`` were made for.
    """
    names = [c for n in narratives.values() for f in n.case_fields for c in f.columns]
    index = {c: i for i, c in enumerate(_columns_of(df_columns, list(dict.fromkeys(names))))}

    def value(column: str) -> Column:
        first = F.col(f"case_{index[column]}")
        return first["value"] if before is None else F.when(first["seq"] < before, first["value"])

    def tell(n: Narrative) -> Column:
        lead = end_sentence(F.lit(n.intro)) if intro else F.lit("")
        phrases = [
            f.phrase(F.coalesce(*[value(c) for c in cols]))
            for f in n.case_fields if (cols := _columns_of(df_columns, f.columns))
        ]
        if not phrases:
            return lead
        told = join_phrases(phrases)
        sentence = F.when(told != "", end_sentence(F.concat(F.lit("At the case level, "), told)))
        return F.concat_ws(" ", F.when(lead != "", lead), sentence)

    return _by_dataset({d: tell(n) for d, n in narratives.items()}, F.lit(""))
