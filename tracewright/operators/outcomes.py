"""Case outcomes by declarative rules, all labelled by one combined aggregate.

A rule names the inputs of a few shared aggregate slots and gives a verdict over
them. Slots are shared by all rules (each event belongs to one dataset), so any
number of datasets costs the same few aggregates, combined map-side: a hot case
is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import label_word, norm_text, quoted, read_flag
from tracewright.operators.ordering import days_between
from tracewright.schema import CASE, find_column, find_keyword_column

def _names(acts: Sequence[str]) -> list[str]:
    return sorted({" ".join(a.split()).lower() for a in acts})


def _in(acts: Sequence[str]) -> Column:
    return F.col("_act").isin(_names(acts))


def _number(name: str) -> Column:
    x = F.col(quoted(name)).try_cast("double")
    return F.when(~F.isnan(x), x)


def _flag(df: DataFrame, name: str) -> Column:
    return read_flag(F.col(quoted(name)), df.schema[name].dataType)


Names = str | Sequence[str] | None


def _column(df: DataFrame, names: Names) -> str | None:
    """Column by its spellings: equal without case, else containing one."""
    names = [names] if isinstance(names, str) else list(names or [])
    return find_column(df.columns, names) if names else None


def _column_with(df: DataFrame, words: Names, all_words: bool = False) -> str | None:
    """First column that contains all words; unless ``all_words``, else one that contains any."""
    words = [words] if isinstance(words, str) else list(words or [])
    found = find_keyword_column(df.columns, words) if words else None
    if found and all_words and not all(w.lower() in found.lower() for w in words):
        return None
    return found


def _true(slot: str) -> Column:
    return F.coalesce(F.col(slot), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """``text`` completes "a case is a success when ..."."""

    text: str

    def slots(self, df: DataFrame) -> dict[str, Column]:
        """Inputs of the slots the verdict uses; the slot says how they are aggregated."""
        return {}

    def verdict(self) -> Column:
        raise NotImplementedError

    def extra(self, events: DataFrame) -> DataFrame | None:
        """Case columns that need a pass of their own, or None."""
        return None


@dataclass(frozen=True)
class EndsWith(Rule):
    acts: Sequence[str] = ()

    def slots(self, df):
        return {"last_good": _in(self.acts)}

    def verdict(self):
        return _true("last_good")


@dataclass(frozen=True)
class Contains(Rule):
    acts: Sequence[str] = ()

    def slots(self, df):
        return {"any_good": _in(self.acts)}

    def verdict(self):
        return _true("any_good")


@dataclass(frozen=True)
class ContainsNone(Rule):
    acts: Sequence[str] = ()

    def slots(self, df):
        return {"any_bad": _in(self.acts)}

    def verdict(self):
        return ~_true("any_bad")


@dataclass(frozen=True)
class ContainsWithout(Rule):
    acts: Sequence[str] = ()
    bad: Sequence[str] = ()

    def slots(self, df):
        return {"any_good": _in(self.acts), "any_bad": _in(self.bad)}

    def verdict(self):
        return _true("any_good") & ~_true("any_bad")


@dataclass(frozen=True)
class ClosedNotReopened(Rule):
    """(flag true anywhere, last activity terminal, or a strong terminal anywhere) and no reopen."""

    flag: Names = None
    last_in: Sequence[str] = ()
    any_of: Sequence[str] = ()
    reopened: Sequence[str] = ()

    def slots(self, df):
        closed = _in(self.any_of)
        flag = _column(df, self.flag)
        if flag:
            closed = closed | F.coalesce(_flag(df, flag), F.lit(False))
        return {
            "any_good": closed, "any_bad": _in(self.reopened), "last_good": _in(self.last_in),
        }

    def verdict(self):
        return (_true("any_good") | _true("last_good")) & ~_true("any_bad")


@dataclass(frozen=True)
class NoReturnWithin(Rule):
    """No return, or the first timed return more than ``days`` after the latest release before it."""

    release: Sequence[str] = ()
    returned: Sequence[str] = ()
    days: float = 28.0

    def slots(self, df):
        return {"any_bad": _in(self.returned)}

    def extra(self, events):
        timed = events.where("ts is not null").withColumn("_at", F.struct("ts", "in_order"))
        back = timed.where(_in(self.returned)).groupBy(*CASE).agg(F.min("_at").alias("_back"))
        # Releases are the streamed side, so AQE can split those of a hot case; what
        # is left of them is one time per case and task.
        latest = (
            timed.where(_in(self.release)).select(*CASE, "_at").join(back, CASE)
            .where("_at < _back").groupBy(*CASE).agg(F.max(F.col("_at")["ts"]).alias("_out"))
        )
        gap = days_between(F.col("_back")["ts"], F.col("_out"))
        return back.join(latest, CASE, "left").select(*CASE, gap.alias("gap"))

    def verdict(self):
        return ~_true("any_bad") | F.coalesce(F.col("gap") > self.days, F.lit(False))


@dataclass(frozen=True)
class AmountCovered(Rule):
    """Collected -> 0; else paid covers amount when both are known; else any payment.

    ``amount`` and ``paid`` are words of a column's name; all words of ``paid`` must be there.
    """

    amount: Names = None
    paid: Names = None
    payment: Sequence[str] = ()
    collected: Sequence[str] = ()

    def slots(self, df):
        out = {"any_good": _in(self.payment), "any_bad": _in(self.collected)}
        amount, paid = _column_with(df, self.amount), _column_with(df, self.paid, all_words=True)
        if amount and paid:
            out |= {"max_amount": _number(amount), "max_paid": _number(paid)}
        return out

    def verdict(self):
        covered = F.col("max_paid") >= F.col("max_amount")
        return ~_true("any_bad") & F.coalesce(covered, _true("any_good"))


@dataclass(frozen=True)
class FlagOrDuration(Rule):
    """First readable flag in input order; else completed within ``days``; else completed."""

    flag: Names = None
    completed: Sequence[str] = ()
    days: float = 5.0

    def slots(self, df):
        ts = F.col("ts")
        out = {"any_good": _in(self.completed), "earliest": ts, "latest": ts, "n_timed": ts}
        flag = _column(df, self.flag)
        if flag:
            out["first_flag"] = _flag(df, flag)
        return out

    def verdict(self):
        in_time = days_between(F.col("latest"), F.col("earliest")) <= self.days
        done = _true("any_good") & ((F.col("n_timed") < 2) | in_time)
        return F.coalesce(F.col("first_flag"), done)


@dataclass(frozen=True)
class NumericPositive(Rule):
    """Column above zero anywhere -> 0; without the column, a keyword in any activity -> 0."""

    column: Names = None
    keywords: Sequence[str] = ()

    def slots(self, df):
        column = _column(df, self.column)
        if column:
            return {"any_bad": F.coalesce(_number(column) > 0, F.lit(False))}
        hits = [F.contains(F.col("_act"), F.lit(k.lower())) for k in self.keywords]
        return {"any_bad": F.greatest(F.lit(False), F.lit(False), *hits)}

    def verdict(self):
        return ~_true("any_bad")


@dataclass(frozen=True)
class Lookup(Rule):
    """Value of the same case in another log, given as ``case_id, value``; absent -> null."""

    labels: DataFrame | None = field(default=None, compare=False)

    def extra(self, events):
        other = self.labels.select("case_id", (F.col("value") == 1).alias("other"))
        return events.select(*CASE).distinct().join(other, "case_id")

    def verdict(self):
        return F.col("other")


def _event_number() -> Column:
    """The event order as one number: by time, null times last, ties by input order.

    A number keeps max_by in a hash aggregate; a struct would force a sort.
    """
    late = 3 * 10**17  # microseconds, after the last timestamp Spark can hold
    micros = F.coalesce(F.unix_micros("ts"), F.lit(late)).cast("decimal(19,0)")
    place = F.col("in_order").cast("decimal(19,0)")
    return (micros * F.lit(Decimal(2 * 10**19)) + place).cast("decimal(38,0)")


# Slot -> type of its input and result, and how a case aggregates it.
_SLOTS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "any_good": ("boolean", F.max),
    "any_bad": ("boolean", F.max),
    "last_good": ("boolean", lambda x: F.max_by(x, "_place")),
    "first_flag": ("boolean", lambda x: F.min_by(x, F.when(x.isNotNull(), F.col("in_order")))),
    "max_amount": ("double", F.max),
    "max_paid": ("double", F.max),
    "earliest": ("timestamp", F.min),
    "latest": ("timestamp", F.max),
    "n_timed": ("timestamp", F.count),
}
_EXTRA = {"gap": "double", "other": "boolean"}


def case_outcomes(events: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """``dataset, case_id, value`` (1, 0, null) for each case of a dataset with a rule."""
    untold = [d for d, r in rules.items() if not r.text.strip()]
    if untold:
        raise ValueError(f"rules need a text: {untold}")
    acts = events.where(F.col("dataset").isin(list(rules))).withColumn(
        "_act", norm_text(F.col("activity"))
    )
    inputs: dict[str, Column] = {}
    verdict = F.lit(None).cast("boolean")
    extras: DataFrame | None = None
    for dataset, rule in rules.items():
        mine = F.col("dataset") == dataset
        for slot, col in rule.slots(events).items():
            inputs[slot] = F.when(mine, col).otherwise(inputs.get(slot, F.lit(None)))
        verdict = F.when(mine, rule.verdict()).otherwise(verdict)
        extra = rule.extra(acts.where(mine))
        if extra is not None:
            extras = extra if extras is None else extras.unionByName(extra, allowMissingColumns=True)
    last = [d for d, r in rules.items() if "last_good" in r.slots(events)]
    if last:  # wide numbers only where a rule looks at the last event
        acts = acts.withColumn("_place", F.when(F.col("dataset").isin(last), _event_number()))
    inputs = inputs or {"any_good": F.lit(None)}
    out = acts.groupBy(*CASE).agg(*[
        _SLOTS[slot][1](col.cast(_SLOTS[slot][0])).alias(slot) for slot, col in inputs.items()
    ])
    if extras is not None:
        out = out.join(extras, CASE, "left")
    types = {**{slot: t for slot, (t, _) in _SLOTS.items()}, **_EXTRA}
    absent = {s: F.lit(None).cast(t) for s, t in types.items() if s not in out.columns}
    return out.withColumns(absent).select(*CASE, verdict.cast("int").alias("value"))


def case_labels(
    events: DataFrame, rules: Mapping[str, Rule], positive: str = "success",
    negative: str = "failure", label: str = "label",
) -> DataFrame:
    """One row per case with its outcome word, null when the rule gives none."""
    check_words(positive, negative)
    word = F.when(F.col("value") == 1, positive).when(F.col("value") == 0, negative)
    return case_outcomes(events, rules).select(*CASE, word.alias(label))


def label_outcomes(
    events: DataFrame,
    rules: Mapping[str, Rule],
    positive: str = "success",
    negative: str = "failure",
    label: str = "label",
    drop_unlabeled: bool = False,
) -> DataFrame:
    """Write the outcome word of its case onto every event.

    The labels are one row per case; AGG and join share the case key, and AQE
    splits a hot case's events in the join.
    """
    labels = case_labels(events, rules, positive, negative, label)
    out = events.drop(label).join(labels, CASE, "left")
    return out.where(F.col(label).isNotNull()) if drop_unlabeled else out


def check_words(positive: str, negative: str) -> None:
    if not positive.strip() or not negative.strip():
        raise ValueError("outcome words must not be blank")
    if positive.strip().lower() == negative.strip().lower():
        raise ValueError("outcome words must differ")


def label_summary(
    events: DataFrame, rules: Mapping[str, Rule],
    positive: str = "success", negative: str = "failure",
) -> DataFrame:
    """Per dataset: events, cases, positive, negative and unlabelled cases, rule text."""
    sizes = events.where(F.col("dataset").isin(list(rules))).groupBy(*CASE).agg(
        F.count("*").alias("_n")
    )
    cases = case_outcomes(events, rules).join(sizes, CASE)
    texts = F.coalesce(*[
        F.when(F.col("dataset") == d, t)
        for d, t in rule_texts(rules, positive, negative).items()
    ])
    return cases.groupBy("dataset").agg(
        F.sum("_n").alias("n_events"),
        F.count("*").alias("n_cases"),
        F.count_if(F.col("value") == 1).alias("n_positive_cases"),
        F.count_if(F.col("value") == 0).alias("n_negative_cases"),
        F.count_if(F.col("value").isNull()).alias("n_unlabeled_cases"),
    ).withColumns({
        "positive_label": F.lit(positive), "negative_label": F.lit(negative), "rule": texts,
    })


def rule_texts(rules: Mapping[str, Rule], positive: str, negative: str) -> dict[str, str]:
    check_words(positive, negative)
    return {
        d: f"label='{positive}' if {r.text}; otherwise label='{negative}'."
        for d, r in rules.items()
    }


def check_labels(events: DataFrame, label: str = "label") -> DataFrame:
    """Cases without a label, with several, or with an unknown spelling."""
    good = label_word(F.col(label)) == "success"
    unknown = F.count_if(F.col(label).isNotNull() & good.isNull())
    return (
        events.groupBy(*CASE)
        .agg(F.min(good).alias("low"), F.max(good).alias("high"), unknown.alias("n_unknown"))
        .select(*CASE, F.when(F.col("n_unknown") > 0, "unknown label")
                .when(F.col("low").isNull(), "no label")
                .when(F.col("low") != F.col("high"), "several labels").alias("problem"))
        .where("problem is not null")
    )
