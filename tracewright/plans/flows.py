"""The public flows: prepare logs, story corpus, instruction data, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.narrative import Narrative
from tracewright.functions.text import hash_order
from tracewright.operators.canonicalize import activity_inventory, canonicalize
from tracewright.operators.cases import case_table, variant_texts
from tracewright.operators.instructions import eval_prompts, instruction_rows
from tracewright.operators.metrics import (
    case_macro, dataset_macro, dataset_metrics, split_summary, stage_metrics,
)
from tracewright.operators.ordering import (
    HotCases, add_remaining_time, find_hot_cases, order_events,
)
from tracewright.operators.outcomes import check_labels, Rule, label_outcomes
from tracewright.operators.prefixes import (
    DEFAULT_RATIOS, add_candidates, all_examples, cap_prefixes, plan_prefixes, planned_examples,
)
from tracewright.operators.sampling import (
    balanced_sample, cap_cases, dedup_text, segment_preference, split_label_stratified,
    split_variant_stratified, target_cap, variant_topk,
)
from tracewright.operators.scoring import score
from tracewright.operators.segments import Windows, segment_stories
from tracewright.scale import checkpoint
from tracewright.schema import CASE


def prepare_logs(
    events: DataFrame, activity_map: DataFrame | None, rules: Mapping[str, Rule],
    unit: str = "days", round_digits: int | None = 0, drop_unlabeled: bool = False,
) -> DataFrame:
    """Canonical names, outcome labels and remaining time of all datasets in one plan."""
    if activity_map is not None:
        events = canonicalize(events, activity_map)
    labelled = label_outcomes(events, rules, drop_unlabeled=drop_unlabeled)
    return add_remaining_time(labelled, unit, round_digits)


def story_corpus(
    events: DataFrame, narratives: Mapping[str, Narrative], windows: Windows = Windows(),
    target: int = 0, strategy: str = "fixed", per_variant: int = 0, dedup: bool = True,
    intro: bool = True, quote: bool = True, seed: int = 3407,
) -> DataFrame:
    """Stories of all datasets; with a cap, each is balanced over variants.

    All stories are kept unless ``target``, ``strategy`` or ``per_variant`` (say
    ``presets.CORPUS_LIMITS``) sets a cap. The candidates are frozen once: the caps
    are counted from them and the sample is drawn from them.
    """
    stories = segment_stories(events, narratives, windows, intro, quote)
    if dedup:
        stories = dedup_text(
            stories, [F.col("case_order"), F.col("case_id"), F.col("slice_id")]
        )
    stories = checkpoint(stories.drop("case_order"))
    counts = stories.groupBy("dataset").agg(F.count("*").alias("n"))
    cap = target_cap(counts, strategy, target)
    preference = segment_preference(seed)
    if cap is None:
        return variant_topk(stories, per_variant, preference)
    return balanced_sample(
        stories, cap, per_variant, "variant_key", preference,
        hash_order(seed, "round", F.col("dataset"), F.col("variant_key")),
    )


@dataclass(frozen=True)
class InstructionSettings:
    """Limits of 0 keep all; ``presets.INSTRUCTION_LIMITS`` holds the usual ones."""

    max_cases: int = 0
    prefixes_per_case: int = 0
    max_prefixes: int = 0
    ratios: Sequence[float] = DEFAULT_RATIOS
    validation_ratio: float = 0.02
    max_story_events: int = 40
    system_prompt: bool = True
    intro: bool = True
    quote: bool = True
    variant_text: bool = True
    strict: bool = False
    seed: int = 3407


def instruction_data(
    events: DataFrame, narratives: Mapping[str, Narrative], rules: Mapping[str, str],
    s: InstructionSettings = InstructionSettings(), labels: DataFrame | None = None,
) -> DataFrame:
    """Samples of three tasks for train and validation, with their metadata.

    The outcome of a case is the ``label`` of its events, or its row in ``labels``
    (``dataset, case_id, label``), which spares joining it to every event. Cases are chosen, split and planned on narrow rows; only then the events of
    the chosen cases are told.
    """
    hot = find_hot_cases(events)
    chosen = checkpoint(choose_cases(events, s, hot, labels))
    plan = checkpoint(plan_prefixes(chosen, s.prefixes_per_case, s.ratios, s.seed))
    plan = checkpoint(cap_prefixes(plan, s.max_prefixes, s.seed, s.validation_ratio))
    examples = planned_examples(
        events, plan.withColumnRenamed("label", "final_outcome"), narratives,
        s.max_story_events, s.intro, s.quote, hot,
    )
    examples = add_candidates(examples, checkpoint(activity_inventory(events)), seed=s.seed)
    rows = instruction_rows(examples, rules, s.system_prompt)
    if s.variant_text:
        told = order_events(events.join(chosen.select(*CASE), CASE, "left_semi"), hot)
        rows = rows.join(variant_texts(told).drop("trace_len"), CASE)
    return rows


def labelled_cases(
    events: DataFrame, labels: DataFrame | None = None, hot: HotCases | None = None, strict: bool = False
) -> DataFrame:
    """Narrow case rows with one outcome each, frozen because several steps read them.

    Cases without one clear outcome are left out, or refused when ``strict``.
    """
    if labels is None:
        problems = check_labels(events).limit(3).collect() if strict else []
        if problems:
            raise ValueError(f"cases without one clear outcome: {[tuple(r) for r in problems]}")
        return checkpoint(case_table(order_events(events, hot)))
    cases = case_table(order_events(events, hot), label=None)
    return checkpoint(cases.join(labels.select(*CASE, "label"), CASE).where("label is not null"))


def choose_cases(
    events: DataFrame, s: InstructionSettings, hot: HotCases | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Labelled cases, capped over variants and split into train and validation."""
    cases = labelled_cases(events, labels, hot, s.strict)
    return split_variant_stratified(
        cap_cases(cases, s.max_cases, s.seed), s.validation_ratio, s.seed
    )


@dataclass(frozen=True)
class EvaluationSettings:
    test_ratio: float = 0.2
    min_prefix_len: int = 2
    max_story_events: int = 40
    shuffle_candidates: bool = True
    candidate_block: bool = False
    system_prompt: bool = True
    intro: bool = True
    quote: bool = True
    strict: bool = False
    seed: int = 3407
    tasks: list[str] = field(default_factory=lambda: [
        "next_activity_prediction", "remaining_time_prediction", "final_outcome_prediction",
    ])


@dataclass(frozen=True)
class Evaluation:
    split_cases: DataFrame
    predictions: DataFrame
    summary: DataFrame
    metrics: DataFrame
    stages: DataFrame
    case_macro: DataFrame
    dataset_macro: DataFrame


def evaluation_prompts(
    events: DataFrame, cases: DataFrame, inventory: DataFrame,
    narratives: Mapping[str, Narrative], rules: Mapping[str, str],
    s: EvaluationSettings = EvaluationSettings(), hot: HotCases | None = None,
) -> DataFrame:
    """Prompts for every prefix of the given cases and every task; stories told once."""
    examples = all_examples(
        events, cases.withColumnRenamed("label", "final_outcome"), narratives,
        s.min_prefix_len, s.max_story_events, s.intro, s.quote, hot,
    )
    examples = add_candidates(examples, inventory, seed=s.seed, shuffle=s.shuffle_candidates)
    return eval_prompts(examples, rules, s.tasks, s.system_prompt, s.candidate_block)


def evaluate(
    events: DataFrame, narratives: Mapping[str, Narrative], rules: Mapping[str, str],
    predictor: Callable[[DataFrame], DataFrame], s: EvaluationSettings = EvaluationSettings(),
    labels: DataFrame | None = None,
) -> Evaluation:
    """Split cases, prompt every test prefix, score the predictor and summarise.

    ``predictor`` turns prompts into ``dataset, task, case_id, prefix_len, raw_output``.
    """
    hot = find_hot_cases(events)
    cases = checkpoint(split_label_stratified(
        labelled_cases(events, labels, hot, s.strict), s.test_ratio, s.seed
    ))
    inventory = checkpoint(activity_inventory(events))
    test = cases.where(F.col("split") == "test")
    prompts = evaluation_prompts(events, test, inventory, narratives, rules, s, hot)
    # Predictor and scoring both read the prompts: told once.
    prompts = checkpoint(prompts)
    predictions = checkpoint(score(prompts, predictor(prompts), inventory))
    summary = split_summary(cases, inventory, dict(rules), s.min_prefix_len, {
        "include_system_prompt": s.system_prompt, "include_dataset_intro": s.intro,
        "quote_activities": s.quote, "shuffle_candidates": s.shuffle_candidates,
        "max_prefix_story_events": s.max_story_events, "min_prefix_len": s.min_prefix_len,
    })
    metrics = dataset_metrics(predictions, summary)
    return Evaluation(
        cases, predictions, summary, metrics, stage_metrics(predictions),
        case_macro(predictions), dataset_macro(metrics),
    )
