"""Three-task samples from planned prefixes: text and metadata of one frame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.structs import record
from tracewright.functions.prompts import (
    NEXT, OUTCOME, TASKS, TIME, candidate_block, inject_candidates, instruction, rule_text,
    sample_text, unique_nonblank,
)


def expand_tasks(examples: DataFrame, tasks: list[str] = TASKS) -> DataFrame:
    """One row per prefix and task with ``task, candidates, response``, the target.

    The story was rendered once per prefix; only here it is repeated per task.
    """
    no_list = F.lit(None).cast("array<string>")
    kinds = {
        NEXT: (F.col("next_candidates"), F.col("next_activity")),
        TIME: (no_list, F.col("remaining_time_days").cast("string")),
        OUTCOME: (F.col("outcome_candidates"), F.col("final_outcome")),
    }
    rows = F.array(*[
        record(task=F.lit(t), candidates=kinds[t][0], response=kinds[t][1])
        for t in tasks
    ])
    return examples.select("*", F.inline(rows)).drop("next_candidates", "outcome_candidates")


def instruction_rows(
    examples: DataFrame, rules: Mapping[str, str], system_prompt: bool = True,
    positive: str = "success", negative: str = "failure",
) -> DataFrame:
    """Samples with text and metadata; project with ``sample_texts`` and ``sample_meta``."""
    rows = expand_tasks(examples).withColumn("rule_description", rule_text(rules))
    asked = instruction(
        F.col("task"), F.col("candidates"), F.col("rule_description"), positive, negative
    )
    return rows.withColumn("text", sample_text(
        F.col("task"), asked, F.col("input_story"), F.col("response"), system_prompt
    ))


META = [
    "split", "dataset", "case_id", "task", "prefix_len", "trace_len", "prefix_ratio",
    "story_segment_start", "story_n_events", "response", "next_activity",
    "remaining_time_days", "final_outcome", "candidates", "rule_description", "variant",
]


def sample_texts(rows: DataFrame) -> DataFrame:
    return rows.select("split", "text")


def sample_meta(rows: DataFrame) -> DataFrame:
    """Metadata columns; ``variant`` is the id unless the rows bring the text."""
    if "variant" not in rows.columns:
        rows = rows.withColumn("variant", F.col("variant_id"))
    return rows.select(*META)


def sample_counts(rows: DataFrame) -> DataFrame:
    """Samples per dataset and task with all subtotals; '*' stands for all."""
    keys = ["dataset", "task"]
    return rows.cube(*keys).agg(F.count("*").alias("n_samples")).select(
        *[F.coalesce(k, F.lit("*")).alias(k) for k in keys], "n_samples"
    )


def evaluation_tasks(examples: DataFrame, tasks: list[str] = TASKS) -> DataFrame:
    """One row per prefix and task with ``gold``; no text."""
    return expand_tasks(examples, tasks).withColumnRenamed("response", "gold")


def eval_prompts(
    examples: DataFrame, rules: Mapping[str, str], tasks: list[str] = TASKS,
    system_prompt: bool = True, with_candidate_block: bool = False,
    positive: str = "success", negative: str = "failure", compose=sample_text,
    block=candidate_block,
) -> DataFrame:
    """Prompts per prefix and task, ending at the empty response.

    ``compose`` and ``block`` replace the texts: functions from Columns to a Column.
    """
    rows = evaluation_tasks(examples, tasks)
    asked = instruction(F.col("task"), F.col("candidates"), rule_text(rules), positive, negative)
    prompt = compose(F.col("task"), asked, F.col("input_story"), F.lit(""), system_prompt)
    if with_candidate_block:
        prompt = inject_candidates(prompt, block(F.col("candidates")))
    return rows.withColumn("prompt", prompt)


def shared_universe(prompts: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate set of each group when all its prompts share one, else null."""
    listed = F.array_sort(unique_nonblank(F.coalesce("candidates", F.array().cast("array<string>"))))
    as_set = prompts.select(*keys, listed.alias("universe"))
    return as_set.groupBy(*keys).agg(
        F.min("universe").alias("low"), F.max("universe").alias("high")
    ).select(*keys, F.when(
        (F.col("low") == F.col("high")) & (F.size("low") > 0), F.col("low")
    ).alias("universe"))
