"""Instruction, prompt and sample texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.text import json_list, strip

# Task names, texts and section titles of samples and prompts.
NEXT = "next_activity_prediction"
TIME = "remaining_time_prediction"
OUTCOME = "final_outcome_prediction"
TASKS = [NEXT, TIME, OUTCOME]
SYSTEM_PROMPTS = {
    NEXT: "You are a next activity predictor specialized in predictive process monitoring. "
          "Your task is to analyze the execution case and predict the next activity.",
    TIME: "You are a process time estimator specialized in predictive process monitoring. "
          "Your task is to analyze the execution case and predict the remaining time.",
    OUTCOME: "You are a process outcome assessor specialized in predictive process monitoring. "
             "Your task is to analyze the execution case and predict the final outcome.",
}
GENERIC_PROMPT = "You are a predictive process monitoring assistant."
ASK_NEXT = (
    "Please carefully analyze the process story and predict the next activity of the case. "
    "You must choose only one activity name from the following candidates: "
)
ASK_TIME = (
    "Please carefully analyze the process story and predict the remaining time until the case "
    "is completed. Return only an integer to represent the remaining time of the case in days."
)
ASK_OUTCOME = "Please carefully analyze the process story and predict the final outcome of the case. "
CHOOSE_OUTCOME = "You must choose only one from the following outcome candidates: "
COPY_CANDIDATE = "Copy exactly one candidate string from the list below:"
INSTRUCTION, INPUT, RESPONSE, CANDIDATES = (
    "### Instruction\n", "### Input\n", "### Response\n", "### Candidates\n",
)


def system_prompt(task: Column) -> Column:
    out = F.lit(GENERIC_PROMPT)
    for name, text in SYSTEM_PROMPTS.items():
        out = F.when(task == name, text).otherwise(out)
    return out


def rule_text(rules: Mapping[str, str]) -> Column:
    """Outcome rule of the row's dataset; null when none is registered."""
    return F.coalesce(
        F.lit(None).cast("string"), *[F.when(F.col("dataset") == d, t) for d, t in rules.items()]
    )


def instruction(
    task: Column, candidates: Column, rule: Column,
    positive: str = "success", negative: str = "failure",
) -> Column:
    """What is asked; an outcome question needs the rule of its dataset."""
    listed = F.concat(json_list(candidates), F.lit("."))
    told_rule = F.coalesce(
        rule,
        F.raise_error(F.concat(F.lit("no outcome rule for dataset "), F.col("dataset"))).cast("string"),
    )
    outcome = F.concat(
        F.lit(ASK_OUTCOME),
        F.lit(f'In this dataset, a case is labeled "{positive}" when '), told_rule,
        F.lit(f'. Otherwise, it is labeled "{negative}". '), F.lit(CHOOSE_OUTCOME), listed,
    )
    return (
        F.when(task == NEXT, F.concat(F.lit(ASK_NEXT), listed))
        .when(task == TIME, ASK_TIME)
        .otherwise(outcome)
    )


def sample_text(
    task: Column, asked: Column, story: Column, response: Column, with_system: bool = True
) -> Column:
    sections = [
        F.concat(F.lit(INSTRUCTION), asked),
        F.concat(F.lit(INPUT), story),
        F.concat(F.lit(RESPONSE), response),
    ]
    return F.concat_ws("\n\n", *([system_prompt(task)] if with_system else []), *sections)


def candidate_block(candidates: Column) -> Column:
    """Bullet list of non-blank candidates; null when there are no candidates."""
    lines = F.transform(
        F.filter(F.transform(candidates, strip), lambda c: c != ""),
        lambda c: F.concat(F.lit("- "), c),
    )
    return F.when(
        F.size(candidates) > 0,
        F.array_join(F.concat(F.array(F.lit(COPY_CANDIDATE)), lines), "\n"),
    )


def inject_candidates(prompt: Column, block: Column) -> Column:
    """Put the block before the first input section, or at the end without one."""
    marker = "\n\n" + INPUT
    section = F.concat(F.lit("\n\n" + CANDIDATES), block)
    at = F.instr(prompt, marker)
    return (
        F.when(block.isNull() | (block == ""), prompt)
        .when(at > 0, F.concat(
            F.substring(prompt, F.lit(1), at - 1), section,
            F.substring(prompt, at, F.length(prompt)),
        ))
        .otherwise(F.concat(prompt, section))
    )


def unique_nonblank(items: Column) -> Column:
    """Stripped, non-blank, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))
