"""Preparation of a folder of logs: canonical names, outcome labels, remaining time.

Each log has its own columns, so logs are planned one by one (there are a few
dozen at most); the rows of a log are read, processed and written by executors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.canonicalize import (
    canonicalize, detect_activity_column, mapping_summary,
)
from tracewright.operators.ordering import add_remaining_time
from tracewright.operators.outcomes import Lookup, Rule, case_outcomes, label_outcomes, label_summary, rule_texts
from tracewright.schema import (
    ACTIVITY_NAMES, CASE_NAMES, DATASET_SPELLINGS, TIMESTAMP_NAMES, event_log, resolve_column,
)
from tracewright.sources.readers import log_files, read_any
from tracewright.sources.staged import commit, committed
from tracewright.sources.writers import write_logs, write_report

# Logs that take their labels from another log.
RELATED = {"BPIC2012W": "BPIC2012A"}


@dataclass
class Report:
    """What a run did: written logs, logs that failed, and the files that name no dataset.

    ``resumed`` names the logs of ``done`` that an earlier run had written.
    """

    skipped: DataFrame
    done: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    resumed: list[str] = field(default_factory=list)


# What a log that cannot be read or processed raises. Anything else, a lost cluster or a
# full disk, is no fault of the log and ends the run.
BAD_LOG = (ValueError, LookupError, AnalysisException)
BAD_FILE = ("FAILED_READ_FILE", "MALFORMED", "CANNOT_READ", "INVALID_FILE", "CAST_INVALID_INPUT", "CANNOT_PARSE")


def _of_the_log(problem: Exception) -> bool:
    return isinstance(problem, BAD_LOG) or (
        isinstance(problem, PySparkException) and (problem.getCondition() or "").startswith(BAD_FILE))


def find_logs(
    spark: SparkSession, root: str, spellings: Mapping[str, Sequence[str]] = DATASET_SPELLINGS
) -> tuple[dict[str, dict[str, list[str]]], DataFrame]:
    """Paths of every dataset below ``root`` by file ending, and the paths that name no dataset.

    A folder whose files of one ending are all of one dataset counts as one path.
    """
    files = log_files(spark, root, spellings)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    ending = F.regexp_extract(F.lower("path"), r"\.(xes\.gz|[a-z]+)$", 1)
    kinds = files.withColumns({"folder": folder, "ending": ending})
    pure = kinds.groupBy("folder", "ending").agg(
        F.min("dataset").alias("low"), F.max("dataset").alias("high"), F.count("dataset").alias("named"), F.count("*").alias("n"))
    whole = (F.col("low") == F.col("high")) & (F.col("named") == F.col("n"))
    mixed = pure.where(~F.coalesce(whole, F.lit(False))).select("folder", "ending")
    paths = pure.where(whole).select(F.col("low").alias("dataset"), "ending", F.concat_ws("/*.", "folder", "ending").alias("path"))
    paths = paths.unionByName(
        kinds.join(mixed, ["folder", "ending"], "left_semi").where("dataset IS NOT NULL").select("dataset", "ending", "path"))
    logs: dict[str, dict[str, list[str]]] = {}
    for r in paths.orderBy("dataset", "ending", "path").collect():
        logs.setdefault(r["dataset"], {}).setdefault(r["ending"], []).append(r["path"])
    return logs, files.where("dataset IS NULL").select("path")


def read_log(spark: SparkSession, dataset: str, paths: Mapping[str, Sequence[str]],
             roles: Callable[[DataFrame, str], dict] = lambda raw, dataset: {}) -> DataFrame:
    """One event log from all parts of a dataset, also of several formats."""
    log: DataFrame | None = None
    for parts in paths.values():
        raw = read_any(spark, list(parts))
        part = event_log(raw, dataset, **roles(raw, dataset))
        log = part if log is None else log.unionByName(part, allowMissingColumns=True)
    return log


def input_states(spark: SparkSession, root: str, spellings: Mapping[str, Sequence[str]] = DATASET_SPELLINGS) -> dict[str, str]:
    """For each dataset a text that changes with its files: their number, and their paths, sizes and times hashed."""
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)")
    states = log_files(spark, root, spellings, "length", "modificationTime").where("dataset IS NOT NULL").groupBy("dataset").agg(
        F.concat_ws(" ", F.count("*"), F.sum(one)).alias("state"))
    return {r["dataset"]: r["state"] for r in states.collect()}


def _each_log(
    spark: SparkSession, root: str, out: str, work: Callable[[DataFrame, str], tuple[DataFrame, dict]],
    fmt: str, spellings: Mapping[str, Sequence[str]],
    roles: Callable[[DataFrame, str], dict] = lambda raw, dataset: {},
    settings: Callable[[str], str | None] | None = None, observed: Mapping[str, Column] | None = None,
) -> Report:
    """All parts of a dataset are one log: read together, processed once, written whole.

    With ``settings`` a log is left as it is if an earlier run wrote it from the same
    files with the same settings, and its files are still those; None: write it anew.
    ``observed`` are facts that the write counts.
    """
    logs, skipped = find_logs(spark, root, spellings)
    if not logs:
        raise FileNotFoundError(f"no log of a known dataset below {root}")
    states = input_states(spark, root, spellings)
    report = Report(skipped)
    for dataset, paths in logs.items():
        inputs = ", ".join(p for parts in paths.values() for p in parts)
        target = f"{out.rstrip('/')}/{dataset}"
        setting = settings(dataset) if settings else None
        made_from = f"{states[dataset]} {fmt} {setting or ''}"
        before = committed(spark, target, made_from) if setting is not None else None
        if before is not None:
            report.resumed.append(dataset)
            report.done.append({"dataset": dataset, "input": inputs, "output": target, **before})
            continue
        try:
            result, facts = work(read_log(spark, dataset, paths, roles), dataset)
            facts = commit(result, target, lambda df, path: write_logs(df, path, fmt), made_from, facts, observed)
            report.done.append({"dataset": dataset, "input": inputs, "output": target, **facts})
        except Exception as problem:  # noqa: BLE001 - one bad log must not stop the others
            if not _of_the_log(problem):
                raise
            report.errors.append({"dataset": dataset, "file": inputs, "error": str(problem)})
    for name, rows in (("summary", report.done), ("errors", report.errors)):
        if rows:
            columns = list(dict.fromkeys(k for r in rows for k in r))
            texts = [tuple(None if r.get(k) is None else str(r[k]) for k in columns) for r in rows]
            frame = spark.createDataFrame(texts, ", ".join(f"`{k}` string" for k in columns))
            write_report(frame, f"{out.rstrip('/')}/_{name}", json=True)
    return report


def canonicalize_logs(
    spark: SparkSession, root: str, out: str, activity_map: DataFrame, fmt: str = "csv",
    activity: str | None = None, spellings: Mapping[str, Sequence[str]] = DATASET_SPELLINGS, resume: bool = False,
) -> Report:
    """Canonical activity names for every log; a log with uncovered names is an error.

    ``resume`` leaves logs that an earlier run wrote from the same files and names.
    """
    def roles(raw: DataFrame, dataset: str) -> dict:
        used[dataset] = activity or detect_activity_column(raw, activity_map, dataset)
        return {"activity": used[dataset]}

    used: dict[str, str] = {}

    def work(log: DataFrame, dataset: str) -> tuple[DataFrame, dict]:
        mine = activity_map.where(F.col("dataset") == dataset)
        facts = {"activity_col": used[dataset], **mapping_summary(log, mine).first().asDict()}
        if not facts["one_to_one"]:
            raise ValueError(f"{dataset}: canonical names are not one-to-one")
        return canonicalize(log, mine, strict=True), facts

    states: dict[str, str] = {}
    if resume:
        pair = F.xxhash64("raw", "canonical").cast("decimal(38,0)")
        states = {r[0]: r[1] for r in activity_map.groupBy("dataset").agg(F.concat_ws(" ", F.count("*"), F.sum(pair))).collect()}
    settings = (lambda dataset: f"{activity} {states.get(dataset)}") if resume else None
    return _each_log(spark, root, out, work, fmt, spellings, roles, settings)


def label_logs(
    spark: SparkSession, root: str, out: str, rules: Mapping[str, Rule], fmt: str = "csv",
    positive: str = "success", negative: str = "failure", drop_unlabeled: bool = False,
    spellings: Mapping[str, Sequence[str]] = DATASET_SPELLINGS, resume: bool = False,
) -> Report:
    """Outcome of its case on every event of every log, with rules and summary.

    A log without a rule whose labels come from another log of the same tree
    (``RELATED``) is labelled from it. ``resume`` leaves logs that an earlier run
    labelled from the same files by the same rule, but not those labelled from a table.
    """
    rules = dict(rules)
    logs, _ = find_logs(spark, root, spellings)
    for dataset, other in RELATED.items():
        if dataset in logs and dataset not in rules and other in logs and other in rules:
            related = related_labels(read_log(spark, other, logs[other]), rules[other], other)
            rules[dataset] = Lookup(f"the same case is a success in {other}", labels=related)
    columns: dict[str, dict] = {}

    def roles(raw: DataFrame, dataset: str) -> dict:
        found = {k: resolve_column(raw.columns, names, required=False) for k, names in (
            ("case_col", CASE_NAMES), ("activity_col", ACTIVITY_NAMES), ("timestamp_col", ["ts", *TIMESTAMP_NAMES]))}
        columns[dataset] = {**found, "label_col": "label"}
        return {}

    def work(log: DataFrame, dataset: str) -> tuple[DataFrame, dict]:
        rule = {dataset: rules[dataset]}
        labelled = label_outcomes(log, rule, positive, negative, drop_unlabeled=drop_unlabeled)
        return labelled, {**columns[dataset], **label_summary(log, rule, positive, negative).first().asDict()}

    texts = rule_texts(rules, positive, negative)
    def settings(dataset: str) -> str | None:
        rule = rules.get(dataset)
        if rule is None or isinstance(rule, Lookup):
            return None
        parts = {k: sorted(v) if isinstance(v, (set, frozenset)) else v for k, v in vars(rule).items()}
        return f"{type(rule).__name__} {parts} {positive} {negative} {drop_unlabeled}"

    report = _each_log(spark, root, out, work, fmt, spellings, roles, settings if resume else None)
    frame = spark.createDataFrame(list(texts.items()), "dataset string, rule string")
    write_report(frame, f"{out.rstrip('/')}/_rules", json=True)
    return report


def related_labels(log: DataFrame, rule: Rule, dataset: str) -> DataFrame:
    """``case_id, value`` of one log, for the ``Lookup`` rule of another."""
    return case_outcomes(log, {dataset: rule}).select("case_id", "value")


def remaining_time_logs(
    spark: SparkSession, root: str, out: str, unit: str = "days", round_digits: int | None = 0,
    fmt: str = "csv", spellings: Mapping[str, Sequence[str]] = DATASET_SPELLINGS, resume: bool = False,
) -> Report:
    """Remaining time on every event of every log; the write counts unreadable times.

    ``resume`` leaves logs that an earlier run wrote from the same files with the same unit.
    """
    def work(log: DataFrame, dataset: str) -> tuple[DataFrame, dict]:
        return add_remaining_time(log, unit, round_digits), {}

    lost = {"events_without_time": F.count_if(F.col("ts").isNull())}
    settings = (lambda dataset: f"{unit} {round_digits}") if resume else None
    return _each_log(spark, root, out, work, fmt, spellings, settings=settings, observed=lost)
