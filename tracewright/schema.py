"""Column roles, the canonical event-log schema and dataset names.

Canonical schema: ``dataset, case_id, activity, ts, in_order`` plus attributes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.structs import record
from tracewright.functions.text import alnum_token, quoted, strip

CASE = ["dataset", "case_id"]

# Accepted column names per role, in order of preference.
CASE_NAMES = [
    "case_id", "caseid", "case", "case:concept:name", "case_concept_name",
    "trace_id", "traceid", "id", "Case ID",
]
ACTIVITY_NAMES = [
    "activity", "concept:name", "concept_name", "event", "event_name", "task",
    "act_name", "name",
]
TIMESTAMP_NAMES = [
    "timestamp", "time:timestamp", "time_timestamp", "complete_timestamp",
    "Complete Timestamp", "event_time", "datetime", "time", "date", "end_timestamp",
]
LABEL_NAMES = [
    "label", "case_label", "case:label", "final_label", "outcome", "target",
]
REMAINING_NAMES = [
    "remaining_time", "remainingtime", "remain_time", "remaining_days",
    "remaining_day", "rest_time",
]


def resolve_column(columns: Sequence[str], names: Sequence[str], required: bool = True):
    """First of ``names`` that is a column, ignoring case."""
    by_lower = {c.lower(): c for c in columns}
    found = next((by_lower[n.lower()] for n in names if n.lower() in by_lower), None)
    if found is None and required:
        raise KeyError(f"none of {list(names)} among columns {list(columns)}")
    return found


def find_column(columns: Sequence[str], names: Sequence[str]):
    """``resolve_column``, then the first column that contains a name."""
    exact = resolve_column(columns, names, required=False)
    if exact is not None:
        return exact
    return next((c for n in names for c in columns if n.lower() in c.lower()), None)


def find_keyword_column(columns: Sequence[str], words: Sequence[str]):
    """First column containing all words, else the first containing any."""
    for test in (all, any):
        for c in columns:
            if test(w.lower() in c.lower() for w in words):
                return c
    return None


def parse_names(text: str) -> list[str]:
    """Comma list to names, blanks dropped, first occurrence kept."""
    return list(dict.fromkeys(p.strip() for p in text.split(",") if p.strip()))


def parse_sizes(text: str) -> list[int]:
    sizes = [int(p) for p in parse_names(text)]
    if not sizes:
        raise ValueError("at least one window size is needed")
    return sizes


def parse_ratios(text: str, default: Sequence[float]) -> list[float]:
    ratios = [float(p) for p in text.split(",") if p.strip()]
    return [r for r in ratios if r > 0] or list(default)


def parse_timestamp(df: DataFrame, name: str, formats: Sequence[str] = ()) -> Column:
    """Timestamp in UTC; what no format reads becomes null."""
    dtype = df.schema[name].dataType
    col = F.col(quoted(name))
    if isinstance(dtype, T.TimestampType):
        return col
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp")
    text = strip(col.cast("string"))
    return F.coalesce(
        F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats]
    )


def event_log(
    df: DataFrame,
    dataset: str | Column,
    case: str | None = None,
    activity: str | None = None,
    ts: str | None = None,
    order: str | None = None,
    ts_formats: Sequence[str] = (),
    substring_names: bool = False,
) -> DataFrame:
    """Project a raw log onto the canonical schema; other columns are kept.

    Roles not given are resolved by name. ``order`` names the input order; without
    it the scan order is numbered, which is best effort across files. Rows without
    a case id are dropped. A float NaN in any attribute becomes null.
    """
    look = find_column if substring_names else (
        lambda cols, names: resolve_column(cols, names, required=False)
    )
    case = case or look(df.columns, CASE_NAMES)
    activity = activity or look(df.columns, ACTIVITY_NAMES)
    # A log written by this library is already canonical.
    ts = ts or ("ts" if "ts" in df.columns else look(df.columns, TIMESTAMP_NAMES))
    order = order or ("in_order" if "in_order" in df.columns else None)
    if case is None or activity is None:
        raise KeyError(f"no case id or activity column among {df.columns}")
    ids = F.col(quoted(case))
    text_ids = isinstance(df.schema[case].dataType, T.StringType)
    taken = {"dataset", "case_id", "activity", "ts", "in_order"}
    rest = [
        _nan_to_null(f) for f in df.schema.fields
        if f.name.lower() not in taken and f.name not in (case, activity)
    ]
    return df.select(
        (F.lit(dataset) if isinstance(dataset, str) else dataset).alias("dataset"),
        (strip(ids) if text_ids else ids.cast("string")).alias("case_id"),
        F.col(quoted(activity)).cast("string").alias("activity"),
        (parse_timestamp(df, ts, ts_formats) if ts else F.lit(None).cast("timestamp")).alias("ts"),
        (F.col(quoted(order)).cast("long") if order else F.monotonically_increasing_id()).alias(
            "in_order"
        ),
        *rest,
    ).where("case_id is not null")


def _nan_to_null(field: T.StructField) -> Column:
    col = F.col(quoted(field.name))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col).alias(field.name)
    return col


def unparsed_timestamps(raw: DataFrame, name: str, formats: Sequence[str] = ()) -> DataFrame:
    """One row: how many non-null time texts no format reads."""
    bad = F.col(quoted(name)).isNotNull() & parse_timestamp(raw, name, formats).isNull()
    return raw.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_unparsed"))


# ---- dataset names ---------------------------------------------------------

# Public event logs by name, with spellings seen in file names.
DATASET_SPELLINGS: dict[str, list[str]] = {
    "BPIC2013I": ["bpic2013i", "bpi2013i", "bpichallenge2013i", "incidentmanagement", "incidents"],
    "BPIC2013O": ["bpic2013o", "bpi2013o", "bpichallenge2013o", "openproblems"],
    "BPIC2013C": ["bpic2013c", "bpi2013c", "bpichallenge2013c", "closedproblems"],
    "BPIC2017O": ["bpic2017o", "bpi2017o", "bpichallenge2017o"],
    "BPIC2019": ["bpic2019", "bpi2019", "bpichallenge2019"],
    "BPIC2020D": ["bpic2020d", "bpichallenge2020d", "domesticdeclaration"],
    "BPIC2020I": ["bpic2020i", "bpichallenge2020i", "internationaldeclaration"],
    "BPIC2020Pe": ["bpic2020pe", "bpichallenge2020pe", "travelpermit"],
    "BPIC2020Pr": ["bpic2020pr", "bpichallenge2020pr", "prepaidtravelcost"],
    "BPIC2020R": ["bpic2020r", "bpichallenge2020r", "requestforpayment", "requestsforpayment"],
    "BPIC2012A": ["bpic2012a", "bpi2012a"],
    "BPIC2012O": ["bpic2012o", "bpi2012o", "bpic20120"],
    "BPIC2012W": ["bpic2012w", "bpi2012w"],
    "Hospital-billing": ["hospitalbilling"],
    "Receipt": ["receipt"],
    "Sepsis": ["sepsis"],
    "Helpdesk": ["helpdesk"],
    "Production": ["production"],
    "Road_Traffic_Fine": ["roadtrafficfine"],
    "Service-process": ["serviceprocess"],
}


# Parts of file names by which the label tool knows a log, tried in this order.
DATASET_ALIASES: dict[str, list[str]] = {
    "BPIC2013I": ["bpic2013i", "bpi_challenge_2013_i", "bpi2013i", "incident"],
    "BPIC2013O": ["bpic2013o", "bpi_challenge_2013_o", "bpi2013o", "open problems", "open_problem"],
    "BPIC2013C": ["bpic2013c", "bpi_challenge_2013_c", "bpi2013c", "closed problems", "closed_problem"],
    "BPIC2017O": ["bpic2017o", "bpi challenge 2017 o", "bpi_challenge_2017_o", "2017o", "offer graph", "ocel"],
    "BPIC2019": ["bpic2019", "bpi challenge 2019", "bpi_challenge_2019", "purchase order"],
    "BPIC2020D": ["bpic2020d", "bpi_challenge_2020_d", "2020d", "domestic declarations", "domestic_declarations"],
    "BPIC2020I": ["bpic2020i", "bpi_challenge_2020_i", "2020i", "international declarations", "international_declarations"],
    "BPIC2020Pe": ["bpic2020pe", "bpi_challenge_2020_pe", "2020pe", "travel permits", "travel_permits"],
    "BPIC2020Pr": ["bpic2020pr", "bpi_challenge_2020_pr", "2020pr", "prepaid travel", "prepaid_travel"],
    "BPIC2020R": ["bpic2020r", "bpi_challenge_2020_r", "2020r", "request for payment", "request_for_payment"],
    "BPIC2012A": ["bpic2012a", "bpi_challenge_2012_a", "bpic_2012_a"],
    "BPIC2012O": ["bpic2012-o", "bpic2012o", "bpi_challenge_2012_o", "2012-o", "bpic_2012_o"],
    "BPIC2012W": ["bpic2012-w", "bpic2012w", "bpi_challenge_2012_w", "2012-w", "bpic_2012_w"],
    "Hospital-billing": ["hospital-billing", "hospital_billing", "hospital billing"],
    "Receipt": ["receipt", "receiving phase"],
    "Sepsis": ["sepsis"],
    "Helpdesk": ["helpdesk", "help desk"],
    "Production": ["production"],
    "Road_Traffic_Fine": ["road_traffic_fine", "road traffic fine", "traffic fines", "traffic_fines"],
    "Service-process": ["service-process", "service_process", "service process"],
}


def dataset_from_path(
    path: Column, spellings: Mapping[str, Sequence[str]] = DATASET_SPELLINGS
) -> Column:
    """Dataset whose longest spelling occurs in the path; ties by name, descending.

    Path and spellings are compared as letters and digits only.
    """
    token = alnum_token(path)
    hints = _spelling_array(spellings)
    hits = F.filter(hints, lambda h: F.contains(token, h["word"]))
    return F.array_max(F.transform(hits, lambda h: record(size=h["size"], dataset=h["dataset"])))["dataset"]


def first_dataset_in_path(path: Column, aliases: Mapping[str, Sequence[str]] = DATASET_ALIASES) -> Column:
    """First dataset, in the given order, with an alias inside the lower-cased path."""
    low = F.lower(path.cast("string"))
    return F.coalesce(
        *[
            F.when(F.greatest(F.lit(False), *[F.contains(low, F.lit(a)) for a in words]), name)
            for name, words in aliases.items()
        ]
    )


def normalize_dataset_name(
    name: Column, spellings: Mapping[str, Sequence[str]] = DATASET_SPELLINGS
) -> Column:
    """Name whose spelling equals the text, letters and digits only; else unchanged."""
    token = alnum_token(name)
    hits = F.filter(
        _spelling_array(spellings, own_name=True), lambda h: h["word"] == token
    )
    return F.coalesce(F.get(hits, 0)["dataset"], name)


def _spelling_array(spellings: Mapping[str, Sequence[str]], own_name: bool = False) -> Column:
    def token(text: str) -> str:
        return "".join(ch for ch in text.lower() if ch.isascii() and ch.isalnum())

    pairs = [
        (name, token(word))
        for name, words in spellings.items()
        for word in ([name] if own_name else []) + list(words)
    ]
    return F.array(
        *[
            record(size=F.lit(len(w)), dataset=F.lit(name), word=F.lit(w))
            for name, w in pairs if w
        ]
    )
