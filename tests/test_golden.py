"""Hand-derived results on small logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewright import presets
from tracewright.functions import text as X
from tracewright.functions.answers import parse_days
from tracewright.operators import corpus, metrics, outcomes, sampling
from tracewright.operators.ordering import add_remaining_time, order_events
from tracewright.operators.prefixes import plan_prefixes
from tracewright.operators.segments import Windows, segment_cases, segment_stories

UTC = dt.timezone.utc


def log(spark, rows, extra=""):
    schema = "dataset string, case_id string, activity string, ts timestamp, in_order long" + extra
    return spark.createDataFrame(rows, schema)


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2017, 1, 1, tzinfo=UTC) + dt.timedelta(days=day, hours=hour, minutes=minute, seconds=second)


def one(spark, col, value, type_):
    return spark.createDataFrame([(value,)], f"x {type_}").select(col).first()[0]


def travel(spark):
    rows = [
        ("BPIC2020D", "c", "submit  declaration", dt.datetime(2017, 1, 9, 9, 49, 50, tzinfo=UTC), 0, "EMPLOYEE", "STAFF MEMBER"),
        ("BPIC2020D", "c", "handle payment", dt.datetime(2017, 1, 12, 17, 31, 22, tzinfo=UTC), 2, "UNDEFINED", "SYSTEM"),
        ("BPIC2020D", "c", "approve declaration by administration", dt.datetime(2017, 1, 9, 11, 27, 48, tzinfo=UTC), 1, "ADMINISTRATION", "STAFF MEMBER"),
    ]
    return log(spark, rows, ", `org:role` string, `org:resource` string")


def test_story(spark):
    text = segment_stories(travel(spark), presets.narratives()).first()["text"]
    assert text == (
        "This is a domestic travel declaration case. The case started with \"submit declaration\" on day 0, "
        "with role employee and resource staff member. Later the same day, it went through \"approve declaration "
        "by administration\" on day 0, with role administration and resource staff member. 3 days later, it went "
        "through \"handle payment\" on day 3, with role undefined and resource system."
    )


def test_resumed_story_without_intro_and_quotes(spark):
    from tracewright.operators.prefixes import all_examples

    rows = all_examples(travel(spark), None, presets.narratives(), max_events=1, intro=False, quote=False)
    assert rows.first()["input_story"] == (
        "Later the same day in the case, the case resumed with approve declaration by administration on day 0, "
        "with role administration and resource staff member."
    )


def test_case_fields_and_no_later_values_in_prompts(spark):
    from tracewright.operators.prefixes import all_examples

    rows = [("BPIC2020Pe", "p", a, at(i), i, o) for i, (a, o) in enumerate(
        [("a", None), ("b", None), ("c", "True"), ("d", None)])]
    events = log(spark, rows, ", `case:Overspent` string")
    story = segment_stories(events, presets.narratives()).first()["text"]
    assert story.startswith("This is a travel permit case. At the case level, the case is overspent. The case")
    told = {r["prefix_len"]: r["input_story"] for r in all_examples(events, None, presets.narratives()).collect()}
    assert told[2].startswith("This is a travel permit case. The case started")
    assert "overspent" in told[3]


def starts(n, size):
    return {
        (50, 32): [0, 16, 18], (50, 24): [0, 12, 24, 26], (50, 16): [0, 8, 16, 24, 32, 34],
        (70, 32): [0, 16, 32, 38], (70, 24): [0, 12, 24, 36, 46], (70, 16): [0, 8, 16, 24, 32, 40, 48, 54],
    }[n, size]


def test_segments(spark):
    rows = [("d", str(n), "a", at(i), i) for n in (3, 40, 50, 70, 86) for i in range(n)]
    got = {}
    for r in segment_cases(order_events(log(spark, rows))).orderBy("slice_id").collect():
        got.setdefault(int(r["case_id"]), []).append((r["slice_type"], r["slice_start"], r["slice_end"], r["slice_id"]))
    assert [g[0] for g in got[40]] == ["full"] and got[3] == [("full", 0, 3, 0)]
    for n in (50, 70):
        want = [("full", 0, n)] if n <= 64 else []
        want += [(f"window_{s}", a, a + s) for s in (32, 24, 16) for a in starts(n, s)]
        assert got[n] == [(*w, i) for i, w in enumerate(want)]
    everything = [(f"window_{s}", a, a + s) for s in (32, 24, 16)
                  for a in sorted({*range(0, 86 - s + 1, s // 2), 86 - s})]
    kept = [*range(10), *range(11, 20), 21]
    assert len(everything) == 22
    assert got[86] == [(*everything[k], i) for i, k in enumerate(kept)]


def test_prefix_lengths(spark):
    cases = spark.createDataFrame([("d", str(n), n) for n in (2, 3, 8, 9, 20)], "dataset string, case_id string, trace_len long")
    got = {}
    for r in plan_prefixes(cases).collect():
        got.setdefault(r["trace_len"], []).append(r["prefix_len"])
    got = {n: sorted(v) for n, v in got.items()}
    assert got == {3: [2], 8: [2, 3, 4, 5, 6, 7], 9: [2, 3, 4, 6, 7, 8], 20: [2, 4, 10, 13, 18, 19]}


def test_prefix_lengths_of_very_long_cases_are_topped_up(spark):
    cases = spark.createDataFrame([("d", "x", 10**9)], "dataset string, case_id string, trace_len long")
    got = [r["prefix_len"] for r in plan_prefixes(cases, cap=30).collect()]
    assert len(got) == len(set(got)) == 30 and min(got) == 2 and max(got) == 10**9 - 1


@pytest.mark.parametrize("events, want", [
    ([("release a", 0), ("return er", 28)], 0),
    ([("release a", 0), ("return er", 28.001)], 1),
    ([("return er", 1), ("release a", 2)], 0),
    ([("release a", 0), ("other", 3)], 1),
    ([("release a", 0), ("release b", 30), ("return er", 40), ("return er", 90)], 0),
    ([("release a", 0), ("return er", None)], 0),
])
def test_return_gap(spark, events, want):
    rows = [("Sepsis", "c", a, None if d is None else at(d), i) for i, (a, d) in enumerate(events)]
    assert outcomes.case_outcomes(log(spark, rows), presets.outcome_rules()).first()["value"] == want


@pytest.mark.parametrize("days, want", [(5.0, 1), (5.001, 0)])
def test_duration_limit(spark, days, want):
    rows = [("Service-process", "c", "start", at(0), 0), ("Service-process", "c", "Complete Service  Order", at(days), 1)]
    assert outcomes.case_outcomes(log(spark, rows), presets.outcome_rules()).first()["value"] == want


def test_first_flag_beats_duration(spark):
    rows = [("Service-process", "c", "x", at(1), 1, "N"), ("Service-process", "c", "x", at(0), 2, "yes"),
            ("Service-process", "c", "completed", at(0), 0, "?")]
    events = log(spark, rows, ", REPAIR_IN_TIME_5D string")
    assert outcomes.case_outcomes(events, presets.outcome_rules()).first()["value"] == 0


def test_null_time_event_is_last(spark):
    rows = [("BPIC2013I", "c", "complete incident", None, 0), ("BPIC2013I", "c", "queue incident", at(3), 1),
            ("BPIC2013O", "d", "complete problem", at(0), 1), ("BPIC2013O", "d", "queue", at(0), 0)]
    got = {r["case_id"]: r["value"] for r in outcomes.case_outcomes(log(spark, rows), presets.outcome_rules()).collect()}
    assert got == {"c": 1, "d": 1}


def test_all_preset_rules_in_one_pass(spark):
    rows = [
        ("Receipt", "1", "T10 Determine necessity to stop indication", at(0), 0),
        ("Receipt", "2", "T02", at(0), 0), ("Helpdesk", "3", "closed", at(0), 0), ("Helpdesk", "4", "closed", at(0), 0),
        ("Helpdesk", "4", "Invalid", at(1), 1), ("Hospital-billing", "5", "BILLED", at(0), 0),
        ("Hospital-billing", "6", "fin", at(0), 0), ("Hospital-billing", "6", "reopen", at(1), 1),
        ("Road_Traffic_Fine", "7", "Payment", at(0), 0), ("Road_Traffic_Fine", "8", "send for credit collection", at(0), 0),
        ("Production", "9", "Rework - milling", at(0), 0), ("BPIC2017O", "10", "O_Accepted", at(0), 0),
        ("BPIC2012W", "11", "x", at(0), 0), ("BPIC2012W", "12", "x", at(0), 0), ("BPIC2012A", "11", "Accepted", at(0), 0),
    ]
    events = log(spark, rows)
    accepted = outcomes.case_outcomes(events.where("dataset = 'BPIC2012A'"), presets.outcome_rules())
    got = {r["case_id"] + r["dataset"][:5]: r["value"]
           for r in outcomes.case_outcomes(events, presets.outcome_rules(accepted)).collect()}
    assert got == {"1Recei": 0, "2Recei": 1, "3Helpd": 1, "4Helpd": 0, "5Hospi": 1, "6Hospi": 0, "7Road_": 1,
                   "8Road_": 0, "9Produ": 0, "10BPIC2": 1, "11BPIC2": 1, "12BPIC2": None}


def test_amounts(spark):
    rows = [("Road_Traffic_Fine", "a", "x", at(0), 0, "35.0", None), ("Road_Traffic_Fine", "a", "x", at(1), 1, None, 35.0),
            ("Road_Traffic_Fine", "b", "payment", at(0), 0, "35", 20.0), ("Road_Traffic_Fine", "c", "payment", at(0), 0, "n/a", 20.0)]
    events = log(spark, rows, ", amount string, totalPaymentAmount double")
    got = {r["case_id"]: r["value"] for r in outcomes.case_outcomes(events, presets.outcome_rules()).collect()}
    assert got == {"a": 1, "b": 0, "c": 1}


@pytest.mark.parametrize("days, want", [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0)])
def test_remaining_time_rounds_half_to_even(spark, days, want):
    rows = [("d", "c", "a", at(0), 0), ("d", "c", "b", at(0, hour=int(days * 24)), 1), ("d", "c", "z", None, 2)]
    got = {r["activity"]: r["remaining_time"] for r in add_remaining_time(log(spark, rows)).collect()}
    assert got == {"a": want, "b": 0.0, "z": None}


@pytest.mark.parametrize("value, type_, want", [
    (3.0, "double", "3"), (2.5, "double", "2.5"), (2.675, "double", "2.67"), (-0.0, "double", "0"), (float("nan"), "double", None),
    (7, "long", "7"), (True, "boolean", "yes"), (" TRUE ", "string", "yes"), ("no", "string", "no"), ("  ", "string", None),
    (" x y　", "string", "x y"), ("true story", "string", "true story"),
])
def test_value_text(spark, value, type_, want):
    df = spark.createDataFrame([(value,)], f"x {type_}")
    assert df.select(X.value_text(df, "x")).first()[0] == want


@pytest.mark.parametrize("n, want", [(0, ""), (1, "a"), (2, "a and b"), (3, "a, b, and c"), (4, "a, b, c, and d")])
@pytest.mark.parametrize("width", [4, 5])
def test_phrases(spark, n, want, width):
    words = list("abcd")[:n] + [None, " "] * 3
    cols = [F.lit(w).cast("string") for w in words[:max(width, n)]]
    assert spark.range(1).select(X.join_phrases(cols)).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    ("  a \t b ,c ; d", "a b,c; d"), ("plain", "plain"), ("x  .", "x."), (" ", ""),
])
def test_compact_text(spark, raw, want):
    assert one(spark, X.compact_text(F.col("x")), raw, "string") == want


@pytest.mark.parametrize("raw, want", [("a", "a."), ("a!", "a!"), ("", ""), ("a .", "a."), ("what ?", "what ?")])
def test_end_sentence(spark, raw, want):
    assert one(spark, X.end_sentence(F.col("x")), raw, "string") == want
    if raw:
        assert one(spark, X.end_compact(F.col("x")), raw, "string") == want


@pytest.mark.parametrize("ratio, want", [(0.33, "early"), (0.34, "middle"), (0.66, "middle"), (0.67, "late")])
def test_stage(spark, ratio, want):
    assert one(spark, metrics.stage(F.col("x")), ratio, "double") == want


@pytest.mark.parametrize("text, want", [
    ("about -3.7 days", 0), ("no idea", None), ("12", 12), ("between 3 and 4.9 days", 4), ("", None), (None, None),
])
def test_parse_days(spark, text, want):
    assert one(spark, parse_days(F.col("x")), text, "string") == want


@pytest.mark.parametrize("n, held", [(4, 0), (5, 1), (100, 2)])
def test_variant_split(spark, n, held):
    rows = [("d", str(i), "v") for i in range(n)] + [("d", f"w{i}", "w") for i in range(100)]
    cases = spark.createDataFrame(rows, "dataset string, case_id string, variant_id string")
    got = sampling.split_variant_stratified(cases, 0.02, 1).where("split = 'validation'").groupBy("variant_id").count()
    assert dict(got.collect()).get("v", 0) == held


def test_split_moves_one_case_when_nothing_is_held_out(spark):
    cases = spark.createDataFrame([("d", str(i), str(i)) for i in range(3)] + [("e", "0", "0")],
                                  "dataset string, case_id string, variant_id string")
    got = sampling.split_variant_stratified(cases, 0.5, 1).groupBy("dataset", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("d", "train"): 2, ("d", "validation"): 1, ("e", "train"): 1}


def test_label_conflicts_and_unknown_words(spark):
    rows = [("d", "a", "x", at(0), 0, "success"), ("d", "a", "x", at(0), 1, "Failed"), ("d", "b", "x", at(0), 0, "maybe"),
            ("d", "c", "x", at(0), 0, None), ("d", "e", "x", at(0), 0, "1"), ("d", "e", "x", at(0), 1, None)]
    got = {r["case_id"]: r["problem"] for r in outcomes.check_labels(log(spark, rows, ", label string")).collect()}
    assert got == {"a": "several labels", "b": "unknown label", "c": "no label"}


def test_outcome_words_are_checked(spark):
    with pytest.raises(ValueError):
        outcomes.check_words("good", " GOOD ")
    with pytest.raises(ValueError):
        outcomes.case_outcomes(log(spark, []), {"d": outcomes.Contains(" ", ["a"])})


def test_masking(spark):
    df = spark.createDataFrame([("### Instruction\nq\n\n### Response\na b c",)], "text string")
    row = corpus.mask_prompt(df, 100, tokenizer=corpus.word_ids).first()
    assert row["loss_tokens"] == 3 and row["labels"][-3:] == row["input_ids"][-3:]
    assert set(row["labels"][:-3]) == {-100} and row["response"] == "a b c"
    cut = corpus.mask_prompt(df, 4).first()
    assert len(cut["input_ids"]) == 4 and cut["labels"] == [-100] + cut["input_ids"][1:]
    assert corpus.mask_prompt(df, 0).count() == 0
    with pytest.raises(Exception, match="no response marker"):
        corpus.split_response(spark.createDataFrame([("x",)], "text string")).collect()


def test_windows_keep_a_full_story_when_no_size_fits(spark):
    rows = [("d", "c", "a", at(i), i) for i in range(80)]
    got = segment_cases(order_events(log(spark, rows)), Windows(sizes=(100,))).collect()
    assert [(r["slice_type"], r["slice_end"]) for r in got] == [("full", 80)]
