"""Reading and writing logs and corpora, and the flows over folders."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracewright import presets, schema
from tracewright.operators import canonicalize as CN
from tracewright.functions.prompts import NEXT, TIME
from tracewright.operators import corpus, instructions, outcomes
from tracewright.operators.outcomes import Contains
from tracewright.operators.scoring import predict_in_batches, score
from tracewright.plans import flows, preparation
from tracewright.sources import readers, staged, writers
from workload.logs import NARRATIVES, item_log
from workload.queries import RULE_TEXTS, item_labels

SF = "/root/testdata/sf0.001"

XES = """<?xml version="1.0"?><log><string key="concept:name" value="whole"/>
<trace><string key="concept:name" value="c1"/><float key="amount" value="3.5"/>
 <event><string key="concept:name" value="A"/><date key="time:timestamp" value="2020-01-01T10:00:00.000+02:00"/><boolean key="done" value="true"/></event>
 <event><string key="concept:name" value="B"/><date key="time:timestamp" value="2020-01-02T08:00:00Z"/><int key="n" value="7"/></event></trace>
<trace><string key="concept:name" value="c2"/><event><string key="concept:name" value="A"/></event></trace></log>"""


@pytest.mark.parametrize("name", ["log.xes", "log.xes.gz"])
def test_xes(spark, tmp_path, name):
    path = tmp_path / name
    (gzip.open if name.endswith("gz") else open)(path, "wt").write(XES)
    raw = readers.read_any(spark, str(path))
    assert {"case:concept:name", "case:amount", "concept:name", "time:timestamp", "n", "done"} <= set(raw.columns)
    assert dict(raw.dtypes)["n"] == "bigint" and dict(raw.dtypes)["case:amount"] == "double"
    log = schema.event_log(raw, "x", activity="concept:name", ts="time:timestamp").orderBy("in_order")
    got = [(r["case_id"], r["activity"], str(r["ts"])) for r in log.select(
        "case_id", "activity", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts")).collect()]
    assert got == [("c1", "A", "2020-01-01 08:00"), ("c1", "B", "2020-01-02 08:00"), ("c2", "A", "None")]


def test_csv_separator_encoding_and_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('Case ID;Activity;Complete Timestamp;note\n7;größer;2020-01-01 00:00:00;"two\nlines ""x"""\n'.encode("latin-1"))
    raw = readers.read_csv(spark, str(path))
    log = schema.event_log(raw, "d")
    row = log.first()
    assert (row["case_id"], row["activity"], row["note"]) == ("7", "größer", 'two\nlines "x"')
    (tmp_path / "b.csv").write_text("case,activity\n1,naïve\n", encoding="utf-8")
    assert readers.find_encoding(spark, str(tmp_path / "b.csv")) == "UTF-8"
    assert readers.find_separator(spark, str(tmp_path / "b.csv")) == ","


def test_roles(spark):
    assert schema.resolve_column(["X", "Case_ID"], schema.CASE_NAMES) == "Case_ID"
    assert schema.find_column(["my activity here"], ["activity"]) == "my activity here"
    assert schema.find_keyword_column(["paid", "total paid amount", "amount"], ["total", "amount"]) == "total paid amount"
    assert schema.find_keyword_column(["x", "amounts"], ["total", "amount"]) == "amounts"
    with pytest.raises(KeyError):
        schema.resolve_column(["a"], ["b"])
    df = spark.createDataFrame([(" 1 ", "a", "2020-13-01", float("nan")), (None, "b", "", 1.0), ("2", "c", "01.02.2020", 2.0)],
                               "case string, activity string, timestamp string, x double")
    log = schema.event_log(df, "d", ts_formats=["dd.MM.yyyy"]).collect()
    assert [(r["case_id"], r["ts"] is None, r["x"]) for r in log] == [("1", True, None), ("2", False, 2.0)]
    lost = schema.unparsed_timestamps(df, "timestamp", ["dd.MM.yyyy"]).first()
    assert (lost["n_rows"], lost["n_unparsed"]) == (3, 2)
    assert schema.parse_names("a, b,,a") == ["a", "b"] and schema.parse_sizes("16,8") == [16, 8]
    assert schema.parse_ratios("0, 0.5", [1]) == [0.5] and schema.parse_ratios("", [1]) == [1]


@pytest.mark.parametrize("path, want", [
    ("/data/BPI_Challenge_2013_I.csv", "BPIC2013I"), ("/x/Hospital billing/log.xes.gz", "Hospital-billing"),
    ("/BPIC2020/Pe/x.csv", "BPIC2020Pe"), ("/2019/x.csv", None), ("/BPIC2020Pe.csv", "BPIC2020Pe"), ("/road-traffic-fines.csv", "Road_Traffic_Fine"),
    ("/requests for payment.xes", "BPIC2020R"), ("/other.csv", None),
])
def test_dataset_from_path(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(schema.dataset_from_path(F.col("p"))).first()[0] == want


@pytest.mark.parametrize("name, want", [
    ("Service_process", "Service-process"), ("BPI Challenge 2020 Pe", "BPIC2020Pe"), ("mine", "mine")])
def test_dataset_names(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(schema.normalize_dataset_name(F.col("n"))).first()[0] == want


def test_map_checks(spark):
    m = spark.createDataFrame([("d", "A  b", "x"), ("d", "A b", "y"), ("d", "c", "X"), ("e", "q", "r")],
                              "dataset string, raw string, canonical string")
    got = {(r["problem"], r["name"]) for r in CN.check_activity_map(m).collect()}
    assert got == {("key with several names", "A b"), ("name with several keys", "x")}
    events = spark.createDataFrame([("e", "q"), ("e", "z")], "dataset string, activity string")
    with pytest.raises(ValueError, match="outside the map"):
        CN.canonicalize(events, m.where("dataset = 'e'"), strict=True)
    assert sorted(r[0] for r in CN.canonicalize(events, m).select("activity").collect()) == ["r", "z"]


def prepared_folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "helpdesk.csv").write_text(
        "Case ID,Activity,Complete Timestamp\n1,Take,2020-01-01 00:00:00\n1,Closed,2020-01-03 12:00:00\n2,Take,2020-01-01 00:00:00\n")
    (raw / "BPIC2019.csv").write_text("Case ID,Activity,Complete Timestamp\n1,Odd,2020-01-01\n")
    (raw / "unknown.csv").write_text("a,b\n1,2\n")
    return str(raw)


def test_folders(spark, tmp_path):
    raw, out = prepared_folder(tmp_path), str(tmp_path)
    names = spark.createDataFrame([("Helpdesk", "Take", "take in charge ticket"), ("Helpdesk", "Closed", "close ticket"),
                                   ("BPIC2019", "x", "y")], "dataset string, raw string, canonical string")
    first = preparation.canonicalize_logs(spark, raw, f"{out}/mapped", names, fmt="parquet")
    assert [d["dataset"] for d in first.done] == ["Helpdesk"] and first.skipped.count() == 1
    assert first.errors[0]["dataset"] == "BPIC2019" and "outside the map" in first.errors[0]["error"]
    assert spark.read.json(f"{out}/mapped/_errors").count() == 1
    second = preparation.label_logs(spark, f"{out}/mapped", f"{out}/labelled", presets.outcome_rules(), fmt="parquet")
    assert second.done[0]["n_positive_cases"] == 1 and second.done[0]["n_negative_cases"] == 1
    third = preparation.remaining_time_logs(spark, f"{out}/labelled/Helpdesk", f"{out}/timed", fmt="csv")
    assert not third.errors
    got = spark.read.options(header=True).csv(f"{out}/timed/Helpdesk")
    assert {(r["case_id"], r["activity"], r["label"], r["remaining_time"]) for r in got.collect()} == {
        ("1", "take in charge ticket", "success", "2.0"), ("1", "close ticket", "success", "0.0"),
        ("2", "take in charge ticket", "failure", "0.0")}


def test_logs_of_several_parts(spark, tmp_path):
    rows = [(f"c{i % 20}", "closed" if i >= 380 and i % 2 else "take", f"2020-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(400)]
    log = spark.createDataFrame(rows, "`Case ID` string, Activity string, `Complete Timestamp` string")
    raw = str(tmp_path / "raw")
    log.repartition(3).write.parquet(f"{raw}/helpdesk.parquet")
    names = spark.createDataFrame([("Helpdesk", "take", "take"), ("Helpdesk", "closed", "close ticket")], "dataset string, raw string, canonical string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 100)
    try:
        preparation.canonicalize_logs(spark, raw, f"{raw}1", names, fmt="csv")
        labelled = preparation.label_logs(spark, f"{raw}1", f"{raw}2", presets.outcome_rules(), fmt="parquet")
        timed = preparation.remaining_time_logs(spark, f"{raw}2", f"{raw}3", fmt="parquet")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert not labelled.errors and not timed.errors
    assert labelled.done[0]["n_events"] == "400" or labelled.done[0]["n_events"] == 400
    assert (labelled.done[0]["n_positive_cases"], labelled.done[0]["n_negative_cases"]) == (10, 10)
    back = readers.read_named(spark, f"{raw}3", "Helpdesk")
    assert back.count() == 400 and back.groupBy("case_id").agg(F.count_distinct("label").alias("n")).where("n <> 1").count() == 0
    assert back.where("remaining_time IS NULL").count() == 0


def test_labels_from_a_related_log(spark, tmp_path):
    raw = str(tmp_path / "raw")
    for name, act in (("bpic2012a", "accept application"), ("bpic2012w", "work")):
        df = spark.createDataFrame([("1", act, "2020-01-01"), ("2", "other", "2020-01-01")], "case_id string, activity string, timestamp string")
        df.write.parquet(f"{raw}/{name}.parquet")
    done = preparation.label_logs(spark, raw, f"{tmp_path}/out", presets.outcome_rules(), fmt="parquet")
    assert not done.errors and {d["dataset"] for d in done.done} == {"BPIC2012A", "BPIC2012W"}
    got = readers.read_named(spark, f"{tmp_path}/out", "BPIC2012W").select("case_id", "label").collect()
    assert {tuple(r) for r in got} == {("1", "success"), ("2", "failure")}


def test_mixed_kinds_of_an_attribute_stay_text(spark, tmp_path):
    (tmp_path / "l.xes").write_text(
        '<log><trace><string key="concept:name" value="1"/><event><string key="concept:name" value="a"/><int key="v" value="3"/></event>'
        '<event><string key="concept:name" value="b"/><string key="v" value="high"/></event></trace></log>')
    got = readers.read_xes(spark, str(tmp_path / "l.xes"))
    assert dict(got.dtypes)["v"] == "string" and {r["v"] for r in got.collect()} == {"3", "high"}


def test_rule_columns_by_other_spellings(spark):
    rules = presets.outcome_rules()
    bills = spark.createDataFrame([("Hospital-billing", "1", "new", True), ("Hospital-billing", "2", "new", False)],
                                  "dataset string, case_id string, activity string, IS_CLOSED boolean")
    fines = spark.createDataFrame([("Road_Traffic_Fine", "1", "x", 10.0, 10.0), ("Road_Traffic_Fine", "2", "x", 10.0, 9.0)],
                                  "dataset string, case_id string, activity string, `fine amount` double, Total_Payment_Amount double")
    parts = spark.createDataFrame([("Production", "1", "x", 0), ("Production", "2", "x", 2)],
                                  "dataset string, case_id string, activity string, `qty rejected today` int")
    services = spark.createDataFrame([("Service-process", "1", "x", "yes"), ("Service-process", "2", "x", "no")],
                                     "dataset string, case_id string, activity string, repair_in_time_5d string")
    for log in (bills, fines, parts, services):
        log = log.withColumns({"ts": F.lit(None).cast("timestamp"), "in_order": F.lit(0).cast("long")})
        dataset = log.first()["dataset"]
        got = {r["case_id"]: r["value"] for r in outcomes.case_outcomes(log, {dataset: rules[dataset]}).collect()}
        assert got == {"1": 1, "2": 0}, dataset


def test_unclear_labels_are_left_out_or_refused(spark):
    rows = [(c, i, w) for c, words in (("1", ["success"] * 3), ("2", ["success", "failure", "success"]), ("3", ["success", "perhaps", None]))
            for i, w in enumerate(words)]
    log = spark.createDataFrame(rows, "case_id string, in_order long, label string").withColumns({
        "dataset": F.lit("d"), "activity": F.lit("a"), "ts": F.lit(None).cast("timestamp")})
    assert [r["case_id"] for r in flows.labelled_cases(log).collect()] == ["1"]
    with pytest.raises(ValueError, match="clear outcome"):
        flows.labelled_cases(log, strict=True)


def test_every_prompt_is_scored(spark):
    prompts = spark.createDataFrame(
        [("d", NEXT, "1", 2, "pay"), ("d", NEXT, "2", 2, "pay"), ("d", TIME, "1", 2, "3")],
        "dataset string, task string, case_id string, prefix_len int, gold string").withColumns({
            "trace_len": F.lit(5), "prefix_ratio": F.lit(0.4), "story_segment_start": F.lit(0), "story_n_events": F.lit(2),
            "candidates": F.array(F.lit("pay"), F.lit("go"))})
    inventory = spark.createDataFrame([("d", ["pay", "go"])], "dataset string, activities array<string>")
    out = spark.createDataFrame([("d", NEXT, "1", 2, "\u00a0Pay ")], "dataset string, task string, case_id string, prefix_len int, raw_output string")
    got = {(r["task"], r["case_id"]): r for r in score(prompts, out, inventory).collect()}
    assert len(got) == 3 and got[NEXT, "1"]["is_correct"] and got[NEXT, "1"]["raw_output"] == "Pay"
    assert not got[NEXT, "2"]["is_valid_parse"] and not got[TIME, "1"]["is_valid_parse"] and got[TIME, "1"]["prediction"] == "0"
    with pytest.raises(Exception, match="several outputs"):
        score(prompts, out.unionByName(out), inventory).collect()


def test_prepare_in_one_plan(spark):
    log = item_log(spark, SF)
    done = flows.prepare_logs(log, None, {"lineitem": Contains("r/f", ["r/f"])})
    assert done.count() == log.count() and {"label", "remaining_time"} <= set(done.columns)


@pytest.mark.parametrize("fmt", ["csv", "jsonl", "both"])
def test_samples_round_trip(spark, tmp_path, fmt):
    rows = spark.createDataFrame([("train", 'a "q"\nb', ["x", "y, z"]), ("validation", "c", None)],
                                 "split string, text string, candidates array<string>")
    writers.write_samples(rows, str(tmp_path), fmt)
    if fmt != "jsonl":
        back = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{tmp_path}/csv")
        got = {(r["split"], r["text"], r["candidates"]) for r in back.collect()}
        assert got == {("train", 'a "q"\nb', '["x", "y, z"]'), ("validation", "c", None)}
    if fmt != "csv":
        assert spark.read.json(f"{tmp_path}/jsonl").where("split = 'train'").first()["candidates"] == ["x", "y, z"]
    with pytest.raises(ValueError):
        writers.write_samples(rows, str(tmp_path), "xml")


def test_corpus_reader(spark, tmp_path):
    (tmp_path / "train.csv").write_text('text\n"one\nline"\n')
    (tmp_path / "train.jsonl").write_text(json.dumps({"text": "from json"}) + "\n")
    spark.createDataFrame([("held",)], "text string").write.parquet(str(tmp_path / "dev.parquet"))
    by_json = readers.read_corpus(spark, str(tmp_path))
    assert by_json["train"].first()["text"] == "from json" and by_json["validation"].first()["text"] == "held"
    by_csv = readers.read_corpus(spark, str(tmp_path), prefer=("csv", "jsonl", "json", "parquet"))
    assert by_csv["train"].first()["text"] == "one\nline"
    assert list(readers.read_corpus(spark, str(tmp_path / "train.csv"))) == ["train"]
    with pytest.raises(ValueError):
        writers.write_corpus(by_csv["train"], str(tmp_path / "x.json"))
    writers.write_corpus(by_csv["train"], str(tmp_path / "out.csv"))
    assert readers.read_corpus(spark, str(tmp_path / "out.csv"))["train"].first()["text"] == "one\nline"


def guess(prompts):
    return ["The next activity is: r/f." if "next activity of" in p else "about 300 days" if "integer" in p else "failure"
            for p in prompts]


def test_evaluation(spark, tmp_path):
    log, labels = item_log(spark, SF), item_labels(spark, SF)
    result = flows.evaluate(log, NARRATIVES, RULE_TEXTS, lambda p: predict_in_batches(p, guess, 3), labels=labels)
    n = result.summary.first()
    got = result.predictions.groupBy("task").agg(
        F.count("*").alias("n"), F.count_if("is_valid_parse").alias("valid"), F.count_distinct("prediction").alias("kinds"))
    assert {(r["n"], r["valid"], r["kinds"]) for r in got.collect()} == {(n["zero_shot_test_prefixes"],) * 2 + (1,)}
    by_task = {r["task"]: r for r in result.metrics.collect()}
    right = result.predictions.where("task like 'next%' and is_correct").count()
    assert by_task["next_activity_prediction"]["accuracy"] == pytest.approx(right / n["zero_shot_test_prefixes"])
    assert result.stages.count() > 3 and result.case_macro.count() == 3 and result.dataset_macro.count() == 3
    writers.write_predictions(result.predictions, f"{tmp_path}/p")
    writers.write_case_splits(log, result.split_cases, f"{tmp_path}/s")
    writers.write_report(result.dataset_macro, f"{tmp_path}/m", json=True)
    parts = spark.read.options(header=True).csv(f"{tmp_path}/s/case_ids")
    assert parts.count() == n["baseline_train_cases"] + n["zero_shot_test_cases"] == parts.distinct().count()


def test_missing_rule_is_an_error(spark):
    rows = spark.createDataFrame([("d", "s", ["a"], ["success"], "a", 1, "success")],
                                 "dataset string, input_story string, next_candidates array<string>, outcome_candidates array<string>, "
                                 "next_activity string, remaining_time_days long, final_outcome string")
    with pytest.raises(Exception, match="no outcome rule"):
        instructions.instruction_rows(rows, {"other": "x"}).collect()


def test_tokenizers(spark):
    df = spark.createDataFrame([("a b c",), ("d",), (" ",), (None,)], "text string")
    by_length = corpus.batch_tokenizer(lambda texts: [list(range(len(t))) for t in texts])
    clean = corpus.clean_text(df)
    assert [r["n_tokens"] for r in corpus.token_counts(clean, tokenizer=by_length).collect()] == [5, 1]
    assert corpus.drop_overlong(clean, 5, tokenizer=by_length).count() == 1
    assert corpus.drop_overlong(clean, 4).count() == 2
    ended = clean.select(corpus.append_end(F.col("text"), "</s>").alias("t"))
    assert ended.select(corpus.append_end(F.col("t"), "</s>", only_if_missing=True)).first()[0] == "a b c</s>"


def test_csv_keeps_every_value(spark, tmp_path):
    odd = ["  x ", "", None, "\\N", "\\\\N", "a\r\nb", 'say "hi", ', "\tz", "plain", " "]
    df = spark.createDataFrame([(t,) for t in odd], "text string").coalesce(1)
    writers.write_corpus(df, str(tmp_path / "c.csv"))
    back = [r.text for r in readers.read_corpus(spark, str(tmp_path / "c.csv"))["train"].collect()]
    assert sorted(map(repr, back)) == sorted(map(repr, odd))
    log = spark.createDataFrame([("d", f"c{i}", t) for i, t in enumerate(odd) if t], "dataset string, case_id string, activity string")
    writers.write_logs(log, str(tmp_path / "log"), "csv")
    rows = readers.read_csv(spark, str(tmp_path / "log"), sep=",", encoding="UTF-8", schema="case_id string, activity string").select("case_id", "activity")
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(repr((f"c{i}", t)) for i, t in enumerate(odd) if t)


def test_output_is_whole_or_not_at_all(spark, tmp_path):
    target = f"{tmp_path}/out/log"
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    write = lambda frame, path: frame.write.parquet(path)
    facts = staged.commit(df, target, write, "first", {"of": "test"}, {"sevens": F.count_if(F.col("v") == 0)})
    assert facts == {"of": "test", "n_rows": 100, "sevens": 15}
    assert staged.committed(spark, target, "first") == {"of": "test", "n_rows": "100", "sevens": "15"}
    assert staged.committed(spark, target, "other") is None and staged.committed(spark, f"{target}2") is None

    def half(frame, path):
        frame.limit(10).write.parquet(path)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):  # what was there stays, and nothing of the half is read
        staged.commit(df, target, half, "second")
    assert spark.read.parquet(target).count() == 100 and staged.committed(spark, target, "first")
    # The next run takes the left-over away and puts its rows in the place of the old ones.
    assert staged.commit(df.limit(0), target, write, "third", observed={"most": F.max("v")}) == {"n_rows": 0, "most": None}
    assert spark.read.parquet(target).count() == 0 and staged.committed(spark, target, "third")
    assert not list((tmp_path / "out" / "_staging").iterdir())


def test_changed_parts_are_found(spark, tmp_path):
    target = f"{tmp_path}/log"
    staged.commit(spark.range(100).repartition(3), target, lambda frame, path: frame.write.json(path))
    assert staged.changed_parts(spark, target).isEmpty()
    parts = sorted(tmp_path.glob("log/part-*.json"))
    parts[0].unlink()
    parts[1].write_text(parts[1].read_text() + "{}")
    (tmp_path / "log" / "new.json").write_text("{}")
    got = {tuple(r) for r in staged.changed_parts(spark, target).collect()}
    assert got == {(parts[0].name, "missing"), (parts[1].name, "other size"), ("new.json", "new")}
    assert staged.committed(spark, target) is None


def test_runs_go_on_where_they_ended(spark, tmp_path):
    raw, out = prepared_folder(tmp_path), f"{tmp_path}/out"
    first = preparation.remaining_time_logs(spark, raw, out, fmt="parquet", resume=True)
    assert not first.errors and not first.resumed and {d["dataset"]: d["n_rows"] for d in first.done} == {"Helpdesk": 3, "BPIC2019": 1}
    assert {d["events_without_time"] for d in first.done} == {0}
    (tmp_path / "raw" / "BPIC2019.csv").write_text("Case ID,Activity,Complete Timestamp\n1,Odd,2020-01-01\n1,Odd,never\n")
    second = preparation.remaining_time_logs(spark, raw, out, fmt="parquet", resume=True)
    assert second.resumed == ["Helpdesk"]
    assert {d["dataset"]: (int(d["n_rows"]), int(d["events_without_time"])) for d in second.done} == {"Helpdesk": (3, 0), "BPIC2019": (2, 1)}
    assert spark.read.json(f"{out}/_summary").count() == 2
    third = preparation.remaining_time_logs(spark, raw, out, unit="hours", fmt="parquet", resume=True)
    assert not third.resumed and not preparation.remaining_time_logs(spark, raw, out, fmt="parquet").resumed
    names = readers.read_named(spark, f"{out}/Helpdesk", "Helpdesk")
    assert names.count() == 3


def test_only_faults_of_a_log_are_its_errors(spark, tmp_path, monkeypatch):
    raw = prepared_folder(tmp_path)

    def lost(*args):
        raise RuntimeError("the cluster is gone")

    monkeypatch.setattr(preparation, "add_remaining_time", lost)
    with pytest.raises(RuntimeError, match="gone"):
        preparation.remaining_time_logs(spark, raw, f"{tmp_path}/out")
