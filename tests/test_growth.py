"""What one task or one call holds does not grow with the tables."""

import glob

from pyspark.sql import functions as F

from tracewright.functions.text import json_list
from tracewright.operators import corpus
from tracewright.operators.segments import segment_stories, tell_segments
from workload.logs import NARRATIVES, item_log
from workload.queries import instruction_counts, instruction_meta, instruction_texts, log_tree

SF = "/root/testdata/sf0.001"


def test_parts_of_a_tree_follow_the_table(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16 << 10)
    try:
        root = log_tree(spark, SF)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parts = glob.glob(f"{root.removeprefix('file:')}/raw/lineitem.parquet/*.parquet")
    assert len(parts) > 3
    assert spark.read.parquet(f"{root}/raw/lineitem.parquet").count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_a_tokeniser_of_batches_gets_bounded_batches(spark):
    most = corpus.ENCODED_AT_ONCE

    def encode(texts):
        if len(texts) > 1 and sum(len(t or "") for t in texts) > most:
            raise ValueError("too much at once")
        return [None if t is None else list(t.encode()) for t in texts]

    rows = [(i, "x" * (i * 50_000)) for i in range(30)] + [(30, "y" * (most + 5)), (31, None), (32, ""), (33, "zä")]
    texts = spark.createDataFrame(rows, "i int, text string").coalesce(1)
    ids = texts.select("i", corpus.batch_tokenizer(encode)(F.col("text")).alias("ids"))
    assert {r.i: r.n for r in ids.select("i", F.size("ids").alias("n"), F.col("ids").isNull().alias("none")).where("not none").collect()} == {
        i: len(t.encode()) for i, t in rows if t is not None}
    assert ids.where("ids is null").count() == 1
    assert ids.where("i = 33").first().ids == list("zä".encode())


def test_events_of_a_block_are_sorted_without_a_lambda(spark):
    """array_sort runs an interpreted comparison for each pair of events."""
    told = segment_stories(item_log(spark, SF), NARRATIVES)
    assert "array_sort" not in told._jdf.queryExecution().analyzed().toString()


def test_samples_without_text_tell_no_story(spark):
    """Counts and metadata of samples need no sentence; the plan must not make any."""
    def told(query):
        return "The case started with" in query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()

    assert told(instruction_texts) and not told(instruction_meta) and not told(instruction_counts)


def test_json_lists_of_plain_and_other_texts(spark):
    items = ["a b~", "", 'q"', "back\\slash", "line\n", "end\n", "\x7f", "é", None, "[x]", "\x00"]
    df = spark.createDataFrame([(items,)], "items array<string>")
    texts = df.select(json_list(F.col("items")).alias("got"), F.transform("items", lambda x: F.to_json(F.array(x))).alias("want")).first()
    assert texts.got == "[" + ", ".join(t[1:-1] for t in texts.want) + "]"


def test_only_chosen_segments_are_told(spark):
    log = item_log(spark, SF)
    told = segment_stories(log, NARRATIVES)
    bare = segment_stories(log, NARRATIVES, story=False)
    assert "The case started with" not in bare._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(bare.collect()) == sorted(told.drop("text").collect())
    chosen = bare.where("crc32(cast(case_id as string)) % 3 = 0 and slice_id = 0")
    want = told.join(chosen.select("case_id", "slice_id"), ["case_id", "slice_id"], "left_semi")
    got = tell_segments(log, chosen, NARRATIVES)
    assert 0 < got.count() < told.count() and sorted(got.select(want.columns).collect()) == sorted(want.collect())
