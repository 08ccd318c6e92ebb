"""Hot groups, block borders, partitioning and row order do not change results."""

import datetime as dt
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.operators import blocks, corpus, prefixes, sampling, segments
from tracewright.operators.cases import case_table, variant_texts
from tracewright.operators.ordering import (
    add_remaining_time, find_hot_cases, order_events, with_case_columns,
)
from tracewright.scale import rank_by_hash, top_per_group
from workload.logs import NARRATIVES, item_log, user_log

SF = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def skewed_log(spark, hot_events=1500):
    """One case holds most events; many of its times are equal or missing."""
    rng = random.Random(7)
    start = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    data = []
    for i in range(hot_events):
        ts = None if i % 97 == 0 else start + dt.timedelta(minutes=0 if i < 600 else rng.randrange(9000))
        data.append(("events", "hot", rng.choice("abc"), ts, i, float(i % 7), i % 3))
    for c in range(40):
        for i in range(rng.randrange(1, 60)):
            data.append(("events", f"c{c}", rng.choice("abc"), start + dt.timedelta(hours=rng.randrange(99)), 10**6 + i, 1.5, 1))
    rng.shuffle(data)
    return spark.createDataFrame(data, "dataset string, case_id string, activity string, ts timestamp, in_order long, value double, k long")


def test_hot_case_is_ordered_like_any_other(spark):
    log = skewed_log(spark)
    none = find_hot_cases(log, 10**6)
    hot = find_hot_cases(log, 100)
    assert none.frame is None and hot.events == 1500
    extra = {"last": F.max_by("elapsed_time", "seq"), "first_k": F.min(F.when(F.col("k") > 1, F.col("seq")))}
    assert rows(order_events(log, hot, extra)) == rows(order_events(log, none, extra))
    assert rows(add_remaining_time(log, hot=hot)) == rows(add_remaining_time(log, hot=none))
    top = {"top": F.max("value")}
    assert rows(with_case_columns(log, top, hot)) == rows(with_case_columns(log, top, none))


def test_hot_precomputed_times(spark):
    log = skewed_log(spark).withColumns({"elapsed_time": F.col("value") - 2, "interval_time": F.lit(None).cast("double")})
    assert rows(order_events(log, find_hot_cases(log, 100))) == rows(order_events(log, find_hot_cases(log, 10**6)))


def test_stories_and_prompts_across_blocks(spark, monkeypatch):
    log = skewed_log(spark, 700)
    whole_stories = rows(segments.segment_stories(log, NARRATIVES, segments.Windows(max_windows=-1)))
    whole_examples = rows(prefixes.all_examples(log, None, NARRATIVES))
    hot = find_hot_cases(log, 100)
    for module in (blocks, segments, prefixes):
        monkeypatch.setattr(module, "BLOCK_EVENTS", 1)  # the smallest allowed block: 64 and 40
    assert segments.Windows().block == 64
    assert rows(segments.segment_stories(log, NARRATIVES, segments.Windows(max_windows=-1), hot=hot)) == whole_stories
    assert rows(prefixes.all_examples(log, None, NARRATIVES, hot=hot)) == whole_examples
    cases = case_table(order_events(log), label=None).withColumn("split", F.lit("train"))
    plan = prefixes.plan_prefixes(cases, cap=50)
    planned = rows(prefixes.planned_examples(log, plan, NARRATIVES, hot=hot).drop("split", "variant_id", "case_order"))
    assert set(planned) <= set(whole_examples) and len(planned) == plan.count()


def windows_by_listing(n, m):
    found = [(f"window_{s}", a, a + s) for s in (32, 24, 16) for a in sorted({*range(0, n - s + 1, s // 2), n - s})]
    if m >= 0 and len(found) > m:
        step = (len(found) - 1) / (m - 1)
        found = [found[len(found) - 1 if i == m - 1 else int(i * step)] for i in range(m)]
    return [(*w, i) for i, w in enumerate(found)]


@pytest.mark.parametrize("m", [-1, 2, 20])
def test_windows_of_long_cases(spark, m):
    sizes = [65, 100, 257, 777, 3000]
    df = spark.createDataFrame([("d", str(n), n) for n in sizes], "dataset string, case_id string, trace_len long")
    w = segments.Windows(max_windows=m)
    placed = df.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("trace_len") - 1) / w.block))))
    got = defaultdict(list)
    for r in segments.with_segments(placed, w).select("trace_len", F.inline("segments")).orderBy("slice_id").collect():
        got[r["trace_len"]].append((r["slice_type"], r["slice_start"], r["slice_end"], r["slice_id"]))
    for n in sizes:
        assert got[n] == windows_by_listing(n, m)


def test_variant_id_means_same_variant(spark):
    log = item_log(spark, SF)
    ordered = order_events(log)
    ids = case_table(ordered, 1, label=None).withColumnRenamed("trace_len", "ids_len").join(variant_texts(ordered).drop("trace_len"), ["dataset", "case_id"])
    n = ids.agg(F.count_distinct("variant_id"), F.count_distinct("variant"), F.count_distinct("variant_id", "variant")).first()
    assert n[0] == n[1] == n[2] > 10
    short = variant_texts(ordered, block=2).join(ids.withColumnRenamed("variant", "text"), ["dataset", "case_id"])
    assert short.where((F.col("variant") != F.col("text")) | (F.col("trace_len") != F.col("ids_len"))).count() == 0


def test_rank_by_hash(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3 % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    for keys in ([], ["g"]):
        got = {r["id"]: (r["hash_rank"], r["group_size"]) for r in rank_by_hash(df, keys, "h").collect()}
        groups = defaultdict(list)
        for r in df.collect():
            groups[r["g"] if keys else 0].append((r["h"], r["id"]))
        for members in groups.values():
            for place, (_, i) in enumerate(sorted(members), 1):
                assert got[i] == (place, len(members))


@pytest.mark.parametrize("k", [1, 5, 1500])
def test_top_per_group(spark, k):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 2 + F.col("id") % 3).alias("g"))
    got = {(r["g"], r["id"], r["rank_in_group"]) for r in top_per_group(df, ["g"], [F.desc("id")], k).collect()}
    want = set()
    for g in range(4):
        members = sorted((i for i in range(5000) if i % 2 + i % 3 == g), reverse=True)[:k]
        want |= {(g, i, r) for r, i in enumerate(members, 1)}
    assert got == want


def test_small_ranks_are_pruned_before_the_shuffle(spark):
    third = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string")
    docs = spark.range(5000).select(F.col("id"), third.alias("text"), (F.col("id") % 2).alias("dataset"))
    for df in (sampling.dedup_text(docs, [F.col("id")]), top_per_group(docs, ["dataset"], [F.col("id")], 900)):
        plan = df._jdf.queryExecution().executedPlan().treeString()
        assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("n, k", [(50, -1), (50, 4), (50, 1), (333, 20), (10**6, 3), (10**6, -1), (1200, -1)])
def test_balanced_sample_is_a_round_robin(spark, n, k):
    rng = random.Random(n + k)
    data = [("a", rng.choice("xyzuvw") if i % 3 else "x", i) for i in range(1500)] + [("b", "q", i) for i in range(30)]
    df = spark.createDataFrame(data, "dataset string, member string, i long")
    got = sampling.balanced_sample(
        df, n, k, "member", [F.col("i")], F.md5(F.concat_ws("|", "dataset", "member")))
    want = set()
    for dataset in "ab":
        rows_ = [r for r in data if r[0] == dataset]
        pools = defaultdict(list)
        for r in sorted(rows_, key=lambda r: r[2]):
            pools[r[1]].append(r)
        if k > 0:
            pools = {m: p[:k] for m, p in pools.items()}
        if len(rows_) <= n:
            want |= {r for p in pools.values() for r in p}
            continue
        order = sorted(pools, key=lambda m: md5(f"{dataset}|{m}"))
        left, round_ = n, 0
        while left and any(len(p) > round_ for p in pools.values()):
            for m in order:
                if left and len(pools[m]) > round_:
                    want.add(pools[m][round_])
                    left -= 1
            round_ += 1
    assert set(map(tuple, got.collect())) == want


def test_results_do_not_depend_on_partitions_or_row_order(spark):
    log = user_log(spark, SF)
    shuffled = log.orderBy(F.rand(3)).repartition(7)
    before = rows(segments.segment_stories(log, NARRATIVES))
    assert rows(segments.segment_stories(shuffled, NARRATIVES)) == before
    cases, other = (case_table(order_events(x), label=None) for x in (log, shuffled))
    assert rows(prefixes.plan_prefixes(cases)) == rows(prefixes.plan_prefixes(other))
    assert rows(sampling.split_variant_stratified(cases, 0.3, 5)) == rows(sampling.split_variant_stratified(other, 0.3, 5))


def test_one_shuffle_on_the_case(spark):
    log = item_log(spark, SF)
    hot = find_hot_cases(log)
    for df in (order_events(log, hot), segments.segment_stories(log, NARRATIVES, hot=hot),
               prefixes.all_examples(log, None, NARRATIVES, hot=hot)):
        plan = df._jdf.queryExecution().executedPlan().treeString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_caps_hold_and_full_dataset_is_split(spark):
    cases = case_table(order_events(item_log(spark, SF)), label=None)
    split = sampling.split_variant_stratified(sampling.cap_cases(cases, 300, 1), 0.1, 1)
    assert split.count() == 300 == split.select("case_id").distinct().count()
    plan = prefixes.cap_prefixes(prefixes.plan_prefixes(split), 200, 1, 0.1)
    got = {r["split"]: r["count"] for r in plan.groupBy("split").count().collect()}
    assert got["train"] == 200 and got["validation"] <= 20
    assert plan.where("prefix_len < 2 or prefix_len >= trace_len").count() == 0


def test_borders_by_hash(spark, monkeypatch):
    from tracewright.operators import sampling

    monkeypatch.setattr(sampling, "_BORDER_ROWS", 3)
    df = spark.range(2000).withColumn("text", F.lit("long text"))
    ranked = sorted((hashlib.md5(f"7|sample|{i}".encode()).hexdigest(), i) for i in range(2000))
    for n in (0, 1, 2, 999, 1999, 2000, 5000):
        got = sampling.random_rows(df, n, 7, ["id"])
        assert {r["id"] for r in got.collect()} == {i for _, i in ranked[:n]}
        assert "Exchange" not in got._jdf.queryExecution().toString()
    held = sampling.holdout_split(df, 0.013, 7, ["id"])
    assert held.where("split = 'validation'").count() == 26
    assert "Exchange" not in held._jdf.queryExecution().toString()
    assert sampling.random_rows(df.limit(0), 5, 7, ["id"]).count() == 0


def test_rows_of_one_key_are_divided(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_BORDER_ROWS", 50)
    df = spark.range(3_000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    for n in (400, 2_999):
        assert sampling.random_rows(df, n, 7, ["k"]).count() == n
    hot = spark.range(2_000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
    some = [sorted(r.v for r in sampling.random_rows(x, 700, 7, ["k"]).collect()) for x in (hot, hot.repartition(5))]
    assert len(some[0]) == 700 and some[0] == some[1]
    copies = spark.range(500).select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    assert sampling.random_rows(copies, 100, 7, ["k"]).count() in (0, 500)


def test_borders_of_many_groups(spark):
    df = spark.range(6_000).select((F.col("id") % 7).alias("g"), F.col("id").alias("m"), F.md5((F.col("id") % 1_500).cast("string")).alias("x"))
    df = df.withColumn("wanted", 100 * F.col("g") + 1)
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.x, r.m)):
        want.setdefault(r.g, []).append((r.x, r.m))
    got = {r.g: tuple(r._border) for r in sampling.group_borders(df, ["g"], "wanted", "x", "m", digits=(1, 2)).collect()}
    assert got == {g: rows_[100 * g] for g, rows_ in want.items()}
    plan = sampling.group_borders(df.withColumn("text", F.lit("long")), ["g"], "wanted", "x", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "long" not in plan


def test_sketched_quantiles(spark):
    """Within a percent of the exact ranks for one hot group over many partitions; exact for small groups; nulls left out."""
    text = F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.repeat(F.lit("w "), ((F.col("id") * 7919) % 1_009).cast("int")))
    df = spark.range(60_000, numPartitions=24).select(F.when(F.col("id") % 600 == 1, "small").otherwise("hot").alias("g"), text.alias("text"))
    got = {(r.g, r.rank): r for r in corpus.length_quantiles(df, ["g"]).collect()}
    lens = {}
    for r in df.where("text IS NOT NULL").select("g", F.size(corpus.word_tokens(F.col("text"))).alias("n")).collect():
        lens.setdefault(r.g, []).append(r.n)
    assert len(got) == 8
    for (g, q), r in got.items():
        off = 0.01 if g == "hot" else 1 / len(lens[g])
        assert r.n_rows == len(lens[g])
        assert sum(n < r.length for n in lens[g]) / len(lens[g]) - off <= q <= sum(n <= r.length for n in lens[g]) / len(lens[g]) + off
    assert corpus.length_quantiles(df.limit(0), ["g"]).count() == 0
