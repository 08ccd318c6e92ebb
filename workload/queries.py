"""One query per operator over the given tables, with its SQL where SQL can say it."""

from __future__ import annotations

import re

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import prompts as P
from tracewright.functions.answers import (
    clean_answer, parse_categorical, parse_days, prepare_candidates,
)
from tracewright.functions.narrative import with_event_sentences
from tracewright.functions.text import hash_order, json_list, value_text
from tracewright.operators import canonicalize as CN
from tracewright.operators import corpus as CP
from tracewright.operators import metrics as M
from tracewright.operators import outcomes as OUT
from tracewright.operators import prefixes as PX
from tracewright.operators import sampling as S
from tracewright import presets
from tracewright.operators.cases import case_table, variant_texts
from tracewright.operators.instructions import (
    eval_prompts, evaluation_tasks, sample_counts, sample_meta, shared_universe,
)
from tracewright.operators.ordering import add_remaining_time, find_hot_cases, order_events
from tracewright.operators.scoring import majority_baseline, predict_in_batches, repeat_last_activity, score
from tracewright.operators.segments import case_stories, segment_cases, segment_stories, tell_segments
from tracewright.plans.flows import (
    EvaluationSettings, InstructionSettings, evaluate, evaluation_prompts, instruction_data, labelled_cases,
    story_corpus,
)
from tracewright.plans.preparation import canonicalize_logs, label_logs, remaining_time_logs
from tracewright.scale import BROADCAST_BYTES, broadcast_if_small, checkpoint, fresh_folder
from tracewright.sources.readers import read_corpus, read_csv, read_named, read_xes
from tracewright.sources.writers import write_case_splits, write_corpus, write_predictions, write_report, write_samples
from tracewright.schema import (
    CASE, DATASET_ALIASES, dataset_from_path, event_log, find_keyword_column, first_dataset_in_path, normalize_dataset_name,
    parse_names, unparsed_timestamps,
)
from workload import oracles as Q
from workload.logs import NARRATIVES, all_logs, chat_log, item_log, order_log, table, user_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = Q.SEED


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def days(name: str):
    return F.round(name, 6).alias(name)


# ---- activity names --------------------------------------------------------

E_MAP = [("events", "click", "Click item"), ("events", "error", "hit error"),
         ("events", "purchase", "buy item"), ("events", "view", "view page")]
O_MAP = [("orders", "1-URGENT", "urgent order"), ("orders", "2-HIGH", "high order"),
         ("orders", "3-MEDIUM", "medium order"), ("orders", "5-LOW", "low order"),
         ("orders", "4-NOT SPECIFIED", "plain order")]
MAP_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{d}', '{r}', '{c.lower()}')" for d, r, c in E_MAP + O_MAP
) + ") m(dataset, raw, canonical)"


def activity_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(E_MAP + O_MAP, "dataset string, raw string, canonical string")


@register(Q.query(
    f"""SELECT l.dataset, coalesce(m.canonical, lower(l.activity)) AS activity, count(*) AS n_events,
 count(DISTINCT case_id) AS n_cases FROM logs l LEFT JOIN m ON m.dataset = l.dataset AND m.raw = l.activity GROUP BY 1, 2""",
    logs=Q.ALL, m=MAP_SQL))
def canonicalize_activity(spark, sf):
    out = CN.canonicalize(all_logs(spark, sf), activity_map(spark))
    return out.groupBy("dataset", "activity").agg(
        F.count("*").alias("n_events"), F.count_distinct("case_id").alias("n_cases"))


@register(Q.query(
    """SELECT l.dataset, l.activity, count(*) AS n_events FROM logs l
 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.dataset = l.dataset AND m.raw = l.activity) GROUP BY 1, 2""",
    logs=Q.ALL, m=MAP_SQL))
def unknown_activities(spark, sf):
    return CN.unknown_activities(all_logs(spark, sf), activity_map(spark))


@register(Q.query(
    """SELECT l.dataset, count(DISTINCT l.activity) AS raw_activity_types,
 count(DISTINCT coalesce(m.canonical, lower(l.activity))) AS mapped_activity_types,
 count(DISTINCT l.activity) = count(DISTINCT coalesce(m.canonical, lower(l.activity))) AS one_to_one
 FROM logs l LEFT JOIN m ON m.dataset = l.dataset AND m.raw = l.activity GROUP BY 1""",
    logs=Q.ALL, m=MAP_SQL))
def mapping_summary(spark, sf):
    return CN.mapping_summary(all_logs(spark, sf), activity_map(spark))


def _names_as_map(log: DataFrame) -> DataFrame:
    """A map read from the data: each name to its first word, so some collide."""
    return log.select(
        "dataset", F.col("activity").alias("raw"),
        F.substring("activity", 3, 1).alias("canonical"),
    ).distinct()


@register(Q.query(
    """SELECT dataset, 'name with several keys' AS problem, lower(substr(activity, 3, 1)) AS name,
 string_agg(DISTINCT activity, ', ' ORDER BY activity) AS others FROM logs GROUP BY 1, 3 HAVING count(DISTINCT activity) > 1""",
    logs=Q.ALL))
def mapping_bijection(spark, sf):
    return CN.check_activity_map(_names_as_map(all_logs(spark, sf))).withColumn(
        "others", F.array_join("others", ", "))


@register(Q.query(
    """SELECT "column", CAST(count(hit) = count(*) AS INT) AS all_covered,
 CAST("column" = 'o_orderpriority' AS INT) AS preferred, count(hit) AS overlap, count(*) AS n_values
 FROM (SELECT DISTINCT v."column", v.v, m.raw AS hit FROM vals v LEFT JOIN m ON m.raw = v.v)
 GROUP BY 1 HAVING count(hit) > 0""",
    vals="""SELECT DISTINCT 'o_orderpriority' AS "column", o_orderpriority AS v FROM orders
 UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders
 UNION ALL SELECT DISTINCT 'note', CASE WHEN o_orderkey % 3 = 0 THEN '2-HIGH' ELSE o_orderstatus END FROM orders""",
    m="SELECT raw FROM (" + MAP_SQL + ") WHERE dataset = 'orders'"))
def activity_column_ranking(spark, sf):
    raw = table(spark, sf, "orders").withColumn("note", F.when(
        F.col("o_orderkey") % 3 == 0, "2-HIGH").otherwise(F.col("o_orderstatus")))
    return CN.rank_activity_columns(raw, activity_map(spark), "orders", ["o_orderpriority"])


@register(Q.query(
    "SELECT dataset, string_agg(DISTINCT activity, ', ' ORDER BY activity) AS activities FROM logs GROUP BY 1",
    logs=Q.ALL))
def activity_inventory(spark, sf):
    return CN.activity_inventory(all_logs(spark, sf)).withColumn(
        "activities", F.array_join("activities", ", "))


HINTS = {"dot-com": ["example.com", "com/en"], "dot-net": ["example.net"], "french": ["/fr/", "example.com/fr"],
         "any": ["example"], "mobile": ["//m.", "https://m"]}


def _hint_values() -> str:
    rows = [(d, w, i) for i, (d, ws) in enumerate(HINTS.items()) for w in ws]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{w}', {i})" for d, w, i in rows) + ") v(dataset, word, rank)"


@register(Q.query(
    """SELECT by_hint, first_alias, count(*) AS n_pages FROM (SELECT url,
 (SELECT arg_max(dataset, (length(t), dataset)) FROM (SELECT dataset, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS t FROM v)
   WHERE contains(regexp_replace(lower(url), '[^a-z0-9]', '', 'g'), t)) AS by_hint,
 (SELECT arg_min(dataset, rank) FROM v WHERE contains(lower(url), word)) AS first_alias FROM pages) GROUP BY 1, 2""",
    v=_hint_values()))
def dataset_from_url(spark, sf):
    return table(spark, sf, "pages").select(
        dataset_from_path(F.col("url"), HINTS).alias("by_hint"),
        first_dataset_in_path(F.col("url"), HINTS).alias("first_alias"),
    ).groupBy("by_hint", "first_alias").agg(F.count("*").alias("n_pages"))


@register(
    """SELECT source, CASE WHEN source IN ('src0', 'src3') THEN 'Source-zero' WHEN source = 'src1' THEN 'src1-log' ELSE source END AS dataset,
 count(*) AS n_docs FROM documents GROUP BY 1, 2""")
def dataset_name_of_source(spark, sf):
    names = normalize_dataset_name(F.col("source"), {"Source-zero": ["SRC_0", "src 3"], "src1-log": ["src-1"]})
    return table(spark, sf, "documents").select("source", names.alias("dataset")).groupBy(
        "source", "dataset").agg(F.count("*").alias("n_docs"))


# ---- outcomes --------------------------------------------------------------

def labels_sql(log: str, value: str, **more: str) -> str:
    return Q.query(f"SELECT dataset, case_id, CAST({value} AS INT) AS value FROM l GROUP BY 1, 2", l=log, **more)


LAST = "lower(arg_max(activity, (ts, in_order)))"


@register(labels_sql(Q.E, f"{LAST} IN ('purchase', 'signup')"))
def label_ends_with(spark, sf):
    return OUT.case_outcomes(user_log(spark, sf), {
        "events": OUT.EndsWith("it ends with a purchase or signup", ["Purchase", "signup"])})


@register(labels_sql(Q.L, "bool_or(activity = 'R/F')"))
def label_contains(spark, sf):
    return OUT.case_outcomes(item_log(spark, sf), {"lineitem": OUT.Contains("r/f occurs", ["r/f"])})


@register(labels_sql(Q.L, "NOT bool_or(activity IN ('N/O', 'A/O'))"))
def label_contains_none(spark, sf):
    return OUT.case_outcomes(item_log(spark, sf), {
        "lineitem": OUT.ContainsNone("neither n/o nor a/o occurs", ["n/o", "a/o"])})


@register(labels_sql(Q.O, "bool_or(activity = '1-URGENT') AND NOT bool_or(activity = '5-LOW')"))
def label_contains_without(spark, sf):
    return OUT.case_outcomes(order_log(spark, sf), {
        "orders": OUT.ContainsWithout("urgent without low", ["1-urgent"], ["5-low"])})


@register(labels_sql(Q.O, f"""(bool_or(coalesce(is_closed, false)) OR bool_or(activity = '3-MEDIUM') OR {LAST} = '2-high')
 AND NOT bool_or(activity = '5-LOW')"""))
def label_closed_not_reopened(spark, sf):
    return OUT.case_outcomes(order_log(spark, sf), {"orders": OUT.ClosedNotReopened(
        "closed and never low", flag="is_closed", last_in=["2-high"], any_of=["3-medium"], reopened=["5-low"])})


GAP_SQL = Q.query(
    """SELECT l.dataset, l.case_id, CAST(CASE WHEN b.back IS NULL THEN true
 ELSE coalesce((epoch_us(b.back.ts) - epoch_us(max(l.ts) FILTER (WHERE activity = 'purchase' AND (l.ts, l.in_order) < (b.back.ts, b.back.o)))) / 1e6 / 864e2 > 0.5, false) END AS INT) AS value
 FROM l LEFT JOIN b ON b.case_id = l.case_id GROUP BY l.dataset, l.case_id, b.back""",
    l=Q.E, b="SELECT case_id, min({'ts': ts, 'o': in_order}) AS back FROM l WHERE activity = 'error' GROUP BY 1")


@register(GAP_SQL)
def label_return_gap(spark, sf):
    return OUT.case_outcomes(user_log(spark, sf), {"events": OUT.NoReturnWithin(
        "no error within half a day after a purchase", release=["purchase"], returned=["error"], days=0.5)})


@register(Q.query(
    """SELECT dataset, case_id, CAST(NOT bool_or(activity = 'N/O') AND
 coalesce(max(l_extendedprice) >= max(o_totalprice), bool_or(activity = 'R/F')) AS INT) AS value
 FROM l LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice END AS o_totalprice FROM orders) o
 ON o.o_orderkey = CAST(l.case_id AS BIGINT) GROUP BY 1, 2""",
    l=Q.L))
def label_amount_covered(spark, sf):
    known = F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_totalprice"))
    totals = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), known.alias("amount"))
    log = item_log(spark, sf).join(totals, "case_id", "left")
    return OUT.case_outcomes(log, {"lineitem": OUT.AmountCovered(
        "paid in full and never n/o", amount="amount", paid="l_extendedprice",
        payment=["r/f"], collected=["n/o"])})


@register(labels_sql(Q.O, """coalesce(arg_min(in_time, in_order) FILTER (WHERE in_time IS NOT NULL),
 bool_or(activity = '2-HIGH') AND (count(ts) < 2 OR (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 864e2 <= 1800))"""))
def label_flag_or_duration(spark, sf):
    return OUT.case_outcomes(order_log(spark, sf), {"orders": OUT.FlagOrDuration(
        "in time", flag="in_time", completed=["2-high"], days=1800)})


@register(labels_sql(Q.L, "NOT bool_or(over_discount > 0)"))
def label_numeric_positive(spark, sf):
    return OUT.case_outcomes(item_log(spark, sf), {"lineitem": OUT.NumericPositive(
        "no large discount", column="over_discount")})


@register(labels_sql(Q.O, "NOT bool_or(contains(activity, 'LOW') OR contains(activity, 'NOT'))"))
def label_keyword(spark, sf):
    return OUT.case_outcomes(order_log(spark, sf), {"orders": OUT.NumericPositive(
        "no low and no unspecified order", keywords=["low", "not"])})


LOOKUP_SQL = Q.query(
    """SELECT l.dataset, l.case_id, CAST(any_value(o.v) AS INT) AS value FROM l
 LEFT JOIN (SELECT case_id, bool_or(activity = '1-URGENT') AS v FROM o GROUP BY 1) o ON o.case_id = l.case_id
 GROUP BY 1, 2""", l=Q.L, o=Q.O)


@register(LOOKUP_SQL)
def label_lookup(spark, sf):
    urgent = OUT.case_outcomes(order_log(spark, sf), {"orders": OUT.Contains("urgent", ["1-urgent"])})
    return OUT.case_outcomes(item_log(spark, sf), {"lineitem": OUT.Lookup("urgent in orders", labels=urgent)})


def view_rules() -> dict[str, OUT.Rule]:
    return {
        "events": OUT.EndsWith("it ends with a purchase or signup", ["purchase", "signup"]),
        "lineitem": OUT.Contains("an item is returned and final", ["r/f"]),
        "orders": OUT.ContainsWithout("urgent without low", ["1-urgent"], ["5-low"]),
    }


RULE_TEXTS = {d: r.text for d, r in view_rules().items()}
ALL_LABELS = f"""SELECT dataset, case_id, CASE WHEN CASE dataset
 WHEN 'events' THEN {LAST} IN ('purchase', 'signup')
 WHEN 'lineitem' THEN bool_or(activity = 'R/F')
 ELSE bool_or(activity = '1-URGENT') AND NOT bool_or(activity = '5-LOW') END THEN 'success' ELSE 'failure' END AS label,
 count(*) AS n FROM logs GROUP BY 1, 2"""


@register(Q.query(
    """SELECT l.dataset, l.activity, c.label, count(*) AS n_events FROM logs l
 JOIN c ON c.dataset = l.dataset AND c.case_id = l.case_id GROUP BY 1, 2, 3""",
    logs=Q.ALL, c=ALL_LABELS))
def label_events(spark, sf):
    out = OUT.label_outcomes(all_logs(spark, sf), view_rules())
    return out.groupBy("dataset", "activity", "label").agg(F.count("*").alias("n_events"))


RULE_CASE = "CASE dataset " + " ".join(
    f"WHEN '{d}' THEN 'label=''success'' if {t}; otherwise label=''failure''.'" for d, t in RULE_TEXTS.items()) + " END"


@register(Q.query(
    f"""SELECT dataset, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_cases, count_if(label = 'success') AS n_positive_cases,
 count_if(label = 'failure') AS n_negative_cases, count_if(label IS NULL) AS n_unlabeled_cases,
 'success' AS positive_label, 'failure' AS negative_label, {RULE_CASE} AS rule FROM c GROUP BY 1""",
    logs=Q.ALL, c=ALL_LABELS))
def label_summary(spark, sf):
    return OUT.label_summary(all_logs(spark, sf), view_rules())


@register(Q.query(
    """SELECT dataset, case_id, problem FROM (SELECT dataset, case_id,
 CASE WHEN bool_or(activity IN ('4-NOT SPECIFIED')) THEN 'unknown label'
  WHEN count(w) = 0 THEN 'no label' WHEN min(w) <> max(w) THEN 'several labels' END AS problem
 FROM (SELECT *, CASE WHEN activity IN ('1-URGENT', '2-HIGH') THEN 'success' WHEN activity = '3-MEDIUM' THEN 'failure' END AS w FROM l)
 GROUP BY 1, 2) WHERE problem IS NOT NULL""", l=Q.O))
def label_conflicts(spark, sf):
    spelled = F.when(F.col("activity").isin("1-URGENT", "2-HIGH"), " Succeed").when(
        F.col("activity") == "3-MEDIUM", "FALSE").when(F.col("activity") == "4-NOT SPECIFIED", "perhaps")
    return OUT.check_labels(order_log(spark, sf).withColumn("label", spelled))


# ---- time ------------------------------------------------------------------

def remaining_sql(log: str, seconds: int, digits: int | None) -> str:
    left = f"greatest((epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)) / 1e6 / {seconds}::DOUBLE, 0)"
    left = f"round({left}, 6)" if digits is None else f"round_even({left}, {digits})"
    return f"SELECT case_id, in_order, {left} AS remaining_time FROM ({log})"


@register(remaining_sql(Q.E, 86400, 0))
def remaining_time_days(spark, sf):
    return add_remaining_time(user_log(spark, sf)).select("case_id", "in_order", "remaining_time")


@register(remaining_sql(Q.L, 3600, None))
def remaining_time_hours(spark, sf):
    out = add_remaining_time(item_log(spark, sf), "hours", None)
    return out.select("case_id", "in_order", days("remaining_time"))


@register(f"""SELECT case_id, in_order, seq, n AS trace_len, round(elapsed_time, 6) AS elapsed_time,
 round(interval_time, 6) AS interval_time FROM ({Q.ordered(Q.L)})""")
def time_features(spark, sf):
    return order_events(item_log(spark, sf)).select(
        "case_id", "in_order", "seq", "trace_len", days("elapsed_time"), days("interval_time"))


@register(f"""SELECT case_id, in_order, row_number() OVER (PARTITION BY case_id ORDER BY in_order) - 1 AS seq,
 greatest(coalesce(elapsed_time, 0), 0) AS elapsed_time, greatest(coalesce(interval_time, 0), 0) AS interval_time FROM ({Q.C})""")
def precomputed_time_features(spark, sf):
    return order_events(chat_log(spark, sf)).select(
        "case_id", "in_order", "seq", "elapsed_time", "interval_time")


# ---- text ------------------------------------------------------------------

@register(Q.query(
    f"""SELECT case_id, CAST(arg_min(k, seq) AS VARCHAR) AS first_k, {Q.value_text('arg_min(value, seq)')} AS first_value,
 {Q.value_text('arg_min(value, seq) FILTER (WHERE value > 100)')} AS first_large FROM o GROUP BY 1""",
    o=Q.ordered(Q.E)))
def case_attributes(spark, sf):
    log = user_log(spark, sf).withColumn("large", F.when(F.col("value") > 100, F.col("value")))
    ordered = order_events(log)
    first = {n: F.min_by(value_text(log, c), F.when(F.col(c).isNotNull(), F.col("seq")))
             for n, c in (("first_k", "k"), ("first_value", "value"), ("first_large", "large"))}
    return ordered.groupBy("case_id").agg(*[c.alias(n) for n, c in first.items()])


@register(f"SELECT case_id, seq, head, mid FROM ({Q.told('L')})")
def event_sentences_told(spark, sf):
    told = with_event_sentences(order_events(item_log(spark, sf)), NARRATIVES)
    return told.select("case_id", "seq", "head", "mid")


def whole_story_sql(log: str) -> str:
    return Q.query(
        f"""SELECT t.case_id, any_value(i.sentence) || ' ' || string_agg(CASE WHEN seq = 0 THEN head ELSE mid END, ' ' ORDER BY seq) AS text
 FROM told t JOIN intro i ON i.case_id = t.case_id GROUP BY 1""",
        **{k: v for k, v in Q.stories(log).items() if k in ("told", "sizes", "intro")})


@register(whole_story_sql("E"))
def case_story(spark, sf):
    return case_stories(user_log(spark, sf), NARRATIVES).select("case_id", "text")


@register(whole_story_sql("L"))
def case_story_items(spark, sf):
    return case_stories(item_log(spark, sf), NARRATIVES).select("case_id", "text")


# ---- segments --------------------------------------------------------------

SEGMENT = "case_id, slice_id, slice_type, slice_start, slice_end, n_events"


@register(Q.query(
    f"SELECT {SEGMENT} FROM segs",
    sizes=f"SELECT dataset, case_id, count(*) AS n FROM ({Q.E}) GROUP BY 1, 2", segs=Q.segments("sizes")))
def segments(spark, sf):
    return segment_cases(order_events(user_log(spark, sf))).select(*SEGMENT.split(", "))


@register(Q.query(
    f"SELECT {SEGMENT}, variant_key, text FROM stories", **Q.stories("E")))
def segment_texts(spark, sf):
    return segment_stories(user_log(spark, sf), NARRATIVES).select(
        *SEGMENT.split(", "), "variant_key", "text")


def variants_sql() -> str:
    names = "string_agg(activity, ' || ' ORDER BY {o})"
    return Q.query(
        """SELECT dataset, variant, any_value(n) AS trace_len, count(*) AS n_cases FROM v GROUP BY 1, 2""",
        l=Q.L, o=Q.O, c=Q.C,
        v=f"""SELECT dataset, case_id, {names.format(o='ts, in_order')} AS variant, count(*) AS n FROM l GROUP BY 1, 2
 UNION ALL SELECT dataset, case_id, {names.format(o='ts, in_order')}, count(*) FROM o GROUP BY 1, 2
 UNION ALL SELECT dataset, case_id, {names.format(o='in_order')}, count(*) FROM c GROUP BY 1, 2""")


@register(variants_sql())
def variant_counts(spark, sf):
    texts = None
    for log in (item_log, order_log, chat_log):
        one = variant_texts(order_events(log(spark, sf)))
        texts = one if texts is None else texts.unionByName(one)
    return texts.groupBy("dataset", "variant").agg(
        F.any_value("trace_len").alias("trace_len"), F.count("*").alias("n_cases"))


# ---- sampling --------------------------------------------------------------

@register("""SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS r
 FROM documents) WHERE r = 1""")
def dedup_texts(spark, sf):
    docs = table(spark, sf, "documents")
    return S.dedup_text(docs, [F.col("doc_id")], keys=["lang"]).select("doc_id", "source", "n_chars")


SEG_HASH = Q.h("segment", "dataset", "case_id", "CAST(slice_id AS VARCHAR)")
PREFER = f"slice_type = 'full' DESC, n_events DESC, slice_start, slice_end DESC, {SEG_HASH}, case_id, slice_id"
SEG_KEY = "dataset, case_id, slice_id, n_events, variant_key, text"


@register(Q.query(
    f"""SELECT {SEG_KEY} FROM (SELECT *, row_number() OVER (PARTITION BY dataset, variant_key ORDER BY {PREFER}) AS r FROM stories)
 WHERE r <= 3""", **Q.stories("L")))
def variant_top_rows(spark, sf):
    stories = segment_stories(item_log(spark, sf), NARRATIVES)
    return S.variant_topk(stories, 3, S.segment_preference(SEED)).select(*SEG_KEY.split(", "))


@register(Q.query(
    f"SELECT {SEG_KEY} FROM b", **Q.stories("L"),
    b=Q.balanced("stories", "variant_key", PREFER, Q.h("round", "dataset", "variant_key"), 5000, 64)))
def variant_balanced_sample(spark, sf):
    log, hot = item_log(spark, sf), items_hot(spark, sf)
    segments = checkpoint(segment_stories(log, NARRATIVES, hot=hot, story=False))
    chosen = checkpoint(S.balanced_sample(
        segments, 5000, 64, "variant_key", S.segment_preference(SEED),
        hash_order(SEED, "round", F.col("dataset"), F.col("variant_key")),
    ))
    return tell_segments(log, chosen, NARRATIVES, hot=hot).select(*SEG_KEY.split(", "))


@register(Q.query(
    """SELECT CAST(min(n) AS BIGINT) AS min_cap, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_cap, 8000 AS fixed_cap
 FROM (SELECT dataset, count(DISTINCT case_id) AS n FROM logs GROUP BY 1)""", logs=Q.ALL))
def target_caps(spark, sf):
    counts = all_logs(spark, sf).groupBy("dataset").agg(F.count_distinct("case_id").alias("n"))
    caps = [(S.target_cap(counts, "min"), S.target_cap(counts, "median"), S.target_cap(counts, target=8000))]
    return spark.createDataFrame(caps, "min_cap long, median_cap long, fixed_cap long")


def corpus_sql() -> str:
    ctes: dict[str, str] = {}
    for log in ("E", "L", "O"):
        part = Q.stories(log)
        names = {n: f"{n}_{log}" for n in part}
        for n, s in part.items():
            for other, new in names.items():
                s = _rename(s, other, new)
            ctes[names[n]] = s
    ctes["stories"] = " UNION ALL ".join(f"SELECT * FROM stories_{x}" for x in ("E", "L", "O"))
    ctes["uniq"] = """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY dataset, text ORDER BY case_order, case_id, slice_id) AS r
 FROM stories) WHERE r = 1"""
    return Q.query("SELECT dataset, text FROM uniq", **ctes)


def _rename(sql: str, old: str, new: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {new}", sql)


@register(corpus_sql())
def story_corpus_all(spark, sf):
    logs = [f(spark, sf) for f in (user_log, item_log, order_log)]
    union = logs[0].unionByName(logs[1], allowMissingColumns=True).unionByName(
        logs[2], allowMissingColumns=True)
    return story_corpus(union, NARRATIVES, seed=SEED).select("dataset", "text")


# ---- cases and splits ------------------------------------------------------

def labelled_items(spark: SparkSession, sf: str) -> DataFrame:
    return OUT.label_outcomes(item_log(spark, sf), {"lineitem": view_rules()["lineitem"]})


def item_cases(spark: SparkSession, sf: str, hot=None) -> DataFrame:
    """Labelled cases of L, narrow rows that are frozen because several steps read them."""
    return labelled_cases(item_log(spark, sf), item_labels(spark, sf), hot or items_hot(spark, sf))


def item_labels(spark: SparkSession, sf: str) -> DataFrame:
    return OUT.case_labels(item_log(spark, sf), {"lineitem": view_rules()["lineitem"]})


def items_hot(spark: SparkSession, sf: str):
    return find_hot_cases(item_log(spark, sf))


@register(Q.query(
    "SELECT case_id, trace_len, variant_id, label FROM cases", **Q.cases("L")))
def case_records(spark, sf):
    cases = case_table(order_events(labelled_items(spark, sf), items_hot(spark, sf)))
    return cases.select("case_id", "trace_len", "variant_id", "label")


CAP_SQL = Q.balanced("cases", "variant_id", Q.h("case", "dataset", "case_id") + ", case_id",
                     Q.h("round", "dataset", "variant_id"), 1500, -1)


@register(Q.query("SELECT case_id, trace_len, label FROM b", **Q.cases("L"), b=CAP_SQL))
def case_cap(spark, sf):
    return S.cap_cases(item_cases(spark, sf), 1500, SEED).select("case_id", "trace_len", "label")


@register(Q.query("SELECT case_id, split FROM split_cases", **Q.cases("L"),
                  **Q.split("cases", "variant_id", 0.02, 5, "validation", "case-split")))
def split_variant(spark, sf):
    return S.split_variant_stratified(item_cases(spark, sf), 0.02, SEED).select("case_id", "split")


O_LABEL = ("CASE WHEN bool_or(activity = '1-URGENT') AND NOT bool_or(activity = '5-LOW') "
           "THEN 'success' ELSE 'failure' END")


@register(Q.query("SELECT case_id, label, split FROM split_cases", **Q.cases("O", O_LABEL),
                  **Q.split("cases", "label", 0.2, 2, "test", "label-split")))
def split_label(spark, sf):
    log = OUT.label_outcomes(order_log(spark, sf), {"orders": view_rules()["orders"]})
    cases = checkpoint(case_table(order_events(log, find_hot_cases(order_log(spark, sf)))))
    return S.split_label_stratified(cases, 0.2, SEED).select("case_id", "label", "split")


@register(Q.query(
    """SELECT s.split, l.activity, count(*) AS n_events, count(DISTINCT l.case_id) AS n_cases FROM l
 JOIN split_cases s ON s.case_id = l.case_id GROUP BY 1, 2""", l=Q.L, **Q.cases("L"),
    **Q.split("cases", "label", 0.2, 2, "test", "label-split")))
def split_events(spark, sf):
    parts = S.split_label_stratified(item_cases(spark, sf), 0.2, SEED)
    return item_log(spark, sf).join(parts.select(*CASE, "split"), CASE).groupBy(
        "split", "activity").agg(F.count("*").alias("n_events"), F.count_distinct("case_id").alias("n_cases"))


# ---- prefixes --------------------------------------------------------------

def order_cases(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoint(case_table(order_events(order_log(spark, sf)), label=None))


@register(Q.query("SELECT case_id, prefix_len FROM plan", **Q.cases("O"), **Q.plan("cases")))
def prefix_plan(spark, sf):
    return PX.plan_prefixes(order_cases(spark, sf), seed=SEED).select("case_id", "prefix_len")


@register(Q.query(
    "SELECT case_id, prefix_len FROM b", **Q.cases("O"), **Q.plan("cases"),
    b=Q.balanced("plan", "case_id", Q.h("plan", "dataset", "case_id", "CAST(prefix_len AS VARCHAR)") + ", prefix_len",
                 Q.h("plan-round", "dataset", "case_id"), 4000, -1)))
def prefix_cap(spark, sf):
    plan = PX.plan_prefixes(order_cases(spark, sf), seed=SEED).withColumn("split", F.lit("train"))
    return PX.cap_prefixes(plan, 4000, SEED).select("case_id", "prefix_len")


@register(Q.query(
    "SELECT dataset, CAST(sum(greatest(trace_len - 2, 0)) AS BIGINT) AS n_all, CAST((SELECT count(*) FROM plan) AS BIGINT) AS n_planned FROM cases GROUP BY 1",
    **Q.cases("O"), **Q.plan("cases")))
def prefix_counts(spark, sf):
    cases = order_cases(spark, sf)
    planned = PX.plan_prefixes(cases, seed=SEED).groupBy("dataset").agg(F.count("*").alias("n_planned"))
    every = cases.groupBy("dataset").agg(
        F.sum(F.greatest(F.col("trace_len") - 2, F.lit(0))).alias("n_all"))
    return every.join(planned, "dataset")


EX = ("case_id, prefix_len, trace_len, prefix_ratio, story_segment_start, story_n_events, "
      "input_story, next_activity, remaining_time_days")


def every_example(log: DataFrame) -> DataFrame:
    return PX.all_examples(log, None, NARRATIVES)


EVERY = {"plan": "SELECT dataset, case_id, unnest(range(2, trace_len)) AS prefix_len FROM cases"}


@register(Q.query(f"SELECT {EX} FROM ex", **Q.cases("L"), **EVERY, **Q.examples("L")))
def prefix_examples(spark, sf):
    return every_example(item_log(spark, sf)).select(*EX.split(", "))


@register(Q.query(f"SELECT {EX} FROM ex", **Q.cases("E", "'success'"), **EVERY, **Q.examples("E")))
def prefix_examples_long(spark, sf):
    return every_example(user_log(spark, sf)).select(*EX.split(", "))


@register(Q.query(
    f"""SELECT case_id, prefix_len, array_to_string({Q.shuffle_sql('acts', 'next', 'dataset', 'case_id', 'CAST(prefix_len AS VARCHAR)')}, ', ') AS next_candidates,
 array_to_string({Q.shuffle_sql("['success', 'failure']", 'outcome', 'dataset', 'case_id', 'CAST(prefix_len AS VARCHAR)')}, ', ') AS outcome_candidates
 FROM plan, (SELECT list_sort(list(DISTINCT activity)) AS acts FROM ev)""",
    **Q.cases("E", "'success'"), **EVERY))
def candidate_order(spark, sf):
    log = user_log(spark, sf)
    cases = case_table(order_events(log), label=None)
    rows = PX.plan_prefixes(cases, cap=0)
    out = PX.add_candidates(rows, checkpoint(CN.activity_inventory(log)), seed=SEED)
    return out.select("case_id", F.col("prefix_len").cast("int").alias("prefix_len"), *[
        F.array_join(c, ", ").alias(c) for c in ("next_candidates", "outcome_candidates")])


# ---- samples ---------------------------------------------------------------

SETTINGS = InstructionSettings(prefixes_per_case=6, seed=SEED)
ITEM_RULE = RULE_TEXTS["lineitem"]


def _instruction_ctes() -> dict[str, str]:
    pk = "CAST(p.prefix_len AS VARCHAR)"
    return {
        **Q.cases("L"), **Q.split("cases", "variant_id", 0.02, 5, "validation", "case-split"),
        **Q.plan("split_cases"), **Q.examples("L"),
        "rows": f"""SELECT p.split, x.*, p.label AS final_outcome, p.variant,
  {Q.shuffle_sql('acts', 'next', 'p.dataset', 'p.case_id', pk)} AS nc,
  {Q.shuffle_sql("['success', 'failure']", 'outcome', 'p.dataset', 'p.case_id', pk)} AS oc
  FROM ex x JOIN plan p ON p.case_id = x.case_id AND p.prefix_len = x.prefix_len,
  (SELECT list_sort(list(DISTINCT activity)) AS acts FROM ev)""",
        "tasks": f"""SELECT *, '{P.NEXT}' AS task, nc AS candidates, next_activity AS response FROM rows
  UNION ALL SELECT *, '{P.TIME}', NULL, CAST(remaining_time_days AS VARCHAR) FROM rows
  UNION ALL SELECT *, '{P.OUTCOME}', oc, final_outcome FROM rows""",
    }


def _system(task: str) -> str:
    return P.SYSTEM_PROMPTS[task].replace("'", "''")


def prompt_sql(response: str, rule: str = ITEM_RULE) -> str:
    ask = f"""CASE task WHEN '{P.NEXT}' THEN '{P.ASK_NEXT}' || {Q.json_list('candidates')} || '.'
 WHEN '{P.TIME}' THEN '{P.ASK_TIME}' ELSE '{P.ASK_OUTCOME}In this dataset, a case is labeled "success" when {rule}. Otherwise, it is labeled "failure". {P.CHOOSE_OUTCOME}' || {Q.json_list('candidates')} || '.' END"""
    system = "CASE task " + " ".join(f"WHEN '{t}' THEN '{_system(t)}'" for t in P.TASKS) + " END"
    nl = "chr(10)"
    return (f"{system} || {nl} || {nl} || '### Instruction' || {nl} || {ask} || {nl} || {nl} || '### Input' || {nl} || input_story"
            f" || {nl} || {nl} || '### Response' || {nl} || {response}")


def instruction_frame(spark: SparkSession, sf: str, variant_text: bool = False) -> DataFrame:
    settings = replace(SETTINGS, variant_text=variant_text)
    return instruction_data(item_log(spark, sf), NARRATIVES, RULE_TEXTS, settings, item_labels(spark, sf))


@register(Q.query(f"SELECT split, {prompt_sql('response')} AS text FROM tasks", **_instruction_ctes()))
def instruction_texts(spark, sf):
    return instruction_frame(spark, sf).select("split", "text")


@register(Q.query(
    f"""SELECT split, dataset, case_id, task, prefix_len, trace_len, prefix_ratio, story_segment_start, story_n_events, response,
 next_activity, remaining_time_days, final_outcome, CASE WHEN candidates IS NULL THEN NULL ELSE {Q.json_list('candidates')} END AS candidates,
 '{ITEM_RULE}' AS rule_description, variant FROM tasks""", **_instruction_ctes()))
def instruction_meta(spark, sf):
    return sample_meta(instruction_frame(spark, sf, variant_text=True)).withColumn("candidates", json_list(F.col("candidates")))


@register(Q.query(
    """SELECT coalesce(dataset, '*') AS dataset, coalesce(task, '*') AS task, count(*) AS n_samples FROM tasks
 GROUP BY CUBE (dataset, task)""", **_instruction_ctes()))
def instruction_counts(spark, sf):
    return sample_counts(instruction_frame(spark, sf))


# ---- prompts and scoring ---------------------------------------------------

TEST_CTES = {
    **Q.cases("L"), **Q.split("cases", "label", 0.2, 2, "test", "label-split"),
    "plan": "SELECT *, unnest(range(2, trace_len)) AS prefix_len FROM split_cases",
}
TEST_ONLY = {**TEST_CTES, "plan": TEST_CTES["plan"] + " WHERE split = 'test'"}
PROMPT_ROWS = {
    "rows": f"""SELECT p.split, x.*, p.label AS final_outcome,
  {Q.shuffle_sql('acts', 'next', 'p.dataset', 'p.case_id', 'CAST(p.prefix_len AS VARCHAR)')} AS nc,
  {Q.shuffle_sql("['success', 'failure']", 'outcome', 'p.dataset', 'p.case_id', 'CAST(p.prefix_len AS VARCHAR)')} AS oc
  FROM ex x JOIN plan p ON p.case_id = x.case_id AND p.prefix_len = x.prefix_len,
  (SELECT list_sort(list(DISTINCT activity)) AS acts FROM ev)""",
    "tasks": _instruction_ctes()["tasks"],
}


def item_prompts(spark: SparkSession, sf: str, block: bool = False) -> DataFrame:
    log, hot = item_log(spark, sf), items_hot(spark, sf)
    cases = checkpoint(S.split_label_stratified(item_cases(spark, sf, hot), 0.2, SEED))
    return evaluation_prompts(
        log, cases.where(F.col("split") == "test"), checkpoint(CN.activity_inventory(log)), NARRATIVES,
        RULE_TEXTS, EvaluationSettings(candidate_block=block, seed=SEED), hot)


@register(Q.query(
    f"""SELECT task, case_id, prefix_len, gold, CASE WHEN candidates IS NULL THEN p ELSE replace(p, chr(10) || chr(10) || '### Input' || chr(10),
  chr(10) || chr(10) || '### Candidates' || chr(10) || '{P.COPY_CANDIDATE}' || chr(10) || '- ' || array_to_string(candidates, chr(10) || '- ')
  || chr(10) || chr(10) || '### Input' || chr(10)) END AS prompt
 FROM (SELECT *, response AS gold, {prompt_sql("''")} AS p FROM tasks)""",
    **TEST_ONLY, **Q.examples("L"), **PROMPT_ROWS))
def eval_prompt_texts(spark, sf):
    prompts = item_prompts(spark, sf, block=True)
    return prompts.select("task", "case_id", "prefix_len", "gold", "prompt")


@register(Q.query(
    """SELECT task, array_to_string(any_value(CASE WHEN candidates IS NULL THEN NULL ELSE list_sort(candidates) END), ', ') AS universe
 FROM tasks GROUP BY 1""", **TEST_ONLY, **Q.examples("L"), **PROMPT_ROWS))
def candidate_universe(spark, sf):
    return shared_universe(item_prompts(spark, sf), ["dataset", "task"]).select(
        "task", F.array_join("universe", ", ").alias("universe"))


def baseline_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Repeat the last activity; mean days and majority outcome of the train cases."""
    log, hot = item_log(spark, sf), items_hot(spark, sf)
    cases = checkpoint(S.split_label_stratified(item_cases(spark, sf, hot), 0.2, SEED))
    inventory = checkpoint(CN.activity_inventory(log))
    rows = PX.all_examples(
        log, cases.withColumnRenamed("label", "final_outcome"), NARRATIVES, story=False, hot=hot)
    rows = checkpoint(evaluation_tasks(PX.add_candidates(rows, inventory, shuffle=False)))
    test = rows.where("split = 'test'")
    guesses = repeat_last_activity(test).unionByName(
        majority_baseline(test.where(F.col("task") != P.NEXT), rows.where("split = 'train'")))
    return checkpoint(score(test, guesses, inventory))


PREDICTED = {
    **TEST_CTES, **Q.examples("L"),
    "gold_rows": """SELECT p.split, x.*, p.label AS final_outcome, la.activity AS last_activity FROM ex x
 JOIN plan p ON p.case_id = x.case_id AND p.prefix_len = x.prefix_len
 JOIN ev la ON la.case_id = x.case_id AND la.seq = x.prefix_len - 1""",
    "pred": f"""SELECT dataset, '{P.NEXT}' AS task, case_id, prefix_len, prefix_ratio, next_activity AS gold, last_activity AS prediction, 6 AS candidate_count
  FROM gold_rows WHERE split = 'test'
  UNION ALL SELECT dataset, '{P.TIME}', case_id, prefix_len, prefix_ratio, CAST(remaining_time_days AS VARCHAR),
   (SELECT CAST(CAST(floor(avg(remaining_time_days)) AS BIGINT) AS VARCHAR) FROM gold_rows WHERE split = 'train'), 0 FROM gold_rows WHERE split = 'test'
  UNION ALL SELECT dataset, '{P.OUTCOME}', case_id, prefix_len, prefix_ratio, final_outcome,
   (SELECT arg_min(o, (-n, o)) FROM (SELECT final_outcome AS o, count(*) AS n FROM gold_rows WHERE split = 'train' GROUP BY 1)), 2 FROM gold_rows WHERE split = 'test'""",
}


@register(Q.query(
    """SELECT task, case_id, prefix_len, gold, prediction, true AS is_valid_parse, gold = prediction AS is_correct,
 CASE WHEN task LIKE 'next%' THEN (SELECT count(DISTINCT activity) FROM ev) ELSE candidate_count END AS candidate_count FROM pred""",
    **PREDICTED))
def score_baselines(spark, sf):
    return baseline_predictions(spark, sf).select(
        "task", "case_id", "prefix_len", "gold", "prediction", "is_valid_parse", "is_correct",
        F.col("candidate_count").cast("long").alias("candidate_count"))


# ---- metrics ---------------------------------------------------------------

def class_metrics_ctes(src: str, keys: str, fixed: str | None = None) -> dict[str, str]:
    """CTE ``cls``: classification metrics of rows with gold, prediction, ok."""
    labels = (f"SELECT DISTINCT {keys}, gold AS label FROM {src}" if fixed is None
              else f"SELECT DISTINCT {keys}, v.label FROM {src}, (VALUES {fixed}) v(label)")
    return {
        "lab": labels,
        "per_label": f"""SELECT l.*, (SELECT count(*) FROM {src} s WHERE {_eq(keys)} AND s.gold = l.label) AS g,
  (SELECT count(*) FROM {src} s WHERE {_eq(keys)} AND s.prediction = l.label) AS p,
  (SELECT count(*) FROM {src} s WHERE {_eq(keys)} AND s.prediction = l.label AND s.gold = l.label) AS t FROM lab l""",
        "macro": f"""SELECT {keys}, avg(CASE WHEN p > 0 THEN t / p ELSE 0 END) AS macro_precision,
  avg(CASE WHEN g + p > 0 THEN 2 * t / (g + p) ELSE 0 END) AS macro_f1 FROM per_label GROUP BY ALL""",
        "cls": f"""SELECT {', '.join('s.' + k for k in keys.split(', '))}, count(*) AS n_samples, round(avg(CAST(s.gold = s.prediction AS INT)), 6) AS accuracy,
  round(any_value(l.macro_precision), 6) AS macro_precision, round(any_value(l.macro_f1), 6) AS macro_f1,
  round(1 - avg(CAST(s.ok AS INT)), 6) AS invalid_rate FROM {src} s JOIN macro l ON {_eq(keys)} GROUP BY ALL""",
    }


def _eq(keys: str) -> str:
    return " AND ".join(f"s.{k} = l.{k}" for k in keys.split(", "))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names if n in df.columns})


NUMBERS = ["accuracy", "macro_precision", "macro_f1", "mae", "rmse", "invalid_rate"]


def label_guess(spark: SparkSession, sf: str) -> DataFrame:
    """Labels table as predictions: quality is gold, toxic decides the guess."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "lang", F.when(F.col("quality") == 1, "success").otherwise("failure").alias("gold"),
        F.when(F.col("n_chars") < 200, "__INVALID__").when(F.col("toxic") == 0, "success")
        .otherwise("failure").alias("prediction"),
        (F.col("n_chars") >= 200).alias("is_valid_parse"),
    )


GUESS_SQL = """SELECT lang, CASE WHEN quality = 1 THEN 'success' ELSE 'failure' END AS gold,
 CASE WHEN n_chars < 200 THEN '__INVALID__' WHEN toxic = 0 THEN 'success' ELSE 'failure' END AS prediction,
 n_chars >= 200 AS ok FROM labels JOIN documents USING (doc_id)"""


@register(Q.query("SELECT * FROM cls", g=GUESS_SQL, **class_metrics_ctes("g", "lang", "('success'), ('failure')")))
def classification_metrics(spark, sf):
    return rounded(M.classification_metrics(label_guess(spark, sf), ["lang"], ["success", "failure"]), *NUMBERS)


@register(Q.query(
    """SELECT dataset, task, count(*) AS n_samples, round(avg(abs(gold::DOUBLE - prediction::DOUBLE)), 6) AS mae,
 round(sqrt(avg((gold::DOUBLE - prediction::DOUBLE) ** 2)), 6) AS rmse, 0.0::DOUBLE AS invalid_rate FROM pred WHERE task LIKE 'remaining%' GROUP BY 1, 2""",
    **PREDICTED))
def regression_metrics(spark, sf):
    rows = baseline_predictions(spark, sf).where(F.col("task") == P.TIME)
    return rounded(M.regression_metrics(rows, ["dataset", "task"]), *NUMBERS)


def all_metrics_sql(keys: str, source: str, tail: str, predicted: dict[str, str] = PREDICTED) -> str:
    """Metrics of the three tasks from ``source`` (CTE with keys, task, gold, prediction, ok)."""
    ctes = {}
    for name, task, fixed in (("nx", P.NEXT, None), ("oc", P.OUTCOME, "('success'), ('failure')")):
        part = class_metrics_ctes(name, keys, fixed)
        ctes[name] = f"SELECT * FROM {source} WHERE task = '{task}'"
        for k, v in part.items():
            for other in part:
                v = _rename(v, other, f"{other}_{name}")
            ctes[f"{k}_{name}"] = v
    cols = "n_samples, accuracy, macro_precision, macro_f1, NULL::DOUBLE AS mae, NULL::DOUBLE AS rmse, invalid_rate"
    ctes["mets"] = f"""SELECT {keys}, {cols} FROM cls_nx UNION ALL SELECT {keys}, {cols} FROM cls_oc UNION ALL
 SELECT {keys}, count(*), NULL, NULL, NULL, round(avg(abs(gold::DOUBLE - prediction::DOUBLE)), 6),
 round(sqrt(avg((gold::DOUBLE - prediction::DOUBLE) ** 2)), 6), round(1 - avg(CAST(ok AS INT)), 6)
 FROM {source} WHERE task = '{P.TIME}' GROUP BY {keys}"""
    return Q.query(tail, **predicted, **{source: f"""SELECT *, prediction <> '__INVALID__' AS ok,
 CASE WHEN prefix_ratio < 0.34 THEN 'early' WHEN prefix_ratio < 0.67 THEN 'middle' ELSE 'late' END AS stage FROM pred"""}, **ctes)


@register(all_metrics_sql("dataset, task, stage", "scored", "SELECT * FROM mets"))
def stage_metrics(spark, sf):
    return rounded(M.stage_metrics(baseline_predictions(spark, sf)), *NUMBERS)


@register(Q.query(
    """SELECT dataset, task, count(*) AS n_cases, 0.0::DOUBLE AS invalid_rate,
 CASE WHEN task LIKE 'remaining%' THEN NULL ELSE round(avg(v), 6) END AS case_macro_accuracy,
 CASE WHEN task LIKE 'remaining%' THEN round(avg(v), 6) END AS case_macro_mae
 FROM (SELECT dataset, task, case_id, avg(CASE WHEN task LIKE 'remaining%' THEN abs(try_cast(gold AS DOUBLE) - try_cast(prediction AS DOUBLE))
   ELSE CAST(gold = prediction AS INT) END) AS v FROM pred GROUP BY 1, 2, 3) GROUP BY 1, 2""", **PREDICTED))
def case_macro_metrics(spark, sf):
    return rounded(M.case_macro(baseline_predictions(spark, sf)),
                   "invalid_rate", "case_macro_accuracy", "case_macro_mae")


SUMMARY_SQL = """SELECT dataset, count_if(split = 'train') AS baseline_train_cases, count_if(split = 'test') AS zero_shot_test_cases,
 CAST(coalesce(sum(CASE WHEN split = 'test' THEN greatest(trace_len - 2, 0) END), 0) AS BIGINT) AS zero_shot_test_prefixes FROM split_cases GROUP BY 1"""


@register(Q.query(
    f"""SELECT s.*, (SELECT count(DISTINCT activity) FROM ev) AS n_activities, '{ITEM_RULE}' AS success_rule FROM ({SUMMARY_SQL}) s""",
    **TEST_CTES))
def split_summary(spark, sf):
    cases = S.split_label_stratified(item_cases(spark, sf), 0.2, SEED)
    return M.split_summary(cases, CN.activity_inventory(item_log(spark, sf)), RULE_TEXTS).withColumn(
        "n_activities", F.col("n_activities").cast("long"))


@register(all_metrics_sql(
    "dataset, task", "scored",
    f"""SELECT '__dataset_macro__' AS dataset, task, CAST(sum(baseline_train_cases) AS BIGINT) AS baseline_train_cases,
 CAST(sum(zero_shot_test_cases) AS BIGINT) AS zero_shot_test_cases, CAST(sum(zero_shot_test_prefixes) AS BIGINT) AS zero_shot_test_prefixes,
 CAST(sum(n_samples) AS BIGINT) AS n_samples, avg(invalid_rate) AS invalid_rate, avg(accuracy) AS accuracy, avg(macro_precision) AS macro_precision,
 avg(macro_f1) AS macro_f1, avg(mae) AS mae, avg(rmse) AS rmse FROM mets JOIN ({SUMMARY_SQL}) s USING (dataset) GROUP BY task"""))
def dataset_macro_metrics(spark, sf):
    cases = S.split_label_stratified(item_cases(spark, sf), 0.2, SEED)
    summary = M.split_summary(cases, CN.activity_inventory(item_log(spark, sf)), RULE_TEXTS)
    per_dataset = rounded(M.dataset_metrics(baseline_predictions(spark, sf), summary), *NUMBERS)
    return M.dataset_macro(per_dataset)


# ---- answers ---------------------------------------------------------------

def with_candidates(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Prepared candidate list of the dataset on each of its rows; ``names``: dataset, names."""
    prepared = names.select("dataset", prepare_candidates(F.col("names")).alias("cands"))
    return rows.join(broadcast_if_small(prepared, max_bytes=BROADCAST_BYTES), "dataset")


ORIGIN_SQL = "'from source ' || repeat(chr(97 + CAST(substr(source, 4) AS INT)), 4) || ' in ' || lang || lang"


@register(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 OR (doc_id % 5 = 2 AND langs > 1) THEN '__INVALID__' ELSE {ORIGIN_SQL} END AS prediction,
 NOT (doc_id % 5 = 4 OR (doc_id % 5 = 2 AND langs > 1)) AS is_valid_parse
 FROM documents JOIN (SELECT source, count(DISTINCT lang) AS langs FROM documents GROUP BY 1) USING (source)""")
def parse_categorical_text(spark, sf):
    """The origin of each document told so that each rule decides some rows.

    Equal after a lead-in; contained; by its first words, which other languages of
    the source share; with two letters changed over, which leaves 23 of 24 letters
    in order against 22 at most for any other name; and not at all.
    """
    letter = F.chr(F.substring("source", 4, 9).cast("int") + 97)
    start = F.concat(F.lit("from source "), F.repeat(letter, F.lit(4)))
    docs = table(spark, sf, "documents").withColumns({
        "dataset": F.lit("docs"), "name": F.concat(start, F.lit(" in "), "lang", "lang")})
    names = docs.groupBy("dataset").agg(F.sort_array(F.collect_set("name")).alias("names"))
    way = F.col("doc_id") % 5
    raw = F.when(way == 0, F.concat(F.lit("The prediction is: "), F.upper("name"))).when(
        way == 1, F.concat(F.lit("they said "), "name", F.lit(" again"))).when(way == 2, start).when(
        way == 3, F.replace("name", F.lit("from"), F.lit("frmo"))).otherwise(F.lit("no idea at all"))
    return parse_categorical(with_candidates(docs.withColumn("raw", raw), names), "raw", "cands").select(
        "doc_id", "prediction", "is_valid_parse")


SPEAKER_SQL = "'spoken by ' || coalesce(role, 'nobody') || ' in turn ' || repeat(chr(CAST(97 + coalesce(turn, 0) % 26 AS INT)), 4)"


@register(f"""SELECT conv_id, turn, role, CASE WHEN way = 4 THEN '__INVALID__' ELSE name END AS prediction, way <> 4 AS is_valid_parse
 FROM (SELECT *, {SPEAKER_SQL} AS name, (conv_id + coalesce(turn, 0)) % 5 AS way FROM conversations WHERE conv_id IS NOT NULL)""")
def parse_categorical_turns(spark, sf):
    """Whole turns of conversations as answers, each with its speaker told in one of five ways.

    On a line of its own behind a lead-in; inside the last sentence; before the text;
    on a line with two letters changed over; and not at all, so that all of the turn
    has to be compared with all speakers.
    """
    turn = F.coalesce("turn", F.lit(0))
    letter = F.chr(97 + turn % 26)
    turns = table(spark, sf, "conversations").where("conv_id IS NOT NULL").withColumns({
        "dataset": F.lit("turns"), "said": F.coalesce("text", F.lit("")), "way": (F.col("conv_id") + turn) % 5,
        "name": F.concat(F.lit("spoken by "), F.coalesce("role", F.lit("nobody")), F.lit(" in turn "), F.repeat(letter, F.lit(4)))})
    names = turns.groupBy("dataset").agg(F.sort_array(F.collect_set("name")).alias("names"))
    way = F.col("way")
    raw = F.when(way == 0, F.concat("said", F.lit("\nThe prediction is: "), F.upper("name"))).when(
        way == 1, F.concat("said", F.lit(" they said "), "name", F.lit(" again"))).when(
        way == 2, F.concat("name", F.lit("\n"), "said")).when(
        way == 3, F.concat("said", F.lit("\n"), F.replace("name", F.lit("spoken"), F.lit("spokne")))).otherwise(F.col("said"))
    return parse_categorical(with_candidates(turns.withColumn("raw", raw), names), "raw", "cands").select(
        "conv_id", "turn", "role", "prediction", "is_valid_parse")


@register(f"""SELECT event_id, CASE WHEN event_id % 5 = 3 OR (event_id % 5 = 4 AND event_type <> 'purchase')
 THEN '__INVALID__' ELSE event_type END AS prediction,
 NOT (event_id % 5 = 3 OR (event_id % 5 = 4 AND event_type <> 'purchase')) AS is_valid_parse FROM events""")
def parse_categorical_events(spark, sf):
    """Event types told in five ways: quoted, in a sentence, in a list, not at all, misspelt."""
    name, way = F.col("activity"), F.col("in_order") % 5
    log = user_log(spark, sf)
    told = log.withColumn("raw", F.when(way == 0, F.concat(F.lit('**The next activity is:** "'), F.upper(name), F.lit('".')))
                          .when(way == 1, F.concat(name, F.lit(" or something else")))
                          .when(way == 2, F.concat(name, F.lit("; then view")))
                          .when(way == 3, "no idea at all")
                          .otherwise(F.substring(name, F.lit(1), F.length(name) - 1)))
    names = CN.activity_inventory(log).withColumnRenamed("activities", "names")
    return parse_categorical(with_candidates(told, names), "raw", "cands").select(
        F.col("in_order").alias("event_id"), "prediction", "is_valid_parse")


@register(r"""SELECT doc_id, coalesce(CAST(floor(greatest(CAST(d[-1] AS DOUBLE), 0)) AS BIGINT), 0) AS days, len(d) > 0 AS valid
 FROM (SELECT doc_id, regexp_extract_all(text, '-?[0-9]+(?:\.[0-9]+)?') AS d FROM documents)""")
def parse_remaining_time(spark, sf):
    parsed = parse_days(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.coalesce(parsed, F.lit(0)).alias("days"), parsed.isNotNull().alias("valid"))


@register(r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(replace(text, '**', ' '), '```', ' '), chr(10)),
 lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS cleaned FROM conversations""")
def clean_answers(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", clean_answer(F.col("text")).alias("cleaned"))


# ---- corpora ---------------------------------------------------------------

@register(r"SELECT doc_id, t AS text, length(t) AS n_kept FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents) WHERE t <> ''")
def clean_texts(spark, sf):
    return CP.clean_text(table(spark, sf, "documents")).select(
        "doc_id", "text", F.length("text").alias("n_kept"))


WORDS_SQL = r"SELECT *, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]')) AS n_tokens FROM documents"


@register(f"SELECT doc_id, n_tokens FROM ({WORDS_SQL})")
def token_counts(spark, sf):
    return CP.token_counts(table(spark, sf, "documents")).select("doc_id", "n_tokens")


@register(f"SELECT doc_id, n_tokens FROM ({WORDS_SQL}) WHERE n_tokens < 512")
def drop_overlong(spark, sf):
    docs = CP.drop_overlong(table(spark, sf, "documents"), 512)
    return CP.token_counts(docs).select("doc_id", "n_tokens")


@register(f"""SELECT count(*) AS n_before, count_if(n_tokens >= 512) AS n_dropped,
 round(count_if(n_tokens >= 512) / greatest(count(*), 1), 6) AS dropped_share FROM ({WORDS_SQL})""")
def overlong_share(spark, sf):
    return rounded(CP.overlong_report(table(spark, sf, "documents"), 512), "dropped_share")


@register(f"""SELECT count(*) AS "count", min(n_tokens) AS min, {', '.join(
    f'CAST(floor(round(quantile_cont(n_tokens, {q}), 6)) AS BIGINT) AS p{int(q * 100)}' for q in (0.5, 0.9, 0.95, 0.99))},
 max(n_tokens) AS max, round(avg(n_tokens), 6) AS mean
 FROM (SELECT * FROM ({WORDS_SQL}) ORDER BY {Q.h('sample', 'CAST(doc_id AS VARCHAR)')}, doc_id LIMIT 700)""")
def length_profile(spark, sf):
    return rounded(CP.length_profile(table(spark, sf, "documents"), 700, SEED, ["doc_id"]), "mean")


@register("SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 500)")
def sample_head(spark, sf):
    return S.first_rows(table(spark, sf, "events"), 500, ["ts", "event_id"]).select("event_id", "user_id")


@register(f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {Q.h('holdout', 'CAST(doc_id AS VARCHAR)')}, doc_id)
 <= ceil(count(*) OVER () * 0.05::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM documents""")
def holdout_split(spark, sf):
    return S.holdout_split(table(spark, sf, "documents"), 0.05, SEED, ["doc_id"]).select("doc_id", "split")


CHAT_TEXT = r"""SELECT conv_id, turn, '### Instruction' || chr(10) || role || chr(10) || chr(10) || '### Response' || chr(10)
 || regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations"""


def chat_samples(spark: SparkSession, sf: str) -> DataFrame:
    from tracewright.functions.text import strip

    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(
            F.lit(P.INSTRUCTION), F.col("role"), F.lit("\n\n" + P.RESPONSE), strip(F.col("text"))
        ).alias("text"))


@register(Q.query(
    """SELECT conv_id, turn, substr(f, 1, length(f) - length(r)) AS prompt, r AS response FROM (SELECT *,
 string_split(f, '### Response' || chr(10))[-1] AS r FROM (SELECT *, text || '</s>' AS f FROM c))""", c=CHAT_TEXT))
def response_split(spark, sf):
    return CP.split_response(chat_samples(spark, sf), end="</s>").select(
        "conv_id", "turn", "prompt", "response")


TOKENS = r"[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]"


def id_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{TOKENS}'), lambda w: CAST('0x' || substr(md5(w), 1, 6) AS BIGINT))"


PROMPT_SQL = "'### Instruction' || chr(10) || role || chr(10) || chr(10) || '### Response' || chr(10)"


def hashed_ids(text: Column) -> Column:
    """A tokeniser that SQL can write too: a number from the hash of each word."""
    return F.transform(CP.word_tokens(text), lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long"))


@register(Q.query(
    """SELECT conv_id, turn, array_to_string(kept, ' ') AS input_ids,
 array_to_string(list_concat(list_transform(range(0, masked), lambda i: -100), kept[masked + 1:]), ' ') AS labels,
 len(kept) - masked AS loss_tokens
 FROM (SELECT *, greatest(least(p, len(ids)) - (len(ids) - len(kept)), 0) AS masked FROM (SELECT *, ids[-48:] AS kept FROM t))
 WHERE len(kept) > masked""",
    c=CHAT_TEXT, t=f"""SELECT conv_id, turn, {id_sql('c.text')} AS ids, len({id_sql(PROMPT_SQL)}) AS p
 FROM c JOIN conversations v USING (conv_id, turn)"""))
def response_mask(spark, sf):
    out = CP.mask_prompt(chat_samples(spark, sf), 48, tokenizer=hashed_ids)
    return out.select("conv_id", "turn", F.array_join("input_ids", " ").alias("input_ids"),
                      F.array_join("labels", " ").alias("labels"), "loss_tokens")


# ---- folders of logs -------------------------------------------------------

TREE = {"events": ["events"], "lineitem": ["lineitem"], "orders": ["orders"]}


def log_tree(spark: SparkSession, sf: str, parts: int = 3) -> str:
    """A fresh folder that holds every log whole, each in ``parts`` parts or as many as its table is read in.

    So a part, which one task writes and reads, does not grow with the table.
    """
    root = fresh_folder(spark)
    for log in (user_log, item_log, order_log):
        one = log(spark, sf).select("dataset", "case_id", "activity", "ts", "in_order")
        name = one.first()["dataset"]
        rows = one.drop("dataset")
        rows.repartition(max(parts, rows.rdd.getNumPartitions())).write.parquet(f"{root}/raw/{name}.parquet")
    return root


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    logs = [read_named(spark, f"{root}/{name}", name, spellings=TREE) for name in TREE]
    return logs[0].unionByName(logs[1], allowMissingColumns=True).unionByName(logs[2], allowMissingColumns=True)


@register(Q.query(
    """SELECT l.dataset, l.case_id, l.in_order, coalesce(m.canonical, lower(l.activity)) AS activity
 FROM logs l LEFT JOIN m ON m.dataset = l.dataset AND m.raw = l.activity""",
    logs=Q.ALL, m=MAP_SQL + " UNION ALL SELECT DISTINCT 'lineitem', activity, replace(lower(activity), '/', ' ') FROM (" + Q.L + ")"
    + " UNION ALL SELECT 'events', 'signup', 'signup'"))
def canonicalize_tree(spark, sf):
    root = log_tree(spark, sf)
    names = item_log(spark, sf).select(
        "dataset", F.col("activity").alias("raw"), F.replace(F.lower("activity"), F.lit("/"), F.lit(" ")).alias("canonical"))
    extra = spark.createDataFrame([("events", "signup", "signup")], "dataset string, raw string, canonical string")
    whole = activity_map(spark).unionByName(names.distinct()).unionByName(extra)
    report = canonicalize_logs(spark, f"{root}/raw", f"{root}/out", whole, fmt="parquet", activity="activity", spellings=TREE)
    if report.errors:
        raise ValueError(report.errors)
    return read_tree(spark, f"{root}/out").select("dataset", "case_id", "in_order", "activity")


@register(Q.query("SELECT dataset, case_id, label, n AS n_events FROM c", logs=Q.ALL, c=ALL_LABELS))
def label_tree(spark, sf):
    root = log_tree(spark, sf)
    report = label_logs(spark, f"{root}/raw", f"{root}/out", view_rules(), fmt="parquet", spellings=TREE)
    if report.errors:
        raise ValueError(report.errors)
    return read_tree(spark, f"{root}/out").groupBy("dataset", "case_id", "label").agg(F.count("*").alias("n_events"))


@register(Q.query(
    """SELECT dataset, case_id, in_order, round_even(greatest((epoch_us(max(ts) OVER (PARTITION BY dataset, case_id)) - epoch_us(ts))
 / 1e6 / 86400::DOUBLE, 0), 0) AS remaining_time FROM logs""", logs=Q.ALL))
def remaining_time_tree(spark, sf):
    root = log_tree(spark, sf)
    report = remaining_time_logs(spark, f"{root}/raw", f"{root}/out", fmt="parquet", spellings=TREE)
    if report.errors:
        raise ValueError(report.errors)
    return read_tree(spark, f"{root}/out").select("dataset", "case_id", "in_order", "remaining_time")


@register(Q.query(
    """SELECT dataset, case_id, in_order, replace(lower(activity), '/', ' ') AS activity,
 CASE WHEN dataset = 'lineitem' THEN 2 ELSE 1 END AS run, count(*) OVER (PARTITION BY dataset) AS n_rows FROM logs""", logs=Q.ALL))
def resumed_tree(spark, sf):
    """A run that ends half-way and one that goes on: every row once, logs of the first run untouched.

    The first run lacks the names of one log. The second has them; it leaves the
    others as they are, and each log's manifest tells its number of rows.
    """
    root = log_tree(spark, sf)
    names = table(spark, sf, "lineitem").limit(0).select(F.lit("").alias("dataset"), F.lit("").alias("raw"), F.lit("").alias("canonical"))
    for log in (user_log, item_log, order_log):
        names = names.unionByName(log(spark, sf).select(
            "dataset", F.col("activity").alias("raw"), F.replace(F.lower("activity"), F.lit("/"), F.lit(" ")).alias("canonical")).distinct())
    names = checkpoint(names)
    runs: dict[str, int] = {}
    for run, known in ((1, names.where("dataset <> 'lineitem'")), (2, names)):
        report = canonicalize_logs(
            spark, f"{root}/raw", f"{root}/out", known, fmt="parquet", activity="activity", spellings=TREE, resume=True)
        for done in report.done:
            if done["dataset"] not in report.resumed:
                runs[done["dataset"]] = run
    counts = [(d["dataset"], runs[d["dataset"]], int(d["n_rows"])) for d in report.done]
    told = spark.createDataFrame(counts, "dataset string, run int, n_rows long")
    return read_tree(spark, f"{root}/out").join(F.broadcast(told), "dataset").select(
        "dataset", "case_id", "in_order", "activity", "run", "n_rows")


# ---- absent outputs --------------------------------------------------------

@register(Q.query(
    """SELECT case_id, prefix_len, CASE WHEN last_activity = 'N/O' THEN '__INVALID__' ELSE last_activity END AS prediction,
 last_activity <> 'N/O' AS is_valid_parse, last_activity <> 'N/O' AND last_activity = next_activity AS is_correct
 FROM (SELECT x.case_id, x.prefix_len, x.next_activity, la.activity AS last_activity FROM ex x
 JOIN ev la ON la.case_id = x.case_id AND la.seq = x.prefix_len - 1)""",
    **Q.cases("L"), **EVERY, **Q.examples("L")))
def score_missing(spark, sf):
    """Every prefix is scored; the predictor says nothing after n/o."""
    log = item_log(spark, sf)
    inventory = checkpoint(CN.activity_inventory(log))
    rows = PX.all_examples(log, None, NARRATIVES, story=False).withColumn("final_outcome", F.lit("success"))
    rows = checkpoint(evaluation_tasks(PX.add_candidates(rows, inventory, shuffle=False)).where(F.col("task") == P.NEXT))
    said = repeat_last_activity(rows).where("raw_output <> 'N/O'")
    return score(rows, said, inventory).select("case_id", "prefix_len", "prediction", "is_valid_parse", "is_correct")


# ---- sources and sinks: a table written in the format, read back whole -----

@register("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props, value FROM events")
def csv_sniffed(spark, sf):
    """Semicolons, quotes and a Latin letter in Latin-1; separator and encoding are found."""
    path = f"{fresh_folder(spark)}/log.csv"
    rows = table(spark, sf, "events").select("event_id", "event_type", "props", "value", F.lit("é").alias("latin"))
    rows.write.options(header=True, sep=";", quote='"', escape='"', encoding="ISO-8859-1").csv(path)
    back = read_csv(spark, path).where("latin = 'é'")
    return back.select(F.col("event_id").cast("string").alias("event_id"), "event_type", "props", F.col("value").cast("double").alias("value"))


@register(Q.query("SELECT case_id, activity, ts, in_order FROM l", l=Q.E))
def roles_by_name(spark, sf):
    """Roles found by a part of the column's name."""
    raw = user_log(spark, sf).select(
        F.col("case_id").alias("The Case ID number"), F.col("activity").alias("the activity said"), F.col("ts").alias("its timestamp"), "in_order")
    return event_log(raw, "events", substring_names=True).select("case_id", "activity", "ts", "in_order")


@register("SELECT count(*) AS n_rows, count_if(event_type = 'error') AS n_unparsed FROM events")
def lost_timestamps(spark, sf):
    text = F.when(F.col("event_type") == "error", "someday").otherwise(F.col("ts").cast("string"))
    return unparsed_timestamps(table(spark, sf, "events").withColumn("when", text), "when")


@register(Q.query("SELECT case_id, activity, k, value FROM l", l=Q.E))
def xes_scan(spark, sf):
    """Every case as a trace of XES files; attributes come back with their types."""
    def tags(key: str, value: Column) -> Column:
        one = F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value"))
        return F.filter(F.array(one), lambda x: x["_value"].isNotNull())

    event = F.struct(tags("activity", F.col("activity")).alias("string"), tags("k", F.col("k")).alias("int"),
                     tags("value", F.col("value")).alias("float"))
    traces = user_log(spark, sf).groupBy("case_id").agg(F.collect_list(event).alias("event"))
    path = f"{fresh_folder(spark)}/log.xes"
    traces.select(tags("id", F.col("case_id")).alias("string"), "event").write.format("xml").options(
        rootTag="log", rowTag="trace").save(path)
    return read_xes(spark, path).select(F.col("`case:id`").alias("case_id"), "activity", "k", "value")


@register("SELECT text FROM documents")
def corpus_csv(spark, sf):
    path = f"{fresh_folder(spark)}/train.csv"
    write_corpus(table(spark, sf, "documents"), path)
    return read_corpus(spark, path)["train"]


_ODD_TEXT = """CASE doc_id % 6 WHEN 0 THEN '  ' || text || ' ' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '{0}N'
  WHEN 4 THEN '"' || text || chr(13) || chr(10) || ',' ELSE text END"""


@register(f"SELECT {_ODD_TEXT.format(chr(92))} AS text FROM documents")
def corpus_csv_values(spark, sf):
    """Texts with outer blanks, quotes and line ends, empty texts and nulls, written and read back."""
    path = f"{fresh_folder(spark)}/train.csv"
    write_corpus(table(spark, sf, "documents").withColumn("text", F.expr(_ODD_TEXT.format(chr(92) * 2))), path)
    return read_corpus(spark, path)["train"]


@register("SELECT doc_id, text, CASE WHEN doc_id % 20 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents")
def corpus_folder(spark, sf):
    """A corpus folder of two parts, one as JSON lines and one as Parquet."""
    root, docs = fresh_folder(spark), table(spark, sf, "documents").select("doc_id", "text")
    held = F.col("doc_id") % 20 == 0
    docs.where(~held).write.json(f"{root}/train.jsonl")
    docs.where(held).write.parquet(f"{root}/validation.parquet")
    parts = read_corpus(spark, root)
    return parts["train"].select("doc_id", "text", F.lit("train").alias("split")).unionByName(
        parts["validation"].select("doc_id", "text", F.lit("validation").alias("split")))


@register(Q.query(
    f"SELECT conv_id, turn, text, {Q.json_list('[role, lang]')} AS candidates, role AS split FROM (SELECT *, 'x, y' AS lang FROM conversations)"))
def samples_csv_and_jsonl(spark, sf):
    """Samples in both formats, joined row by row: lists are JSON text in the one, lists in the other."""
    root = fresh_folder(spark)
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", F.array(F.col("role"), F.lit("x, y")).alias("candidates"), F.col("role").alias("split"))
    write_samples(rows, root, "both")
    csv = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(f"{root}/csv")
    lines = spark.read.json(f"{root}/jsonl").select("conv_id", "turn", F.col("text").alias("t"), json_list(F.col("candidates")).alias("c"))
    both = csv.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")}).join(lines, ["conv_id", "turn"])
    return both.where("text = t AND candidates = c").select("conv_id", "turn", "text", "candidates", "split")


@register(Q.query(
    """SELECT s.split, l.case_id, l.in_order, l.activity FROM l JOIN split_cases s ON s.case_id = l.case_id""",
    l=Q.L, **Q.cases("L"), **Q.split("cases", "label", 0.2, 2, "test", "label-split")))
def case_split_files(spark, sf):
    root = fresh_folder(spark)
    parts = S.split_label_stratified(item_cases(spark, sf), 0.2, SEED)
    write_case_splits(item_log(spark, sf).select(*CASE, "in_order", "activity"), parts, root)
    back = spark.read.options(header=True, quote='"', escape='"').schema("case_id string, in_order long, activity string").csv(f"{root}/events")
    return back.select("split", "case_id", "in_order", "activity")


@register(Q.query(
    f"""SELECT l.dataset, l.case_id, l.in_order, CASE WHEN v.value = 1 THEN 'success' ELSE 'failure' END AS label
 FROM l JOIN ({LOOKUP_SQL}) v ON v.case_id = l.case_id WHERE v.value IS NOT NULL""", l=Q.L))
def labelled_only(spark, sf):
    """Events of cases whose rule gives a label; the others are dropped."""
    urgent = OUT.case_outcomes(order_log(spark, sf), {"orders": OUT.Contains("urgent", ["1-urgent"])})
    rule = {"lineitem": OUT.Lookup("urgent in orders", labels=urgent)}
    return OUT.label_outcomes(item_log(spark, sf), rule, drop_unlabeled=True).select("dataset", "case_id", "in_order", "label")


# ---- whole evaluation over three logs --------------------------------------

OUTCOME_SQL = {
    "E": "CASE WHEN arg_max(activity, seq) IN ('purchase', 'signup') THEN 'success' ELSE 'failure' END",
    "L": Q.L_LABEL,
    "O": "CASE WHEN bool_or(activity = '1-URGENT') AND NOT bool_or(activity = '5-LOW') THEN 'success' ELSE 'failure' END",
}


def _evaluation_ctes() -> dict[str, str]:
    """CTE ``pred``: every test prefix of three logs, answered by ``say_first``."""
    ctes: dict[str, str] = {}
    for x, label in OUTCOME_SQL.items():
        ctes[f"ev_{x}"], ctes[f"cases_{x}"] = (_rename(s, "ev", f"ev_{x}") for s in Q.cases(x, label).values())
    every = " UNION ALL ".join
    ctes["cases"] = every(f"SELECT * FROM cases_{x}" for x in OUTCOME_SQL)
    ctes["ev"] = every(f"SELECT dataset, activity FROM ev_{x}" for x in OUTCOME_SQL)
    ctes |= Q.split("cases", "label", 0.2, 2, "test", "label-split")
    ctes["plan"] = TEST_ONLY["plan"]
    for x in OUTCOME_SQL:
        part = Q.examples(x, "plan", f"ev_{x}")
        ctes[f"ends_{x}"], ctes[f"ex_{x}"] = part["ends"], _rename(part["ex"], "ends", f"ends_{x}")
    ctes["ex"] = every(f"SELECT * FROM ex_{x}" for x in OUTCOME_SQL)
    rules = " ".join(f"WHEN '{d}' THEN '{t}'" for d, t in RULE_TEXTS.items())
    pk = "CAST(p.prefix_len AS VARCHAR)"
    # An answer loses its numbering, so "1-URGENT" names nothing; what is left of the longest name is like it by 26 in 28.
    lost = "regexp_matches(candidates[1], '^[0-9]-') AND candidates[1] <> '4-NOT SPECIFIED'"
    ctes["rows"] = f"""SELECT x.*, p.label AS final_outcome, CASE p.dataset {rules} END AS rule,
  {Q.shuffle_sql('acts', 'next', 'p.dataset', 'p.case_id', pk)} AS nc,
  {Q.shuffle_sql("['success', 'failure']", 'outcome', 'p.dataset', 'p.case_id', pk)} AS oc
  FROM ex x JOIN plan p ON p.dataset = x.dataset AND p.case_id = x.case_id AND p.prefix_len = x.prefix_len
  JOIN (SELECT dataset, list_sort(list(DISTINCT activity)) AS acts FROM ev GROUP BY 1) a ON a.dataset = x.dataset"""
    ctes["tasks"] = _instruction_ctes()["tasks"]
    ctes["pred"] = f"""SELECT dataset, task, case_id, prefix_len, prefix_ratio, response AS gold,
  CASE WHEN candidates IS NULL THEN CAST(length({prompt_sql("''", "' || rule || '")}) % 50 AS VARCHAR) WHEN {lost} THEN '__INVALID__' ELSE candidates[1] END AS prediction FROM tasks"""
    return ctes


EVALUATED = _evaluation_ctes()


def say_first(texts: list[str]) -> list[str]:
    """A predictor of prompt texts alone: the first candidate listed, else days from the prompt's length."""
    out = []
    for text in texts:
        listed = re.findall(r'\["([^"]*)"', text.split("### Input", 1)[0])
        out.append(f'"{listed[-1]}"' if listed else f"about {len(text) % 50} days")
    return out


def evaluate_logs(spark: SparkSession, sf: str):
    logs = [f(spark, sf) for f in (user_log, item_log, order_log)]
    union = logs[0].unionByName(logs[1], allowMissingColumns=True).unionByName(logs[2], allowMissingColumns=True)
    labels = OUT.case_labels(union, view_rules())
    return evaluate(union, NARRATIVES, RULE_TEXTS, lambda prompts: predict_in_batches(prompts, say_first),
                    EvaluationSettings(seed=SEED), labels)


@register(Q.query(
    "SELECT dataset, task, case_id, prefix_len, gold, prediction, prediction <> '__INVALID__' AS is_valid_parse, gold = prediction AS is_correct FROM pred",
    **EVALUATED))
def evaluation_predictions(spark, sf):
    """The whole evaluation with a predictor in batches; its predictions are written and read back."""
    path = f"{fresh_folder(spark)}/predictions"
    rows = evaluate_logs(spark, sf).predictions.select(
        "dataset", "task", "case_id", "prefix_len", "gold", "prediction", "is_valid_parse", "is_correct")
    write_predictions(rows, path)
    return read_csv(spark, path, ",", "UTF-8", schema=rows.schema)


EVALUATION_METRICS = ["baseline_train_cases", "zero_shot_test_cases", "zero_shot_test_prefixes", "n_samples"]


@register(all_metrics_sql(
    "dataset, task", "scored",
    f"""SELECT dataset, task, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in EVALUATION_METRICS)},
 {', '.join(f'round({c}, 4) AS {c}' for c in NUMBERS)} FROM (
 SELECT * FROM per_log UNION ALL BY NAME SELECT '__dataset_macro__' AS dataset, task, {', '.join(f'sum({c}) AS {c}' for c in EVALUATION_METRICS)},
 {', '.join(f'avg({c}) AS {c}' for c in NUMBERS)} FROM per_log GROUP BY task)""".replace("per_log", f"(SELECT * FROM mets JOIN ({SUMMARY_SQL}) s USING (dataset))"),
    EVALUATED))
def evaluation_metrics(spark, sf):
    """Metrics of three logs as a CSV report and their means as a JSON report, both read back."""
    root = fresh_folder(spark)
    done = evaluate_logs(spark, sf)
    write_report(done.metrics, f"{root}/metrics")
    write_report(done.dataset_macro, f"{root}/macro", json=True)
    back = read_csv(spark, f"{root}/metrics", ",", "UTF-8", schema=done.metrics.schema)
    macro = spark.read.schema(done.dataset_macro.schema).json(f"{root}/macro")
    return back.unionByName(macro).select(
        "dataset", "task", *EVALUATION_METRICS, *[F.round(c, 4).alias(c) for c in NUMBERS])


@register(Q.query(
    f"""SELECT dataset, 'label' AS label_col, CAST(sum(n) AS VARCHAR) AS n_events, CAST(count(*) AS VARCHAR) AS n_cases,
 CAST(count_if(label = 'success') AS VARCHAR) AS n_positive_cases,
 'label=''success'' if ' || CASE dataset {' '.join(f"WHEN '{d}' THEN '{t}'" for d, t in RULE_TEXTS.items())} END || '; otherwise label=''failure''.' AS rule
 FROM c GROUP BY 1""", logs=Q.ALL, c=ALL_LABELS))
def label_reports(spark, sf):
    """The run reports of a labelled tree, read back: one summary row a log, and its rule."""
    root = log_tree(spark, sf)
    report = label_logs(spark, f"{root}/raw", f"{root}/out", view_rules(), fmt="parquet", spellings=TREE)
    if report.errors:
        raise ValueError(report.errors)
    rules = spark.read.json(f"{root}/out/_rules")
    counts = spark.read.json(f"{root}/out/_summary").select(
        "dataset", "label_col", "n_events", "n_cases", "n_positive_cases", F.col("rule").alias("rule_told"))
    return counts.join(rules, "dataset").where("rule = rule_told").drop("rule_told")


# ---- names, subsets and own functions --------------------------------------

@register("""SELECT alias, count(*) AS n_pages FROM (SELECT CASE """ + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(name), '{a}')" for a in words) + f" THEN '{d}'" for d, words in DATASET_ALIASES.items())
    + """ END AS alias FROM (SELECT CASE page_id % 4 WHEN 0 THEN url || '/Travel_Permits.xes' WHEN 1 THEN url || '/BPI_Challenge_2012_W.csv'
 WHEN 2 THEN url || '/Receiving phase of OCEL.csv' ELSE url END AS name FROM pages)) GROUP BY 1""")
def dataset_by_alias(spark, sf):
    """File names below the address of each page, known by the default aliases; the first in their order wins."""
    end = F.pmod("page_id", F.lit(4))
    name = F.concat("url", F.when(end == 0, "/Travel_Permits.xes").when(end == 1, "/BPI_Challenge_2012_W.csv").when(
        end == 2, "/Receiving phase of OCEL.csv").otherwise(""))
    return table(spark, sf, "pages").groupBy(first_dataset_in_path(name).alias("alias")).agg(F.count("*").alias("n_pages"))


@register(Q.query(
    """SELECT case_id, count(*) AS n_events, count(ts) AS n_timed FROM l WHERE case_id IS NOT NULL GROUP BY 1""",
    l="SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS case_id, ts FROM events"))
def null_case_ids(spark, sf):
    """Events without a case id are no part of a log."""
    raw = table(spark, sf, "events").withColumn("case id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")))
    log = event_log(raw.drop("user_id"), "events", "case id", "event_type", "ts", "event_id")
    return log.groupBy("case_id").agg(F.count("*").alias("n_events"), F.count("ts").alias("n_timed"))


SUBSET = f" {P.TIME}, {P.OUTCOME} ,,{P.TIME}"


@register(Q.query(
    f"""SELECT case_id, prefix_len, '{P.TIME}' AS task, CAST(remaining_time_days AS VARCHAR) AS gold FROM ex
 UNION ALL SELECT x.case_id, prefix_len, '{P.OUTCOME}', label FROM ex x JOIN cases c ON c.case_id = x.case_id""",
    **Q.cases("L"), **EVERY, **Q.examples("L")))
def task_subset(spark, sf):
    """Two of the three tasks, named in a comma list with blanks, gaps and a repeat."""
    log, hot = item_log(spark, sf), items_hot(spark, sf)
    rows = PX.all_examples(log, item_cases(spark, sf, hot).withColumnRenamed("label", "final_outcome"), NARRATIVES, story=False, hot=hot)
    rows = PX.add_candidates(rows, CN.activity_inventory(log), shuffle=False)
    return evaluation_tasks(rows, parse_names(SUBSET)).select("case_id", "prefix_len", "task", "gold")


@register(Q.query(
    f"""SELECT task, case_id, prefix_len, 'Q: ' || CASE task WHEN '{P.NEXT}' THEN '{P.ASK_NEXT}' || {Q.json_list('candidates')} || '.' ELSE '{P.ASK_TIME}' END
 || chr(10) || 'Story: ' || input_story || CASE WHEN candidates IS NULL THEN '' ELSE chr(10) || chr(10) || '### Candidates' || chr(10) || array_to_string(candidates, ' / ') END AS prompt
 FROM tasks WHERE task <> '{P.OUTCOME}'""", **TEST_ONLY, **Q.examples("L"), **PROMPT_ROWS))
def own_prompts(spark, sf):
    """Prompts whose layout and candidate block are the caller's functions, without system prompt, for two tasks."""
    log, hot = item_log(spark, sf), items_hot(spark, sf)
    cases = checkpoint(S.split_label_stratified(item_cases(spark, sf, hot), 0.2, SEED)).where("split = 'test'")
    rows = PX.all_examples(log, cases.withColumnRenamed("label", "final_outcome"), NARRATIVES, hot=hot)
    rows = PX.add_candidates(rows, checkpoint(CN.activity_inventory(log)), seed=SEED)
    return eval_prompts(
        rows, RULE_TEXTS, [P.NEXT, P.TIME], system_prompt=False, with_candidate_block=True,
        compose=lambda task, asked, story, response, system: F.concat(F.lit("Q: "), asked, F.lit("\nStory: "), story, response),
        block=lambda candidates: F.array_join(candidates, " / "),
    ).select("task", "case_id", "prefix_len", "prompt")


# A log told by a narrative of the library's own.
Q.LOG["P"] = """SELECT 'BPIC2020D' AS dataset, CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity, o_orderdate AS ts,
 o_orderkey AS in_order, 'State ' || o_orderstatus AS "org:role", CASE WHEN o_orderkey % 3 > 0 THEN 'DESK ' || (o_orderkey % 5) END AS "org:resource" FROM orders"""
Q.TAILS["P"] = """'with role ' || lower("org:role") || coalesce(' and resource ' || lower("org:resource"), '')"""
Q.INTRO["P"] = "This is a domestic travel declaration case."


@register(whole_story_sql("P"))
def preset_stories(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", F.concat(F.lit("State "), "o_orderstatus").alias("org:role"),
        F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("DESK "), (F.col("o_orderkey") % 5).cast("string"))).alias("org:resource"))
    log = event_log(raw, "BPIC2020D", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return case_stories(log, presets.narratives()).select("case_id", "text")


@register("SELECT doc_id, CAST(coalesce(strlen(text), 0) AS INT) AS n_tokens FROM documents")
def batch_token_counts(spark, sf):
    """A tokeniser of batches, here one token per byte, over whole texts.

    A batch of whole texts and their ids is held several times over, so it has few rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    encode = CP.batch_tokenizer(lambda texts: [list((t or "").encode()) for t in texts])
    return CP.token_counts(table(spark, sf, "documents"), tokenizer=encode).select("doc_id", "n_tokens")


@register("""SELECT source, rank, count(*) AS n_rows, true AS within FROM documents,
 (VALUES (0.5::DOUBLE), (0.9), (0.95), (0.99)) v(rank) WHERE text IS NOT NULL GROUP BY 1, 2""")
def length_quantiles(spark, sf):
    """Sketched quantiles of all texts' lengths by source, each held against the exact ranks of all rows."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    told = CP.length_quantiles(docs, ["source"])
    exact = CP.token_counts(docs).select(F.col("source").alias("s"), "n_tokens")
    near = exact.join(told, F.col("s").eqNullSafe(F.col("source"))).groupBy("source", "rank", "n_rows").agg(
        F.avg((F.col("n_tokens") < F.col("length")).cast("int")).alias("below"), F.avg((F.col("n_tokens") <= F.col("length")).cast("int")).alias("upto"))
    return near.select("source", "rank", "n_rows", ((F.col("below") <= F.col("rank") + 0.01) & (F.col("upto") >= F.col("rank") - 0.01)).alias("within"))


# ---- roles of a rule by other spellings ------------------------------------

@register(ORACLES["label_flag_or_duration"])
def label_by_flag_column(spark, sf):
    """The flag is found though its column has another case and a longer name."""
    log = order_log(spark, sf).withColumnRenamed("in_time", "Was it IN_TIME?")
    return OUT.case_outcomes(log, {"orders": OUT.FlagOrDuration("in time", flag="in_time", completed=["2-high"], days=1800)})


@register("SELECT ts IS NULL AS untimed, count(*) AS n_rows FROM events GROUP BY 1")
def column_by_keywords(spark, sf):
    """The column that holds all words of its role, in any case and order; the other bears one of them only."""
    raw = table(spark, sf, "events").select(F.col("event_id").alias("event time id"), F.col("ts").alias("Stamp of TIME"))
    found = find_keyword_column(raw.columns, ["time", "stamp"])
    return raw.groupBy(F.col(f"`{found}`").isNull().alias("untimed")).agg(F.count("*").alias("n_rows"))
