"""The same questions as plain SQL over the same tables (DuckDB dialect)."""

from __future__ import annotations

SEED = 3407

# ---- logs ------------------------------------------------------------------

E = """SELECT 'events' AS dataset, CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts,
 event_id AS in_order, value, CAST(nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '') AS BIGINT) AS k
 FROM events"""
L = """SELECT 'lineitem' AS dataset, CAST(l_orderkey AS VARCHAR) AS case_id,
 l_returnflag || '/' || l_linestatus AS activity, l_shipdate AS ts,
 l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS in_order, l_quantity,
 l_discount - 0.08::DOUBLE AS over_discount, l_extendedprice, l_returnflag FROM lineitem"""
O = """SELECT 'orders' AS dataset, CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity,
 o_orderdate AS ts, o_orderkey AS in_order, o_totalprice,
 CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS is_closed,
 CASE WHEN o_totalprice < 20000 THEN true WHEN o_totalprice > 480000 THEN false END AS in_time
 FROM orders"""
C = """SELECT 'conversations' AS dataset, CAST(conv_id AS VARCHAR) AS case_id, role AS activity,
 turn AS in_order, turn * 0.75::DOUBLE AS elapsed_time,
 CASE WHEN turn % 3 <> 0 THEN turn - 1.5::DOUBLE END AS interval_time FROM conversations"""
BASE = "dataset, case_id, activity, ts, in_order"
ALL = f"SELECT {BASE} FROM ({E}) UNION ALL SELECT {BASE} FROM ({L}) UNION ALL SELECT {BASE} FROM ({O})"


def query(select: str, **ctes: str) -> str:
    """WITH ctes in the given order."""
    if not ctes:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes.items()) + "\n" + select


def ordered(log: str, extra: str = "") -> str:
    """Order, trace length and time features."""
    return f"""SELECT *, row_number() OVER w - 1 AS seq, count(*) OVER c AS n,
 greatest(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / 864e2, 0), 0) AS interval_time,
 greatest(coalesce((epoch_us(ts) - epoch_us(min(ts) OVER c)) / 1e6 / 864e2, 0), 0) AS elapsed_time,
 min(in_order) OVER c AS case_order {extra} FROM ({log})
 WINDOW w AS (PARTITION BY dataset, case_id ORDER BY ts ASC NULLS LAST, in_order),
 c AS (PARTITION BY dataset, case_id)"""


def h(purpose: str, *cols: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', '{purpose}', {', '.join(cols)}))"


def value_text(x: str) -> str:
    return (f"CASE WHEN abs({x} - round({x})) < 1e-9 THEN CAST(CAST(round({x}) AS BIGINT) AS VARCHAR) "
            f"ELSE rtrim(rtrim(printf('%.2f', {x}), '0'), '.') END")


TAILS = {
    "E": f"'with value ' || {value_text('value')}",
    "L": f"'with quantity ' || {value_text('l_quantity')} || ' and flag ' || lower(l_returnflag)",
    "O": "NULL",
}
LOG = {"E": E, "L": L, "O": O}
INTRO = {
    "E": "This is a web user case.", "L": "This is an order shipping case.", "O": "This is a customer case.",
}


def told(log: str) -> str:
    """Ordered events with their sentences as first of a segment and later in it."""
    day = "CAST(floor(interval_time) AS BIGINT)"
    tail = (f"'\"' || activity || '\" on day ' || CAST(floor(elapsed_time) AS BIGINT) || "
            f"coalesce(', ' || {TAILS[log]}, '') || '.'")
    return f"""SELECT *, lower(activity) AS low_name,
 CASE WHEN seq = 0 THEN 'The case started with ' || {tail}
  WHEN {day} <= 0 THEN 'Later the same day in the case, the case resumed with ' || {tail}
  WHEN {day} = 1 THEN '1 day after the previous event, the case resumed with ' || {tail}
  ELSE {day} || ' days after the previous event, the case resumed with ' || {tail} END AS head,
 CASE WHEN {day} <= 0 THEN 'Later the same day, it went through ' || {tail}
  WHEN {day} = 1 THEN '1 day later, it went through ' || {tail}
  ELSE {day} || ' days later, it went through ' || {tail} END AS mid FROM ({ordered(LOG[log])})"""


def case_sentence(log: str, events: str, before: str = "") -> str:
    """Scalar subquery: the case sentence from events (alias x) before a position."""
    if log != "E":
        return f"'{INTRO[log]}'"
    return (f"'{INTRO[log]} At the case level, the first key is ' || "
            f"(SELECT arg_min(k, seq) FROM {events} x WHERE {before}) || ' and the first value is ' || "
            f"(SELECT {value_text('arg_min(value, seq)')} FROM {events} x WHERE {before}) || '.'")


# ---- segments --------------------------------------------------------------

def segments(cases: str) -> str:
    """Segments with default settings, by listing every start: cases has dataset, case_id, n."""
    def starts(s: int) -> str:
        return f"""SELECT dataset, case_id, n, {s} AS size, s AS a FROM {cases},
 unnest(range(0, n - {s} + 1, {s // 2})) AS t(s) WHERE n > 40 AND n > {s}
 UNION SELECT dataset, case_id, n, {s}, n - {s} FROM {cases} WHERE n > 40 AND n > {s}"""

    return f"""
 WITH w AS (SELECT *, row_number() OVER (PARTITION BY dataset, case_id ORDER BY size DESC, a) - 1 AS pos,
   count(*) OVER (PARTITION BY dataset, case_id) AS total
   FROM ({' UNION ALL '.join('SELECT * FROM (' + starts(s) + ')' for s in (32, 24, 16))})),
 kept AS (SELECT * FROM w WHERE total <= 20 OR pos IN
   (SELECT CASE WHEN i = 19 THEN total - 1 ELSE CAST(floor(i * ((total - 1) / 19.0::DOUBLE)) AS BIGINT) END
    FROM range(20) t(i)))
 SELECT dataset, case_id, row_number() OVER (PARTITION BY dataset, case_id ORDER BY pos) - 1
   + CASE WHEN n <= 64 THEN 1 ELSE 0 END AS slice_id, 'window_' || size AS slice_type,
   a AS slice_start, a + size AS slice_end, size AS n_events FROM kept
 UNION ALL SELECT dataset, case_id, 0, 'full', 0, n, n FROM {cases} WHERE n <= 64"""


def stories(log: str) -> dict[str, str]:
    """CTEs up to ``stories``: every segment with variant and text."""
    return {
        "told": told(log),
        "sizes": "SELECT dataset, case_id, max(n) AS n, min(case_order) AS case_order FROM told GROUP BY 1, 2",
        "segs": segments("sizes"),
        "intro": f"""SELECT dataset, case_id, {case_sentence(log, 'told', 'x.dataset = s.dataset AND x.case_id = s.case_id')}
  AS sentence FROM sizes s""" if log != "E" else f"""SELECT dataset, case_id,
  '{INTRO[log]} At the case level, the first key is ' || arg_min(k, seq) || ' and the first value is '
  || {value_text('arg_min(value, seq)')} || '.' AS sentence FROM told GROUP BY 1, 2""",
        "stories": """SELECT g.dataset, g.case_id, g.slice_id, g.slice_type, g.slice_start, g.slice_end, g.n_events,
  string_agg(t.low_name, ' || ' ORDER BY t.seq) AS variant_key,
  any_value(i.sentence) || ' ' || string_agg(CASE WHEN t.seq = g.slice_start THEN head ELSE mid END, ' ' ORDER BY t.seq) AS text,
  any_value(s.case_order) AS case_order
  FROM segs g JOIN told t ON t.dataset = g.dataset AND t.case_id = g.case_id
   AND t.seq >= g.slice_start AND t.seq < g.slice_end
  JOIN intro i ON i.dataset = g.dataset AND i.case_id = g.case_id
  JOIN sizes s ON s.dataset = g.dataset AND s.case_id = g.case_id
  GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7"),
    }


def balanced(src: str, member: str, order: str, round_hash: str, n: int, k: int) -> str:
    """Round-robin over members to n rows per dataset, at most k per member."""
    return f"""SELECT * FROM (
 SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round_no, {round_hash}, {member}) AS place
 FROM (SELECT *, row_number() OVER (PARTITION BY dataset, {member} ORDER BY {order}) AS round_no,
   count(*) OVER (PARTITION BY dataset) AS group_rows FROM {src})
 WHERE round_no <= {k if k > 0 else 10**9})
 WHERE group_rows <= {n} OR place <= {n}"""


# ---- cases and prefixes ----------------------------------------------------

def md5_part(at: int) -> str:
    return (f"sum(('0x' || substr(md5(concat_ws('|', CAST(seq AS VARCHAR), activity)), {at}, 15))"
            f"::BIGINT::HUGEINT)")


VARIANT_ID = f"concat_ws('-', CAST(count(*) AS VARCHAR), CAST({md5_part(1)} AS VARCHAR), CAST({md5_part(16)} AS VARCHAR))"
L_LABEL = "CASE WHEN max(activity = 'R/F') THEN 'success' ELSE 'failure' END"


def cases(log: str, label: str = L_LABEL) -> dict[str, str]:
    return {
        "ev": told(log),
        "cases": f"""SELECT dataset, case_id, count(*) AS trace_len, {VARIANT_ID} AS variant_id,
  string_agg(activity, ' || ' ORDER BY seq) AS variant, {label} AS label
  FROM ev GROUP BY 1, 2 HAVING count(*) >= 3""",
    }


def split(src: str, stratum: str, ratio: float, smallest: int, held: str, purpose: str) -> dict[str, str]:
    """CTE ``split_cases``: stratified split with the fix-up for empty parts."""
    return {
        "ranked": f"""SELECT *, {h(purpose, 'dataset', 'case_id')} AS hh,
  row_number() OVER (PARTITION BY dataset, {stratum} ORDER BY {h(purpose, 'dataset', 'case_id')}, case_id) AS rk,
  count(*) OVER (PARTITION BY dataset, {stratum}) AS sz FROM {src}""",
        "marked": f"""SELECT *, sz >= {smallest} AND
  rk <= least(greatest(CAST(round_even(sz * {ratio}::DOUBLE, 0) AS BIGINT), 1), sz - 1) AS is_held FROM ranked""",
        "split_cases": f"""SELECT * EXCLUDE (hh, rk, sz, is_held), CASE WHEN is_held OR (
   NOT bool_or(is_held) OVER (PARTITION BY dataset) AND count(*) OVER (PARTITION BY dataset) > 1
   AND row_number() OVER (PARTITION BY dataset ORDER BY hh, case_id) = 1) THEN '{held}' ELSE 'train' END AS split
  FROM marked""",
    }


RATIOS = (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9)


def plan(src: str, cap: int = 6) -> dict[str, str]:
    """CTE ``plan``: planned prefix lengths of each case."""
    anchors = ", ".join(
        f"least(greatest(CAST(round_even(trace_len * {r}::DOUBLE, 0) AS BIGINT), 2), trace_len - 1)" for r in RATIOS
    )
    return {
        "anchored": f"SELECT *, list_sort(list_distinct([2, trace_len - 1, {anchors}])) AS anchors FROM {src}",
        "thinned": f"""SELECT * EXCLUDE (anchors), CASE WHEN len(anchors) <= {cap} THEN anchors ELSE list_distinct(
  list_transform(range(0, {cap}), lambda i: anchors[CAST(round_even(i * (len(anchors) - 1) / {cap - 1}.0::DOUBLE, 0) AS BIGINT) + 1]))
  END AS chosen FROM anchored""",
        "lengths": f"""SELECT * EXCLUDE (chosen), CASE WHEN trace_len < 3 THEN [] WHEN trace_len - 2 <= {cap} THEN range(2, trace_len)
  ELSE list_concat(chosen, list_filter(list_transform(range(0, least(trace_len - 2, {2 * cap + len(RATIOS) + 3})),
    lambda t: 2 + (CAST('0x' || substr(md5(concat_ws('|', '{SEED}', 'prefix-walk', dataset, case_id)), 1, 7) AS BIGINT)
      + (2147483647 % (trace_len - 2)) * t) % (trace_len - 2)),
    lambda p: NOT list_contains(chosen, p))[1:{cap} - len(chosen)])
  END AS lens FROM thinned""",
        "plan": "SELECT * EXCLUDE (lens), unnest(lens) AS prefix_len FROM lengths",
    }


def examples(log: str, src: str = "plan", events: str = "ev", max_events: int = 40) -> dict[str, str]:
    """CTE ``ex``: story and targets of each prefix in ``src``."""
    sentence = f"'{INTRO[log]}'"
    if log == "E":
        sentence = (f"'{INTRO[log]} At the case level, the first key is ' || arg_min(t.k, t.seq) || ' and the first value is ' || "
                    + value_text("arg_min(t.value, t.seq)") + " || '.'")
    return {
        "ends": f"SELECT dataset, case_id, arg_max(elapsed_time, seq) AS last_elapsed FROM {events} GROUP BY 1, 2",
        "ex": f"""SELECT p.dataset, p.case_id, p.prefix_len, any_value(t.n) AS trace_len,
  round_even(p.prefix_len / greatest(any_value(t.n), 1)::DOUBLE, 4) AS prefix_ratio,
  greatest(p.prefix_len - {max_events}, 0) AS story_segment_start,
  least(p.prefix_len, {max_events}) AS story_n_events,
  {sentence} || ' ' || string_agg(CASE WHEN t.seq = greatest(p.prefix_len - {max_events}, 0) THEN t.head ELSE t.mid END, ' ' ORDER BY t.seq)
   FILTER (WHERE t.seq >= p.prefix_len - {max_events}) AS input_story,
  any_value(nx.activity) AS next_activity,
  CAST(floor(greatest(any_value(e.last_elapsed) - max(t.elapsed_time) FILTER (WHERE t.seq = p.prefix_len - 1), 0)) AS BIGINT) AS remaining_time_days
  FROM {src} p JOIN {events} t ON t.dataset = p.dataset AND t.case_id = p.case_id AND t.seq < p.prefix_len
  JOIN {events} nx ON nx.dataset = p.dataset AND nx.case_id = p.case_id AND nx.seq = p.prefix_len
  JOIN ends e ON e.dataset = p.dataset AND e.case_id = p.case_id
  GROUP BY p.dataset, p.case_id, p.prefix_len""",
    }


def shuffle_sql(items: str, purpose: str, *key: str) -> str:
    parts = ", ".join(key)
    return (f"list_transform(list_sort(list_transform({items}, lambda x: {{'h': md5(concat_ws('|', '{SEED}', '{purpose}', {parts}, x)), "
            f"'x': x}})), lambda s: s.x)")


def json_list(items: str) -> str:
    return f"'[\"' || array_to_string({items}, '\", \"') || '\"]'"
