"""K-d tree sharding: recursive weighted medians along the widest metadata dimension."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.llm.common import full_text, groups_for
from tracewright.scale import broadcast_if_small, checkpoint

BINS = 1 << 16  # of a node's histogram in one round
HEAVY = 256  # a unit above this part of its node is placed by itself
SLOTS = 65_536  # rows numbered in one task, on average
HASHES = 1 << 31


def default_dimensions(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """Whole numbers that describe a document: length, language, source and id."""
    found = {"n_chars": F.char_length(full_text(docs[text_col])).cast("long")}
    for name in ("lang", "source"):
        if name in docs.columns:
            found[name] = F.crc32(F.coalesce(docs[name].cast("string"), F.lit("")))
    return found


def _split(units: DataFrame, dims: list[str], plan: list[tuple[int, int]], spans: Mapping[str, int]) -> DataFrame:
    """One level: units of each node of ``plan`` (node, leaves) get ``side`` 0 or 1."""
    spark = units.sparkSession
    leaves = dict(plan)
    ranges = [f(d).alias(f"{n}_{d}") for d in [*dims, "h"] for n, f in (("min", F.min), ("max", F.max))]
    nodes = units.groupBy("node").agg(F.sum("w").alias("total"), *ranges).collect()  # one row per node
    todo = [r for r in nodes if leaves.get(r["node"], 1) > 1]
    if not todo:
        return units.withColumn("side", F.lit(0))
    goal = {r["node"]: r["total"] * (leaves[r["node"]] // 2) / leaves[r["node"]] for r in todo}
    # Units that are large for their node, at most HEAVY in each: largest first to the side that lacks most.
    bounds = spark.createDataFrame(
        [(r["node"], r["total"] // HEAVY, float(goal[r["node"]]), float(r["total"] - goal[r["node"]])) for r in todo],
        "node long, most long, room_0 double, room_1 double")
    sized = units.join(F.broadcast(bounds), "node")
    heavy = sized.where("w > most").select("node", "unit", "w", "room_0", "room_1")
    placed = checkpoint(heavy.groupBy("node").applyInPandas(_place, "node long, unit string, w long, placed int"))
    left = dict.fromkeys(goal, 0) | {
        r["node"]: r["w"] for r in placed.where("placed = 0").groupBy("node").agg(F.sum("w").alias("w")).collect()}
    light = sized.where("w <= most")

    # For each node: the dimension, the range looked at, and the weight still to find in it.
    state = {}
    for r in todo:
        widest = max(dims, key=lambda d: ((r[f"max_{d}"] - r[f"min_{d}"]) / max(1, spans[d]), -dims.index(d)))
        state[r["node"]] = [widest, r[f"min_{widest}"], r[f"max_{widest}"], None, 0, HASHES - 1, goal[r["node"]] - left[r["node"]]]
    while open_ := {n: s for n, s in state.items() if s[1] < s[2] or s[4] < s[5]}:
        rows = [(n, s[0], s[1], s[2], s[4] if s[1] == s[2] else None, s[5]) for n, s in open_.items()]
        asked = spark.createDataFrame(rows, "node long, dim string, low long, high long, h_low long, h_high long")
        x = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in dims])
        seen = light.join(F.broadcast(asked), "node").withColumn("x", x).where("x BETWEEN low AND high")
        seen = seen.where("h_low IS NULL OR h BETWEEN h_low AND h_high")
        value = F.when(F.col("h_low").isNull(), F.col("x") - F.col("low")).otherwise(F.col("h") - F.col("h_low"))
        span = F.when(F.col("h_low").isNull(), F.col("high") - F.col("low")).otherwise(F.col("h_high") - F.col("h_low")) + 1
        width = F.ceil(span / F.lit(BINS))
        sums = seen.groupBy("node", F.floor(value / width).alias("bin")).agg(F.sum("w").alias("w"))
        up = W.partitionBy("node").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("w").over(up))
        wanted = spark.createDataFrame([(n, float(s[6])) for n, s in open_.items()], "node long, want double")
        # The first bin whose end is beyond the weight wanted; past all bins there is none.
        hit = sums.join(F.broadcast(wanted), "node").where("upto >= want").groupBy("node").agg(
            F.min(F.struct("bin", "upto", "w")).alias("b"))
        found = {r["node"]: r["b"] for r in hit.collect()}
        for n, s in open_.items():
            by_hash = s[1] == s[2]
            low, high = (s[4], s[5]) if by_hash else (s[1], s[2])
            if n not in found:  # all of the range goes left
                s[1:3], s[4], s[5] = ([s[2], s[2]] if not by_hash else s[1:3]), HASHES - 1, HASHES - 1
                continue
            b, step = found[n], -(-(high - low + 1) // BINS)
            start = low + b["bin"] * step
            end = min(high, start + step - 1)
            s[6] -= b["upto"] - b["w"]
            if by_hash:
                s[4], s[5] = start, end
                if start == end and s[6] < b["w"] / 2:
                    s[4] = s[5] = start - 1  # nearer without this unit
            else:
                s[1], s[2] = start, end
    cuts = spark.createDataFrame([(n, s[0], s[1], s[4]) for n, s in state.items()], "node long, dim string, at long, h_at long")
    x = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in dims])
    cut = units.join(F.broadcast(cuts), "node", "left")
    side = F.when(F.col("dim").isNull(), 0).when((x < F.col("at")) | ((x == F.col("at")) & (F.col("h") <= F.col("h_at"))), 0)
    side = side.otherwise(1)
    whole = broadcast_if_small(placed.select(F.col("unit").alias("whole"), "placed"))
    cut = cut.join(whole, F.col("unit") == F.col("whole"), "left")
    return cut.select(*units.columns, F.coalesce("placed", side).alias("side"))


def _place(rows: pd.DataFrame) -> pd.DataFrame:
    """Sides of the large units of one node, fewer than ``HEAVY``."""
    rows = rows.sort_values(["w", "unit"], ascending=[False, True])
    room, sides = [rows["room_0"].iat[0], rows["room_1"].iat[0]], []
    for w in rows["w"]:
        sides.append(int(room[1] > room[0]))
        room[sides[-1]] -= w
    return rows[["node", "unit", "w"]].assign(placed=sides)


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    dimensions: Mapping[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row; shards have near equal bytes.

    The number of leaves is ``shards``, or as many as bring leaves to
    ``target_bytes``. A node is split along the dimension in which its units spread
    widest (against the spread of all), at the weighted median that a few rounds of
    histograms find; ties are cut by a hash. Units are groups of equal texts, so
    copies share a shard; only a group above a leaf's bytes is divided, by id. Units
    above 1/256 of their node are few and are placed one by one, so the halves of a
    node differ by less than that.

    Size is the UTF-8 bytes of the text plus one; null text counts as empty. Null
    metadata count as empty text. Repeated rows are rows, each with a slot. Slots are
    gapless from 0 in each shard. An empty table gives no rows. The driver sees a few
    numbers per node, whatever the data, and broadcasts them; large units and groups
    stay on the executors, and are broadcast only where they are measured to be small.
    """
    text = full_text(docs[text_col])
    dims = dict(default_dimensions(docs, text_col) if dimensions is None else dimensions)
    names = [f"dim_{i}" for i in range(len(dims))]
    rows = checkpoint(docs.select(
        docs[id_col].alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("text_md5"), F.pmod(F.xxhash64(docs[id_col]), F.lit(64)).alias("deal"),
        *[c.alias(n) for n, c in zip(names, dims.values())],
    ))
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return _numbered(rows.withColumn("shard", F.lit(0)), 1)
    if shards is None:
        shards = max(1, -(-total // (target_bytes or total)))
    # Groups above a leaf are dealt to 64 parts by id; there are fewer than ``shards`` of them.
    sizes = rows.groupBy("text_md5").agg(F.sum("size").alias("w"), *[F.min(d).alias(d) for d in names])
    giant = broadcast_if_small(checkpoint(sizes.where(F.col("w") > total / shards).select(F.col("text_md5").alias("giant"))))
    rows = rows.join(giant, F.col("text_md5") == F.col("giant"), "left").withColumn(
        "unit", F.concat_ws("-", "text_md5", F.when(F.col("giant").isNotNull(), F.col("deal")))).drop("giant")
    units = rows.groupBy("unit").agg(F.sum("size").alias("w"), *[F.min(d).alias(d) for d in names])
    units = checkpoint(units.withColumns({"h": F.pmod(F.xxhash64("unit"), F.lit(HASHES)), "node": F.lit(0).cast("long")}))
    limits = units.agg(*[f(d).alias(f"{k}_{d}") for d in names for k, f in (("min", F.min), ("max", F.max))]).first()
    spans = {d: limits[f"max_{d}"] - limits[f"min_{d}"] for d in names}
    plan = {0: (0, shards)}  # node: first leaf, leaves
    while any(k > 1 for _, k in plan.values()):
        split = _split(units, names, [(node, k) for node, (_, k) in plan.items()], spans)
        units = checkpoint(split.select(
            *[c for c in units.columns if c != "node"], (F.col("node") * 2 + F.col("side")).alias("node")))
        grown = {}
        for node, (first, k) in plan.items():
            if k == 1:
                grown[2 * node] = (first, 1)
            else:
                grown[2 * node], grown[2 * node + 1] = (first, k // 2), (first + k // 2, k - k // 2)
        plan = grown
    leaf = docs.sparkSession.createDataFrame([(node, first) for node, (first, _) in plan.items()], "node long, shard int")
    placed = units.join(F.broadcast(leaf), "node").select(F.col("unit").alias("of_unit"), "shard")
    return _numbered(rows.join(placed, F.col("unit") == F.col("of_unit")), groups_for(n, SLOTS * shards))


def _numbered(rows: DataFrame, ranges: int) -> DataFrame:
    """Adds ``slot``: a number within the shard, counted in ranges of hashed ids."""
    rows = rows.select("id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(ranges)).alias("range"))
    if ranges > 1:
        rows = checkpoint(rows)
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "range").orderBy("id", "text_crc32")
    ranked = rows.withColumn("in_range", F.row_number().over(inside) - 1)
    return ranked.join(broadcast_if_small(starts), ["shard", "range"]).select(
        "id", "size", "text_crc32", "shard", (F.col("start") + F.col("in_range")).cast("long").alias("slot"))
