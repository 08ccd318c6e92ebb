"""De-duplication, caps, balanced sampling and splits, in reproducible hash order.

No step ranks an unbounded group in one task: small limits are pruned map-side,
others go through salted parts or hash ranges, and the cut of a round-robin is
computed from counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.functions.structs import record
from tracewright.functions.text import hash_order
from tracewright.scale import broadcast_if_small, checkpoint, rank_by_hash, top_per_group
from tracewright.schema import CASE

# Rows sorted to find a border, at most, but for rows of one hash.
_BORDER_ROWS = 10_000


def dedup_text(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("dataset",), text: str = "text"
) -> DataFrame:
    """One row per exact text within the keys: the first in ``order``.

    Copies are pruned before the shuffle, so a text that fills a third of the
    rows arrives as one row per task.
    """
    keyed = df.withColumn("_digest", F.sha2(text, 256))
    return top_per_group(keyed, [*keys, "_digest", text], order, 1, rank="_rank").drop(
        "_digest", "_rank"
    )


def segment_preference(seed: int) -> list[Column]:
    """Full stories first, then longer, earlier, and later-ending ones; ties by hash."""
    return [
        F.desc(F.col("slice_type") == "full"), F.desc("n_events"), F.asc("slice_start"),
        F.desc("slice_end"),
        hash_order(seed, "segment", F.col("dataset"), F.col("case_id"), F.col("slice_id")).asc(),
        F.asc("case_id"), F.asc("slice_id"),
    ]


def variant_topk(
    df: DataFrame, k: int, order: Sequence[Column], variant: str = "variant_key",
    keys: Sequence[str] = ("dataset",),
) -> DataFrame:
    """At most k rows per variant; k <= 0 keeps all."""
    if k <= 0:
        return df
    return top_per_group(df, [*keys, variant], order, k, rank="variant_rank").drop("variant_rank")


def round_robin_cut(
    counts: DataFrame, keys: Sequence[str], target: Column
) -> DataFrame:
    """Where a round-robin over members stops: ``keys, n_rows, cut_round, n_in_cut``.

    ``counts`` has one row per member of a group with its number of rows ``n``;
    ``target`` may use columns of the keys. Rounds below ``cut_round`` are taken
    whole, and ``n_in_cut`` rows of that round. Groups within the target get no cut.
    """
    keys = list(keys)
    sizes = counts.groupBy(*keys, "n").agg(F.count("*").alias("members"))
    whole = W.partitionBy(*keys)
    below = whole.orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    onward = whole.orderBy("n").rowsBetween(W.currentRow, W.unboundedFollowing)
    steps = sizes.select(
        *keys, "n",
        F.coalesce(F.lag("n").over(whole.orderBy("n")), F.lit(0)).alias("previous"),
        F.coalesce(F.sum(F.col("n") * F.col("members")).over(below), F.lit(0)).alias("done"),
        F.sum("members").over(onward).alias("active"),
        F.sum(F.col("n") * F.col("members")).over(whole).alias("n_rows"),
    ).withColumns({
        "_target": target.cast("long"),
        # rows taken once all rounds up to ``previous`` / ``n`` are complete
        "_before": F.col("done") + F.col("previous") * F.col("active"),
        "_after": F.col("done") + F.col("n") * F.col("active"),
    })
    left = F.col("_target") - F.col("_before")
    full_rounds = F.floor((left - 1) / F.col("active"))
    return (
        steps.where("n_rows > _target and _before < _target and _after >= _target")
        .select(
            *keys, "n_rows",
            (F.col("previous") + full_rounds + 1).alias("cut_round"),
            (left - full_rounds * F.col("active")).alias("n_in_cut"),
        )
    )


def group_borders(
    rows: DataFrame, keys: Sequence[str], wanted: str, hashed: str, tie: str, digits: Sequence[int] = (4,)
) -> DataFrame:
    """Per group the place (struct h, m) of its row number ``wanted`` by a hex hash, then ``tie``.

    Histograms of hash prefixes hold all groups at once: each finds the bin in which a
    group's border lies, and the next one looks only at the rows of those bins. What is
    left to sort is a 65,536th of a group, in two columns. Groups with fewer rows have no border.
    """
    keys = list(keys)
    left = rows.select(*keys, F.col(wanted).alias("_left"), F.col(hashed).alias("h"), F.col(tie).alias("m"))
    for width in digits:
        prefix = F.substring("h", 1, width)
        bins = left.groupBy(*keys, "_left", prefix.alias("_bin")).agg(F.count("*").alias("_n"))
        earlier = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("_below", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        hit = bins.where("_below < _left and _below + _n >= _left").select(
            *keys, "_bin", (F.col("_left") - F.col("_below")).alias("_rest"))
        left = left.withColumn("_bin", prefix).join(hit, [*keys, "_bin"]).select(*keys, F.col("_rest").alias("_left"), "h", "m")
    place = F.row_number().over(W.partitionBy(*keys).orderBy("h", "m"))
    return left.withColumn("_place", place).where("_place = _left").select(*keys, F.struct("h", "m").alias("_border"))


def balanced_sample(
    df: DataFrame, n: int | None, k: int, member: str, order: Sequence[Column],
    round_hash: Column, keys: Sequence[str] = ("dataset",), targets: DataFrame | None = None,
) -> DataFrame:
    """Round-robin over members until n rows per group, at most k per member.

    A group of at most n rows is kept, up to k per member. Otherwise each round
    takes one row of every member left, in ``order`` inside a member and in
    ``round_hash`` order (of columns of the keys and the member) inside the last,
    incomplete round. ``targets`` gives n per group (columns: keys, ``target``) and
    takes the place of ``n``. Where the last round ends is found from the members'
    counts alone; rows are ranked once, in their member, and then only filtered.
    """
    keys = list(keys)
    if n is None and targets is None:
        return variant_topk(df, k, order, member, keys)
    limit = n if targets is None else targets.agg(F.max("target")).first()[0]
    if limit is None or limit <= 0:
        return variant_topk(df, k, order, member, keys)
    per_member = df.groupBy(*keys, member).agg(F.count("*").alias("all_rows"))
    if targets is None:
        per_member = per_member.withColumn("target", F.lit(n))
    else:
        per_member = per_member.join(broadcast_if_small(targets), keys)
    capped = F.least("all_rows", F.lit(k)) if k > 0 else F.col("all_rows")
    # One narrow row per member, counted once; all that follows reads it.
    counts = checkpoint(per_member.withColumn("n", F.least(capped, "target")))
    # Whether a group is sampled at all depends on its rows before the cap per member.
    totals = counts.groupBy(*keys, "target").agg(F.sum("all_rows").alias("group_rows"))
    cut = round_robin_cut(counts, [*keys, "target"], F.col("target")).drop("n_rows")
    active = counts.join(cut, [*keys, "target"]).where("n >= cut_round").withColumn("_hash", round_hash)
    borders = group_borders(active, keys, "n_in_cut", "_hash", member)
    # One row per group: a few counts and the border.
    plan = totals.join(cut, [*keys, "target"], "left").join(borders, keys, "left")
    plan = broadcast_if_small(plan.select(
        *keys, (F.col("group_rows") > F.col("target")).alias("_sampled"),
        F.when(F.col("group_rows") > F.col("target"), F.col("cut_round")).alias("_cut"), "_border",
    ))
    placed = df.join(plan, keys)
    if k > 0:
        whole = None
        ranked = top_per_group(placed, [*keys, member], order, k, rank="_round")
    else:
        whole = placed.where("not _sampled")
        ranked = top_per_group(
            placed.where("_sampled"), [*keys, member], order, limit, rank="_round"
        )
    inside = F.struct(round_hash.alias("h"), F.col(member).alias("m")) <= F.col("_border")
    out = ranked.where(F.expr("_cut is null or _round < _cut") | (F.expr("_round = _cut") & inside)).select(*df.columns)
    return out if whole is None else out.unionByName(whole.select(*df.columns))


def target_cap(counts: DataFrame, strategy: str = "fixed", target: int = 0) -> int | None:
    """Rows kept per dataset, from one row per dataset with its count ``n``."""
    if target and target > 0:
        return int(target)
    if strategy not in ("fixed", "min", "median", "none"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy in ("fixed", "none"):
        return None
    value = counts.agg(
        F.min("n") if strategy == "min" else F.percentile("n", F.lit(0.5))
    ).first()[0]
    return None if value is None else int(value)


# ---- cases -----------------------------------------------------------------

def cap_cases(cases: DataFrame, n: int, seed: int, variant: str = "variant_id") -> DataFrame:
    """At most n cases per dataset, round-robin over variants; n <= 0 keeps all."""
    if n <= 0:
        return cases
    key = hash_order(seed, "case", *[F.col(c) for c in CASE])
    return balanced_sample(
        cases, n, -1, variant, [key, F.col("case_id")],
        hash_order(seed, "round", F.col("dataset"), F.col(variant)),
    )


def split_variant_stratified(
    cases: DataFrame, ratio: float, seed: int, variant: str = "variant_id", smallest: int = 5
) -> DataFrame:
    """Add ``split``: the share ``ratio`` of each variant of at least 5 cases is validation.

    A dataset left without validation gives one case, its first in hash order.
    """
    return _stratified(cases, variant, ratio, seed, smallest, "validation", "case-split")


def split_label_stratified(
    cases: DataFrame, ratio: float, seed: int, label: str = "label"
) -> DataFrame:
    """Add ``split``: the share ``ratio`` of each label class is test; single cases train."""
    return _stratified(cases, label, ratio, seed, 2, "test", "label-split")


def _stratified(
    cases: DataFrame, stratum: str, ratio: float, seed: int, smallest: int, held: str, purpose: str
) -> DataFrame:
    if ratio <= 0:
        return cases.withColumn("split", F.lit("train"))
    hashed = cases.withColumn("_hash", hash_order(seed, purpose, *[F.col(c) for c in CASE]))
    ranked = rank_by_hash(hashed, ["dataset", stratum], "_hash", tie=["case_id"])
    size = F.col("group_size")
    wanted = F.least(F.greatest(F.bround(size * F.lit(ratio)).cast("long"), F.lit(1)), size - 1)
    held_out = (size >= smallest) & (F.col("hash_rank") <= wanted)
    marked = ranked.withColumn("_held", held_out)
    # Datasets with nothing held out give their first case, if they have two.
    # A stratum of ``smallest`` holds some out, so counts tell which; no rank is needed.
    lacking = hashed.groupBy("dataset", stratum).agg(
        F.count("*").alias("_n"), F.min(F.struct("_hash", "case_id")).alias("_first"),
    ).groupBy("dataset").agg(
        F.max("_n").alias("_largest"), F.sum("_n").alias("_cases"), F.min("_first").alias("_first"),
    ).where((F.col("_largest") < smallest) & (F.col("_cases") > 1)).select(
        "dataset", F.col("_first")["case_id"].alias("_moved"))
    return marked.join(broadcast_if_small(lacking), "dataset", "left").select(
        *cases.columns,
        F.when(F.col("_held") | (F.col("case_id") == F.coalesce("_moved", F.lit(None))), held)
        .otherwise("train").alias("split"),
    )


# ---- plain rows ------------------------------------------------------------

def first_by_hash(df: DataFrame, n: int, hashed: Column, key: Sequence[str]) -> Column:
    """Whether a row is among the first n by a hex hash, then by the key, then by a hash of the row.

    The border is found by histograms of hash prefixes over the key columns alone, a
    few thousand counts each; the rows themselves are only filtered, not shuffled.
    Rows of one key are told apart by their other columns; copies of one row are all taken
    or all left, so that the same rows are taken for any partitioning. Only counts
    reach the driver, one line for each distinct row at the border.
    """
    plain = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]
    content = F.xxhash64(*plain)
    narrow = df.select(hashed.alias("_hash"), *key, content.alias("_row"))
    prefix, left, held = "", n, None
    while n > 0 and (held is None or held > _BORDER_ROWS) and len(prefix) < 30:
        width = len(prefix) + 3
        bins = narrow.where(F.startswith("_hash", F.lit(prefix))).groupBy(
            F.substring("_hash", 1, width).alias("p")).count().orderBy("p").collect()
        for r in bins:
            if left <= r["count"]:
                prefix, held = r["p"], r["count"]
                break
            left -= r["count"]
        else:
            return F.lit(True)
    if n <= 0:
        return F.lit(False)
    near = narrow.where(F.startswith("_hash", F.lit(prefix)))
    if held > _BORDER_ROWS:  # one hash, so one key, with very many rows: a border by quantiles of their own hash
        low, high = -(1 << 63), (1 << 63) - 1
        while low < high:  # the least row hash up to which there are enough rows
            cuts = sorted({low + (high - low) * i // 256 for i in range(1, 256)} | {high})
            sums = near.agg(*[F.count(F.when(F.col("_row") <= F.lit(c), 1)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
            i = next(i for i, x in enumerate(sums) if x >= left)
            low, high = (cuts[i - 1] + 1 if i else low), cuts[i]
        border = {**near.first().asDict(), "_row": high}
    else:
        order = ["_hash", *key, "_row"]
        for r in near.groupBy(*order).count().orderBy(*order).collect():
            left -= r["count"]
            if left <= 0:
                break
        border = r.asDict()
    names = [*key, "_row"]
    types = {k: df.schema[k].dataType for k in key} | {"_row": "long"}
    place = F.struct(*[F.lit(border[k]).cast(types[k]).alias(k) for k in names])
    same = (hashed == border["_hash"]) & (F.struct(*key, content.alias("_row")) <= place)
    return (hashed < border["_hash"]) | same


def random_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """n rows in hash order of the key; the same rows for any partitioning."""
    return df.where(first_by_hash(df, n, hash_order(seed, "sample", *[F.col(c) for c in key]), key))


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First n rows by ``order``; a negative n keeps all."""
    return df if n < 0 else df.orderBy(*order).limit(n)


def holdout_split(
    df: DataFrame, ratio: float, seed: int, key: Sequence[str], held: str = "validation"
) -> DataFrame:
    """Add ``split``: ceil(ratio * rows) rows, in hash order, are held out."""
    if ratio <= 0:
        return df.withColumn("split", F.lit("train"))
    wanted = math.ceil(df.count() * ratio)
    first = first_by_hash(df, wanted, hash_order(seed, "holdout", *[F.col(c) for c in key]), key)
    return df.withColumn("split", F.when(first, held).otherwise("train"))


def shuffled(items: Column, seed: int, purpose: str, *key: Column) -> Column:
    """Array in a reproducible random order that depends on the key."""
    def tagged(x: Column) -> Column:
        return record(h=hash_order(seed, purpose, *key, x), x=x)

    return F.transform(F.sort_array(F.transform(items, tagged)), lambda s: s["x"])
