"""Size checks, checkpoints and ranking helpers that survive a hot key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# A side is broadcast only when measured to be at most this large.
BROADCAST_ROWS = 50_000
LOCAL_ROWS = 1_000
LOCAL_WIDTH = 64 << 10  # bytes of a row
BROADCAST_BYTES = 64 << 20
# Below this limit Spark's window group limit prunes before the shuffle.
GROUP_LIMIT = 1_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the checkpoint folder and read it.

    Unlike ``DataFrame.checkpoint`` the copy is columnar, so readers prune
    columns and the optimizer knows its size. It survives lost executors.
    """
    path = f"{_checkpoint_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    return f"{_checkpoint_folder(spark.range(0))}/{uuid.uuid4().hex}"


def _checkpoint_folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tracewright-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int | None = None
) -> DataFrame:
    """Ship an aggregated side as a broadcast when it is measured to be small.

    A very small side is held as local rows, so it is computed once; rows wider than
    ``LOCAL_WIDTH`` don't reach the driver. Otherwise one job counts rows and bytes,
    of ``max_rows + 1`` rows at most. A large side is returned unhinted: Spark
    shuffles the join and AQE splits its hot keys.
    """
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    row = F.struct(*df.columns)
    sized = df.select(row.alias("row"), F.octet_length(F.to_json(row)).cast("long").alias("bytes"))
    narrow = F.when(F.col("bytes") <= LOCAL_WIDTH, F.col("row"))
    rows = sized.limit(LOCAL_ROWS + 1).select(narrow.alias("row"), "bytes").collect()
    if sum(r["bytes"] for r in rows) > limit:
        return df
    if len(rows) <= LOCAL_ROWS and all(r["row"] is not None for r in rows):
        return F.broadcast(df.sparkSession.createDataFrame([r["row"] for r in rows], df.schema))
    n, size = sized.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= limit else df


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = 64,
    rank: str = "rank_in_group",
) -> DataFrame:
    """First k rows of each group with their rank; ``order`` must be total.

    For small k Spark prunes map-side. Otherwise each group is first ranked in
    salted parts, so no task sees more than a part of a hot group, and then the
    at most k rows per part are ranked together.
    """
    if k > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        w = W.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= k)
            .drop("_part", "_r")
        )
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def rank_by_hash(
    df: DataFrame, keys: Sequence[str], hash_col: str, tie: Sequence[str] = (),
    rank: str = "hash_rank", total: str = "group_size", digits: int = 3,
) -> DataFrame:
    """Exact rank of every row in its group by an md5 hex column, plus group size.

    A group is cut into 16**digits equal hash ranges; rows are ranked inside
    their range and the sizes of the lower ranges are added. So a group holding
    most rows spreads over thousands of tasks, as does a rank without keys.
    """
    keys = list(keys)
    cut = df.withColumn("_range", F.substring(hash_col, 1, digits))
    sizes = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*(keys or [F.lit(0)]))
    below = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys, "_range",
        F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"),
        F.sum("_n").over(whole).alias(total),
    )
    inside = W.partitionBy(*keys, "_range").orderBy(hash_col, *tie)
    return (
        cut.withColumn("_r", F.row_number().over(inside))
        .join(sizes, [*keys, "_range"])
        .withColumn(rank, F.col("_below") + F.col("_r"))
        .drop("_range", "_r", "_below")
    )


