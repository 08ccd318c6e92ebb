"""Places of rows in a sorted order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.llm.common import same
from tracewright.scale import broadcast_if_small, checkpoint

ROW_BITS = 33  # of the numbers that Spark gives to the rows of a partition


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 in their group, and ``n``, the rows of the group.

    Ascending, null first, text by its UTF-8 bytes; rows equal in ``order`` take any
    order. Rows are sorted by ranges of (group, order), so a hot group is spread; each
    range numbers its own rows, and the rows of a group in lower ranges are added,
    from one line for each group and range. Written once as a table. No column of ``rows``
    may be called pos, n, label or part.
    """
    group = list(group)
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    lined = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    lined = checkpoint(lined.withColumn("label", F.monotonically_increasing_id()))
    part = F.shiftright("label", ROW_BITS)
    runs = lined.groupBy(*group, part.alias("part")).agg(F.min("label").alias("first"), F.count("*").alias("rows"))
    whole = W.partitionBy(*(group or [F.lit(0)]))
    below = F.sum("rows").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select(
        *[F.col(g).alias(f"of_{g}") for g in group], "part", "first", F.coalesce(below, F.lit(0)).alias("below"),
        F.sum("rows").over(whole).alias("n"))
    runs = broadcast_if_small(runs)
    renamed = lined.withColumns({f"of_{g}": F.col(g) for g in group}).withColumn("part", part)
    met = renamed.join(runs, same(renamed, runs, ["part", *[f"of_{g}" for g in group]]))
    return met.select(*rows.columns, (F.col("label") - F.col("first") + F.col("below")).alias("pos"), "n")
