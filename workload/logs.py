"""Event-log views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.narrative import Field, Narrative
from tracewright.schema import event_log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: one case per user; attributes ``value`` and ``k``."""
    raw = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    ).drop("props")
    return event_log(raw, "events", "user_id", "event_type", "ts", "event_id").drop("event_id")


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: one case per order, events are its line items by ship date."""
    raw = table(spark, sf_dir, "lineitem").withColumns({
        "status": F.concat_ws("/", "l_returnflag", "l_linestatus"),
        # Line numbers repeat within an order; part and supplier make them unique.
        "line": F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * F.lit(10**5)
        + F.col("l_suppkey"),
        "over_discount": F.col("l_discount") - 0.08,
    })
    return event_log(raw, "lineitem", "l_orderkey", "status", "l_shipdate", "line").select(
        "dataset", "case_id", "activity", "ts", "in_order", "l_quantity", "over_discount",
        "l_extendedprice", "l_returnflag",
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O: one case per customer, events are its orders by date."""
    raw = table(spark, sf_dir, "orders").withColumns({
        "is_closed": F.when(F.col("o_orderstatus") == "F", "closed").when(
            F.col("o_orderstatus") == "P", "open"),
        "in_time": F.when(F.col("o_totalprice") < 20000, F.lit(" Yes ")).when(
            F.col("o_totalprice") > 480000, "0"),
    })
    return event_log(raw, "orders", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey").select(
        "dataset", "case_id", "activity", "ts", "in_order", "is_closed", "in_time", "o_totalprice"
    )


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: one case per conversation, without times; times are derived from turns."""
    raw = table(spark, sf_dir, "conversations").select(
        "conv_id", "role", "turn",
        (F.col("turn") * 0.75).alias("elapsed_time"),
        F.when(F.col("turn") % 3 != 0, F.col("turn") - 1.5).alias("interval_time"),
    )
    return event_log(raw, "conversations", "conv_id", "role", None, "turn").drop("turn")


# Texts of the views' stories.
NARRATIVES = {
    "events": Narrative(
        "This is a web user case.",
        [Field(["k"], "the first key is {value}"), Field(["value"], "the first value is {value}")],
        [Field(["value"], "value {value}")],
    ),
    "lineitem": Narrative(
        "This is an order shipping case.", [],
        [Field(["l_quantity"], "quantity {value}"), Field(["l_returnflag"], "flag {value}", lower=True)],
    ),
    "orders": Narrative("This is a customer case."),
}


def all_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E, L and O as one log of three datasets."""
    base = ["dataset", "case_id", "activity", "ts", "in_order"]
    logs = [f(spark, sf_dir).select(*base) for f in (user_log, item_log, order_log)]
    return logs[0].unionByName(logs[1]).unionByName(logs[2])
