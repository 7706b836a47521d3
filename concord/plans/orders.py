"""Orders as JSON records in several styles, and the schema they are aligned to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.convert import Target
from concord.plans.registry import table

ORDER_FIELDS = [
    Target("orderId", ["integer"], True),
    Target("customerName", ["string"], True),
    Target("totalPrice", ["number"], minimum=0),
    Target("orderStatus", ["string"], enum=["F", "O", "P"]),
    Target("orderDate", ["string"], format="date"),
    Target("tags", ["array"]),
]


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON in three styles: golden names, renamed, nested."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day, tags = F.date_format("o_orderdate", "yyyy-MM-dd"), F.split("o_orderpriority", "-")
    o = o.select("o_orderkey", "c_name", "o_totalprice", "o_orderstatus", day.alias("day"), tags.alias("tags"), (F.col("o_orderkey") % 3).alias("style"))
    golden = F.to_json(F.struct(F.col("o_orderkey").alias("orderId"), F.col("c_name").alias("customerName"), F.col("o_totalprice").alias("totalPrice"), F.col("o_orderstatus").alias("orderStatus"), F.col("day").alias("orderDate"), "tags"))
    renamed = F.to_json(F.struct(F.col("o_orderkey").alias("order_id"), F.col("c_name").alias("customer_name"), F.col("o_totalprice").cast("string").alias("total_price"), F.col("o_orderstatus").alias("order_status"), F.date_format(F.to_date("day"), "yyyy/MM/dd").alias("order_date"), F.array_join("tags", ";").alias("tags")))
    nested = F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("orderId"), F.col("day").alias("orderDate"), F.col("o_orderstatus").alias("orderStatus")).alias("header"), F.struct(F.col("c_name").alias("customerName")).alias("party"), F.struct(F.col("o_totalprice").alias("totalPrice")).alias("sums"), "tags"))
    return o.select("o_orderkey", "style", F.when(F.col("style") == 0, golden).when(F.col("style") == 1, renamed).otherwise(nested).alias("record"))
