"""Plain relational shapes over the star schema: aggregates, joins, anti-joins, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.sources.tables import table


def q_pricing(spark: SparkSession, folder: str) -> DataFrame:
    """Sums by return flag and line status."""
    line = table(spark, folder, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


def q_quiet_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without orders."""
    return table(spark, folder, "customer", "c_custkey", "c_nationkey").join(table(spark, folder, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def q_nation_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by nation of the supplier, ranked."""
    line = table(spark, folder, "lineitem", "l_suppkey", "l_extendedprice", "l_discount").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    s, n = table(spark, folder, "supplier", "s_suppkey", "s_nationkey"), table(spark, folder, "nation", "n_nationkey", "n_name")
    sums = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))
    return sums.withColumn("place", F.rank().over(Window.orderBy(F.col("revenue").desc())).cast("bigint"))


ORACLES = {
    "q_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "q_quiet_customers": "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "q_nation_revenue": "WITH s AS (SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) SELECT n_name, revenue, rank() OVER (ORDER BY revenue DESC) AS place FROM s",
}
_NAMED = (q_pricing, q_quiet_customers, q_nation_revenue)
QUERIES = {f.__name__: f for f in _NAMED}
