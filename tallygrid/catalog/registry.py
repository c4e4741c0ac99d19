"""Query registry and the derived tables several queries share (in Spark and in SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.sources.files import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent over the same tables."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(df: DataFrame, **places: int) -> DataFrame:
    """Round the named double columns, since addition order differs between engines; no negative zero."""
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in places.items()})


def purchases(spark: SparkSession, d: str) -> DataFrame:
    """One row per item bought: brand, type, quantity and spend."""
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    items = load(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


SQL_PURCHASES = "purchases AS (SELECT p_brand, p_type, p_size, p_retailprice, l_quantity, l_extendedprice, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey)"


def regional_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with nation, region and year."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = load(spark, d, "nation")
    region = load(spark, d, "region")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", "o_custkey", "o_totalprice", "n_name", "r_name", F.year("o_orderdate").alias("year"))
    )


SQL_REGIONAL = """regional AS (
  SELECT o_orderkey, o_custkey, o_totalprice, n_name, r_name, CAST(year(o_orderdate) AS INTEGER) AS year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def nation_panel(spark: SparkSession, d: str) -> DataFrame:
    """Nation × year: x = mean discount of the items, y = log of the order total."""
    items = load(spark, d, "lineitem").select("l_orderkey", "l_discount")
    per_order = items.groupBy("l_orderkey").agg(F.sum("l_discount").alias("disc"), F.count(F.lit(1)).alias("items"))
    orders = regional_orders(spark, d)
    joined = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("n_name", "year").agg(
        (F.sum("disc") / F.sum("items")).alias("x"), F.log(F.sum("o_totalprice")).alias("y")
    )


SQL_PANEL = f"""{SQL_REGIONAL},
per_order AS (SELECT l_orderkey, sum(l_discount) AS disc, count(*) AS items FROM lineitem GROUP BY 1),
panel AS (
  SELECT n_name, year, sum(disc) / sum(items) AS x, ln(sum(o_totalprice)) AS y
  FROM regional JOIN per_order ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


def scored_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a 0/1 label, a score on thousandths (many ties) and a predicted class."""
    o = load(spark, d, "orders")
    spread = (F.col("o_orderkey") * 7919 % 1000) / F.lit(1000.0)
    level = F.least(F.col("o_totalprice") / F.lit(400000.0), F.lit(1.0))
    status = F.when(F.col("o_orderstatus") == "F", 0.15).otherwise(0.0)
    prob = F.floor(F.lit(1000.0) * (F.lit(0.5) * spread + F.lit(0.3) * level + status)) / F.lit(1000.0)
    return o.select(
        "o_orderkey",
        "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        prob.alias("prob"),
    ).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


SQL_SCORED = """scored0 AS (
  SELECT o_orderkey, o_orderpriority, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
    floor(1000.0::DOUBLE * (0.5::DOUBLE * ((o_orderkey * 7919 % 1000) / 1000.0::DOUBLE)
      + 0.3::DOUBLE * least(o_totalprice / 400000.0::DOUBLE, 1.0::DOUBLE)
      + CASE WHEN o_orderstatus = 'F' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)) / 1000.0::DOUBLE AS prob
  FROM orders),
scored AS (SELECT *, CAST(prob >= 0.5::DOUBLE AS INTEGER) AS pred FROM scored0)"""


def customer_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer with orders: balance, counts, spend and a churn label."""
    orders = load(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_orders"),
        F.sum("o_totalprice").alias("spend"),
        F.max("o_orderdate").alias("last"),
    )
    c = load(spark, d, "customer")
    return c.join(orders, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey",
        "c_nationkey",
        "c_mktsegment",
        F.col("c_acctbal").alias("acctbal"),
        "n_orders",
        "spend",
        F.log("spend").alias("log_spend"),
        (F.col("last") < F.lit("2001-01-01").cast("timestamp")).cast("int").alias("y"),
    )


SQL_CUSTOMERS = """per_cust AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend, max(o_orderdate) AS last FROM orders GROUP BY 1),
cust AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal AS acctbal, n_orders, spend, ln(spend) AS log_spend,
    CAST(last < TIMESTAMP '2001-01-01' AS INTEGER) AS y
  FROM customer JOIN per_cust ON c_custkey = o_custkey)"""


def coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Customers with made coordinates (latitudes past a pole for one part in 180) and their nation's point."""
    c = load(spark, d, "customer")
    n = load(spark, d, "nation")

    def lat(k: Column) -> Column:
        return (k * 37 % 18099) / F.lit(100.0) - F.lit(89.99)

    def lon(k: Column) -> Column:
        return (k * 91 % 35999) / F.lit(100.0) - F.lit(179.99)

    key = F.col("n_nationkey").cast("bigint") * 4001 + 17
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        lat(F.col("c_custkey") * 101).alias("lat_a"),
        lon(F.col("c_custkey") * 101).alias("lon_a"),
        ((key * 37 % 17999) / F.lit(100.0) - F.lit(89.99)).alias("lat_b"),
        lon(key).alias("lon_b"),
    )


SQL_COORDS = """coords AS (
  SELECT c_custkey,
    (c_custkey * 101 * 37 % 18099) / 100.0::DOUBLE - 89.99::DOUBLE AS lat_a,
    (c_custkey * 101 * 91 % 35999) / 100.0::DOUBLE - 179.99::DOUBLE AS lon_a,
    ((n_nationkey::BIGINT * 4001 + 17) * 37 % 17999) / 100.0::DOUBLE - 89.99::DOUBLE AS lat_b,
    ((n_nationkey::BIGINT * 4001 + 17) * 91 % 35999) / 100.0::DOUBLE - 179.99::DOUBLE AS lon_b
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
