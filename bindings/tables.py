"""Readers of the driver tables and the ledger view of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For work that is heavy per row: a file of one split still uses every core."""
    return spread(table(spark, sf_dir, name))


# Lines of the ledger have no published order; this total order of their columns stands in.
LEDGER_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax"]

# Quantity 5..: signed by the return flag; two unit prices; one account per supplier.
LEDGER_SQL = """
ledger AS (
  SELECT (CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(l_orderkey AS VARCHAR) AS "Invoice",
         p_brand AS "StockCode",
         CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS "Quantity",
         l_shipdate AS "InvoiceDate",
         1 + 0.5 * (l_linenumber % 2) AS "Price",
         l_suppkey AS customer_id,
         l_returnflag = 'R' AS is_credit,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    returned = F.col("l_returnflag") == "R"
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.when(returned, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias(
            "Invoice"
        ),
        F.col("p_brand").alias("StockCode"),
        F.when(returned, -F.col("l_quantity"))
        .otherwise(F.col("l_quantity"))
        .cast("long")
        .alias("Quantity"),
        F.col("l_shipdate").alias("InvoiceDate"),
        (1 + 0.5 * (F.col("l_linenumber") % 2)).alias("Price"),
        F.col("l_suppkey").alias("customer_id"),
        returned.alias("is_credit"),
        *LEDGER_ORDER,
    )
