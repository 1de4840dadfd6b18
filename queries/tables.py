"""The given tables in the roles of notices, attachments and analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices: mode, number, institution, business_type, title, day."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.when(F.col("o_orderstatus") == "P", "pre").otherwise("bid").alias("mode"),
            F.col("o_orderkey").alias("number"),
            F.col("n_name").alias("institution"),
            F.col("c_mktsegment").alias("business_type"),
            F.concat_ws(" ", "o_orderpriority", "c_name").alias("title"),
            F.to_date("o_orderdate").alias("day"),
            F.col("o_totalprice").alias("amount"),
        )
    )


NOTICES_SQL = """
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'pre' ELSE 'bid' END AS mode,
         o_orderkey AS number, n_name AS institution, c_mktsegment AS business_type,
         o_orderpriority || ' ' || c_name AS title, CAST(o_orderdate AS DATE) AS day,
         o_totalprice AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with part as attachments or items of a notice."""
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    return lineitem.join(part, lineitem.l_partkey == part.p_partkey)


# Whitespace set of the functions, in the spelling of the checking engine.
SQL_WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_normalise(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SQL_WS}+', ' ', 'g'), ' ')"
