"""Program facts projected from the star-schema tables.

Each fact is a list of SQL expressions or a query that Spark and the oracle both understand, so
that one definition serves ``selectExpr`` and the oracle's common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.joins import dealt

METHODS = [
    "p_partkey AS method_id",
    "p_name AS name",
    "p_brand AS class",
    "p_type AS package",
    "p_size % 5 AS n_params",
    "CASE p_size % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' ELSE 'public' END AS visibility",
    "p_size % 2 = 0 AS is_static",
    "p_size % 7 <> 0 AS has_code",
]
METHODS_SQL = f"methods AS (SELECT {', '.join(METHODS)} FROM part)"

#: A call from a part to the next line of the same order.
CALLS_SQL = """calls AS (
  SELECT a, b, flag, status FROM (
    SELECT l_partkey AS a, l_returnflag AS flag, l_linestatus AS status,
           lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus, l_extendedprice, l_shipdate) AS b
    FROM lineitem)
  WHERE b IS NOT NULL AND a <> b)"""
EDGES_SQL = f"{CALLS_SQL}, edges AS (SELECT DISTINCT a, b FROM calls)"

#: Region, nation, and the suppliers and customers of a nation: a hierarchy of single inheritance.
TYPES_SQL = """types AS (
  SELECT 'Object' AS type, CAST(NULL AS VARCHAR(20)) AS super
  UNION ALL SELECT 'R' || r_regionkey, 'Object' FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer)"""

#: Declarations: every third method in a nation's class, the others in that of their first supplier.
DECLS = [
    "p_partkey AS method_id",
    "p_name AS name",
    "p_size % 7 <> 0 AS has_code",
    "CASE WHEN p_partkey % 3 = 0 OR first_supplier IS NULL THEN 'N' || (p_partkey % 25) ELSE 'S' || first_supplier END AS type",
]
DECLS_SQL = f"decls AS (SELECT {', '.join(DECLS)} FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS first_supplier FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"

#: A call site for each line: the supplier's class receives, the part's name is called.
SITES_SQL = "sites AS (SELECT l_orderkey * 10 + l_linenumber AS site, l_partkey AS callee, l_suppkey AS receiver FROM lineitem)"

#: The body of a method is the ordered events of a user.
BODY = [
    "user_id AS method_id",
    "event_id AS pos",
    "event_type AS op",
    "event_id % 4 AS reg",
]
BODY_SQL = f"body AS (SELECT {', '.join(BODY)} FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*METHODS)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, flag, status): one row for each call."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("b", F.lead("l_partkey").over(order))
    return lines.selectExpr("l_partkey AS a", "b", "l_returnflag AS flag", "l_linestatus AS status").where("b IS NOT NULL AND a <> b")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("a", "b").distinct()


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, super): the root is ``Object``."""
    rows = spark.range(1).selectExpr("'Object' AS type", "CAST(NULL AS STRING) AS super")
    for name, own, above in (("region", "'R' || r_regionkey", "'Object'"), ("nation", "'N' || n_nationkey", "'R' || n_regionkey"), ("supplier", "'S' || s_suppkey", "'N' || s_nationkey"), ("customer", "'C' || c_custkey", "'N' || c_nationkey")):
        rows = rows.unionByName(table(spark, sf_dir, name).selectExpr(f"{own} AS type", f"{above} AS super"))
    return rows


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("first_supplier"))
    parts = table(spark, sf_dir, "part")
    return parts.join(first, parts["p_partkey"] == first["l_partkey"], "left").selectExpr(*DECLS)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, callee, receiver): one row for each line."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS site", "l_partkey AS callee", "l_suppkey AS receiver")


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*BODY)
