"""Engine views of the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import CONFIDENCES, SEVERITIES, SOURCES, name

STATUSES = {"AF": "open", "AO": "confirmed", "NF": "likely", "NO": "needs_review", "RF": "fixed", "RO": "false_positive"}


def table(spark: SparkSession, sf_dir: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def organizations(spark, d) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").alias("org_id"), F.col("r_name").alias("org_name"))


def repositories(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("repo_id"), F.col("n_name").alias("repo_name"), F.col("n_regionkey").alias("org_id"))


def memberships(spark, d) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("user_id"), F.col("n_regionkey").alias("org_id")).distinct()


def scans(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("QUEUED")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("scan_id"), F.col("c_nationkey").alias("repo_id"), F.col("o_orderdate").alias("created_at"), status.alias("scan_status"), F.col("o_orderpriority").alias("trigger"))


def findings(spark, d, repo: bool = True) -> DataFrame:
    """Findings, if wanted with their scan's repo_id: that takes a join of the two largest tables."""
    li = table(spark, d, "lineitem")
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int")
    flag = F.concat("l_returnflag", "l_linestatus")
    status = F.lit(None).cast("string")
    for k, v in STATUSES.items():
        status = F.when(flag == k, v).otherwise(status)
    own = li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_shipdate").cast("date").cast("string")).alias("finding_id"),
        F.col("l_orderkey").alias("scan_id"),
        F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("file_path"),
        (F.col("l_quantity").cast("int") * 4).alias("line_start"),
        (F.col("l_quantity").cast("int") * 4 + F.col("l_linenumber") % 3).alias("line_end"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 7).cast("string")).alias("category"),
        name(cents("l_discount") % 5, SEVERITIES).alias("severity"),
        name(cents("l_tax") % 4, CONFIDENCES).alias("confidence"),
        name(F.col("l_suppkey") % 9, SOURCES).alias("source"),
        status.alias("status"),
        F.col("l_shipdate").alias("first_seen"),
    )
    return own.join(scans(spark, d).select("scan_id", "repo_id"), "scan_id") if repo else own


def _case(expr: str, names: tuple) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(names)) + " END"


#: The same views for the oracle: a WITH clause to continue.
SQL = f"""WITH RECURSIVE organizations AS (SELECT r_regionkey AS org_id, r_name AS org_name FROM region),
repositories AS (SELECT n_nationkey AS repo_id, n_name AS repo_name, n_regionkey AS org_id FROM nation),
memberships AS (SELECT DISTINCT s_suppkey AS user_id, n_regionkey AS org_id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
scans AS (SELECT o_orderkey AS scan_id, c_nationkey AS repo_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'QUEUED' END AS scan_status, o_orderpriority AS trigger
  FROM orders JOIN customer ON o_custkey = c_custkey),
findings AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, l_shipdate::DATE) AS finding_id, l_orderkey AS scan_id,
  'src/p' || l_partkey || '.ts' AS file_path, l_quantity::INT * 4 AS line_start, l_quantity::INT * 4 + l_linenumber % 3 AS line_end,
  'c' || (l_partkey % 7) AS category, {_case("floor(l_discount * 100 + 0.5)::INT % 5", SEVERITIES)} AS severity,
  {_case("floor(l_tax * 100 + 0.5)::INT % 4", CONFIDENCES)} AS confidence, {_case("l_suppkey % 9", SOURCES)} AS source,
  CASE l_returnflag || l_linestatus {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUSES.items())} END AS status,
  l_shipdate AS first_seen, repo_id FROM lineitem JOIN scans ON scan_id = l_orderkey)"""


def sql_rank(col: str, names: tuple) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(names)) + " END"
