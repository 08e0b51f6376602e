"""Code graph: nodes and edges with first-wins ids, enclosing scopes, and the authorization rules over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an explicit order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def node_ids(nodes: DataFrame) -> DataFrame:
    """nodes (kind, file_path, name, line) with id kind:file:name:line."""
    return nodes.withColumn("id", F.concat_ws(":", "kind", "file_path", "name", F.col("line").cast("string")))


def enclosing(calls: DataFrame, functions: DataFrame, block: int = 64) -> DataFrame:
    """calls (call_id, file_path, pos) with the innermost of functions (fn_id, file_path, first, last) around each.

    The innermost begins last. Both sides meet by file and block of positions,
    a function in each block that it reaches, so a file's calls don't meet all
    of its functions, and a long file is many keys. Calls in no function and
    rows with a null place are left out.
    """
    at = lambda c: F.floor(F.col(c) / block).cast("long")
    c = calls.select("call_id", "file_path", "pos", at("pos").alias("block"))
    f = functions.filter("first <= last").select("fn_id", "file_path", "first", "last", F.explode(F.sequence(at("first"), at("last"))).alias("block"))
    j = c.join(f, ["file_path", "block"]).filter("first <= pos and pos <= last")
    return j.groupBy("call_id").agg(F.max_by("fn_id", F.struct("first", "fn_id")).alias("fn_id"))


def object_access(flows: DataFrame, owned: DataFrame, guarded: DataFrame, responding: DataFrame) -> DataFrame:
    """AUTHZ-001: tainted look-ups (call_id, model) without owner filter or dominating guard whose result is returned."""
    sensitive = F.lower("model").isin("user", "account", "organization", "tenant", "payment", "invoice", "order", "credential", "session", "apikey")
    f = flows.join(owned, "call_id", "left_anti").join(guarded, "call_id", "left_anti").join(responding, "call_id", "left_semi")
    return f.select("call_id", F.lit("AUTHZ-001").alias("rule"), F.when(sensitive, "high").otherwise("medium").alias("severity"), (F.when(sensitive, 15).otherwise(0) + 70).alias("score"))


def scope_sync(entries: DataFrame, authorizations: DataFrame) -> DataFrame:
    """entries (scope_id, kind, eligible) against authorizations (scope_id, revoked): the outcome of each, reasons in order."""
    j = entries.join(authorizations.withColumn("known", F.lit(True)), "scope_id", "left")
    out = (
        F.when(~F.col("kind").isin("URL", "DOMAIN", "WILDCARD"), "skipped_type")
        .when(~F.col("eligible"), "skipped_not_eligible")
        .when(F.coalesce("revoked", F.lit(False)), "skipped_revoked")
        .when(F.col("known"), "updated")
        .otherwise("created")
    )
    return j.select("scope_id", out.alias("outcome"))
