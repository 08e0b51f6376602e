"""Normalisers of scanner reports and API descriptions into finding drafts and endpoints.

Reports are JSON text, a document a row: parsed with explicit schemas, exploded,
and mapped with built-in functions. Malformed text gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mask_secret

PATTERN_SCHEMA = "results array<struct<check_id:string, path:string, start:struct<line:int>, `end`:struct<line:int>, extra:struct<message:string, severity:string, lines:string, metadata:struct<confidence:string, cwe:string>>>>"
SECRET_SCHEMA = "array<struct<RuleID:string, Description:string, StartLine:int, EndLine:int, Secret:string, File:string, Fingerprint:string>>"
DEPENDENCY_SCHEMA = (
    "results array<struct<source:struct<path:string>, packages:array<struct<package:struct<name:string, version:string, ecosystem:string>,"
    " vulnerabilities:array<struct<id:string, summary:string, database_specific:struct<severity:string>, affected:array<struct<database_specific:struct<severity:string>,"
    " ranges:array<struct<events:array<struct<introduced:string, fixed:string>>>>>>>>>>>>"
)
DRAFT = ("title", "category", "cwe", "severity", "confidence", "source", "file_path", "line_start", "line_end", "evidence")


def first_of(text: Column) -> Column:
    """The value of a JSON scalar, or the first item of a JSON array."""
    return F.coalesce(F.get_json_object(text, "$[0]"), F.when(~F.startswith(F.ltrim(text), F.lit("[")), text))


def pattern_report(reports: DataFrame, column: str = "json") -> DataFrame:
    """Findings of a pattern scanner: severity by name, title from the check id's last part."""
    r = reports.select(F.explode(F.from_json(column, PATTERN_SCHEMA)["results"]).alias("r")).select("r.*")
    level = F.upper("extra.severity")
    sure = F.upper("extra.metadata.confidence")
    return r.select(
        F.element_at(F.split("check_id", "[.]"), -1).alias("title"),
        F.col("check_id").alias("category"),
        first_of(F.col("extra.metadata.cwe")).alias("cwe"),
        F.when(level == "ERROR", "high").when(level == "WARNING", "medium").when(level == "INFO", "low").otherwise("medium").alias("severity"),
        F.when(sure.isin("HIGH", "MEDIUM", "LOW"), F.lower(sure)).otherwise("medium").alias("confidence"),
        F.lit("static_analysis").alias("source"),
        F.col("path").alias("file_path"),
        F.col("start.line").alias("line_start"),
        F.col("end.line").alias("line_end"),
        F.col("extra.lines").alias("evidence"),
    )


def secret_report(reports: DataFrame, column: str = "json") -> DataFrame:
    """Findings of a secret scanner; the secret leaves only masked."""
    r = reports.select(F.explode(F.from_json(column, SECRET_SCHEMA)).alias("r")).select("r.*")
    return r.select(
        F.col("Description").alias("title"),
        F.col("RuleID").alias("category"),
        F.lit("CWE-798").alias("cwe"),
        F.lit("critical").alias("severity"),
        F.lit("medium").alias("confidence"),
        F.lit("secret_detection").alias("source"),
        F.col("File").alias("file_path"),
        F.col("StartLine").alias("line_start"),
        F.col("EndLine").alias("line_end"),
        mask_secret(F.col("Secret")).alias("evidence"),
    )


def dependency_report(reports: DataFrame, column: str = "json") -> DataFrame:
    """Findings of a dependency scanner: results, packages, vulnerabilities; missing lists are empty."""
    r = reports.select(F.explode(F.from_json(column, DEPENDENCY_SCHEMA)["results"]).alias("r"))
    p = r.select(F.col("r.source.path").alias("path"), F.explode("r.packages").alias("p"))
    v = p.select("path", "p.package", F.explode("p.vulnerabilities").alias("v"))
    given = F.filter(F.transform("v.affected", lambda a: a["database_specific"]["severity"]), lambda x: x.isNotNull())
    level = F.upper(F.coalesce("v.database_specific.severity", F.get(given, F.lit(0))))
    some = lambda x: x.isNotNull()
    ranges = F.flatten(F.filter(F.transform("v.affected", lambda a: a["ranges"]), some))
    events = F.flatten(F.filter(F.transform(ranges, lambda r: r["events"]), some))
    fixed = F.get(F.filter(F.transform(events, lambda e: e["fixed"]), some), F.lit(0))
    severity = F.when(level == "MODERATE", "medium").when(level.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.lower(level)).otherwise("medium")
    return v.select(
        F.concat(F.col("v.id"), F.lit(" in "), F.col("package.name")).alias("title"),
        F.col("v.id").alias("category"),
        F.lit(None).cast("string").alias("cwe"),
        severity.alias("severity"),
        F.lit("confirmed").alias("confidence"),
        F.lit("dependency_analysis").alias("source"),
        F.col("path").alias("file_path"),
        F.lit(None).cast("int").alias("line_start"),
        F.lit(None).cast("int").alias("line_end"),
        F.concat(F.col("package.name"), F.lit("@"), F.col("package.version"), F.coalesce(F.concat(F.lit(" fixed in "), fixed), F.lit(""))).alias("evidence"),
    )


METHODS = ("get", "post", "put", "delete", "patch", "options", "head")
OPERATION = "struct<security:string, parameters:array<struct<name:string, `in`:string, required:boolean>>>"


def openapi_endpoints(documents: DataFrame, column: str = "json") -> DataFrame:
    """Endpoints of OpenAPI documents in JSON: paths by methods, security of the operation or else of the document.

    security holds the scheme names, [] where none is asked, null where nothing is said.
    """
    paths = "map<string, struct<" + ", ".join(f"{m}:{OPERATION}" for m in METHODS) + ", parameters:array<struct<name:string, `in`:string, required:boolean>>>>"
    d = documents.select(F.from_json(column, f"paths {paths}, security string").alias("d"))
    p = d.select(F.col("d.security").alias("base"), F.explode("d.paths").alias("path", "item"))
    ops = F.array_compact(F.array(*[F.when(F.col(f"item.{m}").isNotNull(), F.struct(F.lit(m.upper()).alias("method"), F.col(f"item.{m}").alias("op"))) for m in METHODS]))
    e = p.select("path", "base", F.col("item.parameters").alias("shared"), F.explode(ops).alias("o"))
    named = F.from_json(F.coalesce("o.op.security", "base"), "array<map<string, array<string>>>")
    whole = F.concat(F.coalesce("shared", F.array()), F.coalesce("o.op.parameters", F.array()))
    sound = F.filter(whole, lambda x: x["name"].isNotNull() & x["in"].isin("path", "query", "header", "cookie"))
    return e.select(
        F.col("o.method").alias("method"),
        "path",
        F.flatten(F.transform(named, F.map_keys)).alias("security"),
        F.transform(sound, lambda x: F.struct(x["name"].alias("name"), x["in"].alias("in"), F.coalesce(x["required"], x["in"] == "path").alias("required"))).alias("parameters"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON document of findings: level by severity, line at least 1. The rows of a scan (scan_id) make one document."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    result = F.struct(F.col("category").alias("ruleId"), level.alias("level"), F.col("file_path").alias("uri"), F.greatest(F.lit(1), F.coalesce("line_start", F.lit(1))).alias("startLine"))
    return findings.groupBy("scan_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(result)).alias("results"))).alias("sarif"))
