"""Matching concrete requests to route patterns, and API inventories.

A pattern's segments are literals or {name}, which matches exactly one
segment. Requests and routes join on their segment count and the route's
rarest literal; the rest is checked per pair. Routes with more literals win,
ties by their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    """Segments without the query, empty ones dropped."""
    return F.filter(F.split(F.split_part(path, F.lit("?"), F.lit(1)), "/"), lambda x: x != "")


def colon_params(path: Column) -> Column:
    return F.regexp_replace(path, ":([A-Za-z0-9_]+)", "{$1}")


def is_param(segment: Column) -> Column:
    return segment.rlike(r"^\{.*\}$")


def specificity(path: Column) -> Column:
    return F.size(F.filter(segments(path), lambda x: ~is_param(x)))


def safe_decode(x: Column) -> Column:
    """Percent-decoding; malformed text stays as it is, and so does a plus sign."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def join_path(a: Column, b: Column) -> Column:
    whole = F.regexp_replace(F.concat_ws("/", F.lit(""), a, b), "/+", "/")
    return F.when(whole.isin("", "/"), "/").otherwise(F.regexp_replace(whole, "/$", ""))


def matches(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """All (request, route) pairs with decoded params (k=v, comma-joined) and literals.

    requests: req_id, method, path; routes: route_idx (unique), method, pattern.
    A route waits at its rarest literal, by segment count, place and text, and
    a request calls at each of its segments; routes of parameters only wait by
    segment count. Route tables are small beside requests: the pattern side is
    what Spark may broadcast by its measured size.
    """
    q = requests.select("req_id", F.lower("method").alias("q_method"), segments(F.col("path")).alias("q_seg"))
    r = routes.select("route_idx", F.lower("method").alias("r_method"), segments(F.col("pattern")).alias("r_seg"), specificity(F.col("pattern")).alias("literals"))
    q, r = q.withColumn("n", F.size("q_seg")), r.withColumn("n", F.size("r_seg"))
    literal = r.select("route_idx", "n", F.posexplode("r_seg").alias("place", "word")).filter(~is_param(F.col("word"))).withColumn("word", F.lower("word"))
    kept = literal.join(literal.groupBy("n", "place", "word").agg(F.count("*").alias("among")), ["n", "place", "word"])
    rarest = kept.groupBy("route_idx").agg(F.min(F.struct("among", "place", "word")).alias("w")).select("route_idx", "w.place", "w.word")
    calls = q.select("*", F.posexplode("q_seg").alias("place", "word")).withColumn("word", F.lower("word"))
    by_word = calls.join(r.join(rarest, "route_idx"), ["n", "place", "word"]).drop("place", "word")
    pair = by_word.unionByName(q.join(r.filter("literals = 0"), "n")).filter((F.col("r_method") == "*") | (F.col("r_method") == F.col("q_method")))
    fits = F.forall(F.zip_with("q_seg", "r_seg", lambda a, b: is_param(b) | (F.lower(a) == F.lower(b))), lambda x: x)
    named = F.filter(F.zip_with("q_seg", "r_seg", lambda a, b: F.when(is_param(b), F.concat(F.regexp_replace(b, r"[{}]", ""), F.lit("="), safe_decode(a)))), lambda x: x.isNotNull())
    return pair.filter(fits).select("req_id", "route_idx", "literals", F.array_join(named, ",").alias("params"))


def best_matches(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """The best route of each request and the number of others tied with it."""
    m = matches(requests, routes)
    order = Window.partitionBy("req_id").orderBy(F.desc("literals"), "route_idx")
    top = Window.partitionBy("req_id", "literals")
    m = m.withColumn("k", F.row_number().over(order)).withColumn("tied", F.count("*").over(top) - 1)
    return m.filter("k = 1").select("req_id", "route_idx", "literals", "params", F.col("tied").cast("long").alias("ambiguous_with"))


def route_summary(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """kind (matched, unmatched_runtime, unmatched_source) and count."""
    best = best_matches(requests, routes)
    runtime = requests.join(best.select("req_id", "route_idx"), "req_id", "left").select(F.when(F.col("route_idx").isNotNull(), "matched").otherwise("unmatched_runtime").alias("kind"))
    source = routes.join(best.select("route_idx").distinct(), "route_idx", "left_anti").select(F.lit("unmatched_source").alias("kind"))
    return runtime.unionByName(source).groupBy("kind").agg(F.count("*").alias("n"))


def example_path(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"\{[^}]*\}", "x")


def inventory(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """declared (method, path, security array or null) against observed (method, pattern): a row per endpoint of either.

    An endpoint is observed if its example path (params replaced by x) matches an observed route.
    """
    d = declared.select(F.monotonically_increasing_id().alias("req_id"), "method", "path", "security").withColumn("example", example_path(F.col("path")))
    o = observed.select(F.monotonically_increasing_id().alias("route_idx"), "method", "pattern")
    m = matches(d.select("req_id", "method", F.col("example").alias("path")), o)
    left = d.join(m.select("req_id").distinct().withColumn("seen", F.lit(True)), "req_id", "left").select("method", "path", "security", F.lit(True).alias("declared"), F.coalesce("seen", F.lit(False)).alias("observed"))
    right = o.join(m.select("route_idx").distinct(), "route_idx", "left_anti").select("method", F.col("pattern").alias("path"), F.lit(None).cast("array<string>").alias("security"), F.lit(False).alias("declared"), F.lit(True).alias("observed"))
    return left.unionByName(right)


def api_findings(endpoints: DataFrame) -> DataFrame:
    """API-101 undeclared, 102 not observed, 103 open while others need auth, 104 declared with an id-shaped path parameter."""
    any_auth = endpoints.agg(F.coalesce(F.bool_or(F.col("declared") & (F.coalesce(F.size("security"), F.lit(0)) > 0)), F.lit(False)).alias("any_auth"))
    e = endpoints.crossJoin(F.broadcast(any_auth))  # one row
    rules = F.array(
        F.when(F.col("observed") & ~F.col("declared"), F.struct(F.lit("API-101").alias("rule"), F.lit("low").alias("severity"))),
        F.when(F.col("declared") & ~F.col("observed"), F.struct(F.lit("API-102").alias("rule"), F.lit("info").alias("severity"))),
        F.when(F.col("declared") & F.col("security").isNotNull() & (F.size("security") == 0) & F.col("any_auth"), F.struct(F.lit("API-103").alias("rule"), F.lit("low").alias("severity"))),
        F.when(F.col("declared") & F.exists(segments(F.col("path")), lambda x: x.rlike(r"^\{(id|.*_id|.*Id|uuid)\}$")), F.struct(F.lit("API-104").alias("rule"), F.lit("info").alias("severity"))),
    )
    return e.select("method", "path", F.explode(F.array_compact(rules)).alias("r")).select("method", "path", "r.rule", "r.severity")
