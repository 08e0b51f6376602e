"""Facts and findings from crawled pages: links, cookies, CORS, debug output, transport, and a bounded crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that mark a session cookie, and extensions of static files. Fixed values.
SENSITIVE_COOKIE = "(?i)session|auth|token|jwt|sid|login|credential"
STATIC = ("css", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "pdf", "zip")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']*)["']"""), 1)


def scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<script[^>]*\ssrc\s*=\s*["']([^"']*)["']"""), 1)


def forms(html: Column) -> Column:
    """Structs of action, method (GET if absent) and distinct field names."""
    one = lambda f, p: F.regexp_extract(f, p, 1)
    return F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)(<form\b.*?</form>)"), 1),
        lambda f: F.struct(
            F.nullif(one(f, r"""(?is)^<form[^>]*\saction\s*=\s*["']([^"']*)["']"""), F.lit("")).alias("action"),
            F.upper(F.coalesce(F.nullif(one(f, r"""(?is)^<form[^>]*\smethod\s*=\s*["']([^"']*)["']"""), F.lit("")), F.lit("get"))).alias("method"),
            F.array_distinct(F.regexp_extract_all(f, F.lit(r"""(?is)<(?:input|select|textarea)\b[^>]*\sname\s*=\s*["']([^"']*)["']"""), 1)).alias("fields"),
        ),
    )


def path_of(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def is_static(path: Column) -> Column:
    """By the extension after the last dot of the whole path."""
    return F.contains(path, F.lit(".")) & F.lower(F.substring_index(path, ".", -1)).isin(*STATIC)


def cookie_findings(responses: DataFrame) -> DataFrame:
    """responses: url, set_cookie array. WEB-002 no Secure on https, WEB-003 no HttpOnly; a cookie without a name is passed over."""
    c = responses.select("url", F.explode("set_cookie").alias("c"))
    c = c.select("url", F.trim(F.split_part(F.split_part("c", F.lit(";"), F.lit(1)), F.lit("="), F.lit(1))).alias("cookie"), F.transform(F.split("c", ";"), lambda x: F.lower(F.trim(x))).alias("attrs"), F.col("c").contains(";").alias("more"))
    # the cookie itself is the first part, attributes follow
    c = c.filter("cookie <> ''").withColumn("attrs", F.when(F.col("more"), F.expr("slice(attrs, 2, size(attrs))")).otherwise(F.array().cast("array<string>")))
    secret = F.col("cookie").rlike(SENSITIVE_COOKIE)
    found = F.array(
        F.when(F.startswith("url", F.lit("https://")) & ~F.array_contains("attrs", "secure"), F.struct(F.lit("WEB-002").alias("rule"), F.when(secret, "medium").otherwise("low").alias("severity"))),
        F.when(~F.array_contains("attrs", "httponly"), F.struct(F.lit("WEB-003").alias("rule"), F.when(secret, "medium").otherwise("info").alias("severity"))),
    )
    return c.select("url", "cookie", F.explode(F.array_compact(found)).alias("r")).select("url", "cookie", "r.rule", "r.severity")


def cors_findings(responses: DataFrame) -> DataFrame:
    """responses: url, probe_origin, allow_origin, allow_credentials. The first case that holds."""
    credentials = F.lower(F.coalesce("allow_credentials", F.lit(""))) == "true"
    level = F.when((F.col("allow_origin") == F.col("probe_origin")) & credentials, "high").when((F.col("allow_origin") == "*") & credentials, "medium").when(F.col("allow_origin") == "*", "info")
    return responses.select("url", F.lit("WEB-001").alias("rule"), level.alias("severity")).filter("severity is not null")


def hsts_findings(responses: DataFrame) -> DataFrame:
    """responses: url, hsts."""
    return responses.filter(F.startswith("url", F.lit("https:")) & F.col("hsts").isNull()).select("url", F.lit("WEB-006").alias("rule"), F.lit("low").alias("severity"))


#: Signatures of debug output. Fixed values.
MARKERS = (
    ("Node.js stack trace", r"at\s+[\w.<>\[\] ]+\s+\([^)]*:\d+:\d+\)"),
    ("Python traceback", r"Traceback \(most recent call last\)"),
    ("Laravel debug page", r"(?i)Whoops[\s\S]{0,200}Laravel|Illuminate\\Database"),
    ("ASP.NET debug page", r"Server Error in '/' Application"),
    ("Django debug page", r"Django Version:[\s\S]{0,500}Exception Type:"),
    ("PHP error output", r"PHP Fatal error|PHP Warning:.*on line \d+"),
    (".NET stack trace", r"at System\.\S+\.\S+\("),
)


def debug_findings(responses: DataFrame) -> DataFrame:
    """responses: url, status, body. One row per signature found, medium from status 400."""
    found = F.array_compact(F.array(*[F.when(F.col("body").rlike(p), F.lit(k)) for k, p in MARKERS]))
    return responses.select("url", F.explode(found).alias("marker"), F.when(F.col("status") >= 400, "medium").otherwise("low").alias("severity")).withColumn("rule", F.lit("WEB-004"))


def crawl(edges: DataFrame, start: DataFrame, max_depth: int = 2) -> DataFrame:
    """(page, depth) reached from start (page) over edges (src, dst), first depth wins.

    A round is a join of the new frontier with edges and an anti-join with
    what was seen; pages at max_depth are reached but not left.
    """
    seen = start.select("page", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["page"] == edges["src"]).select(F.col("dst").alias("page")).distinct()
        frontier = step.join(seen.select("page"), "page", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen
