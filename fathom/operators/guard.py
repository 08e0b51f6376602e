"""Scope decisions for requests against authorizations: an ordered list of reasons, the first that fails wins.

Every doubtful case is refused: a null URL, no authorization, a host that
didn't resolve (null or no addresses), an address that can't be read, a null
list of path prefixes. URLs are read as a browser reads them: tabs and line
ends go, backslashes before the query are slashes, and dot segments, also
percent-encoded ones, are resolved before a path is held against a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import blocked_ipv6
from ..functions.scalars import blocked_ipv4

#: Hosts refused by name, before and after resolution. Fixed values.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata.internal")
AUTHORITY = r"^[^:/?#]+://(?:[^/@?#]*@)?"


def blocked_address(x: Column) -> Column:
    """Of either version; blocked too if it is neither."""
    v4 = x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.coalesce(F.when(v4, blocked_ipv4(x)).when(x.contains(":"), blocked_ipv6(x)), F.lit(True))


def browser_url(url: Column) -> Column:
    """Blanks around it, tabs and line ends dropped; backslashes before query and fragment are slashes."""
    bare = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    return F.regexp_replace(bare, r"\G([^\\?#]*)\\", "$1/")


def resolved_path(path: Column) -> Column:
    """An absolute path without dot segments; '..' stops at the root, and a last dot segment leaves its slash."""
    parts = F.filter(F.split(path, "/"), lambda x, k: k > 0)
    one = lambda x: F.lower(x).isin(".", "%2e")
    two = lambda x: F.lower(x).isin("..", ".%2e", "%2e.", "%2e%2e")
    step = lambda held, x: F.when(two(x), F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(one(x), held).otherwise(F.array_append(held, x))
    held = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1)
    end = F.when((one(last) | two(last)) & (F.size(held) > 0), "/").otherwise("")
    return F.when(path == "", "/").otherwise(F.concat(F.lit("/"), F.array_join(held, "/"), end))


def decide(requests: DataFrame, authorizations: DataFrame, now: Column, capability: int = 2) -> DataFrame:
    """requests: req_id, url, tier, resolved array; authorizations: idx, scheme, host, port, max_tier, expires_at, revoked_at, verified_at and, if paths are limited, allowed_path_prefixes array.

    The first authorization (by idx) of a request's scheme, host and port counts, so a revoked one hides later ones.
    """
    requests = requests.withColumn("url", browser_url(F.col("url")))
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract("url", AUTHORITY + r"(\[[^\]]*\]|[^/:?#]*)", 1)), r"^\[|\]$", "")
    port = F.regexp_extract("url", AUTHORITY + r"(?:\[[^\]]*\]|[^/:?#]*):(\d+)", 1).try_cast("int")
    path = F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    r = requests.select("req_id", "url", "tier", "resolved", scheme.alias("scheme"), host.alias("host"), resolved_path(path).alias("path"), port.alias("given"))
    r = r.withColumn("port", F.coalesce("given", F.when(F.col("scheme") == "https", 443).when(F.col("scheme") == "http", 80)))
    prefixes = F.col("allowed_path_prefixes") if "allowed_path_prefixes" in authorizations.columns else F.array().cast("array<string>")
    a = authorizations.select("scheme", F.lower("host").alias("host"), "port", "idx", "max_tier", "expires_at", "revoked_at", "verified_at", prefixes.alias("prefixes"))
    first = Window.partitionBy("scheme", "host", "port").orderBy("idx")
    a = a.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")
    j = r.join(a, ["scheme", "host", "port"], "left")
    literal = F.col("host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.col("host").contains(":")
    addresses = F.when(literal, F.array("host")).otherwise(F.col("resolved"))
    refused = F.col("host").isin(*BLOCKED_HOSTS) | F.coalesce((F.size(addresses) < 1) | F.exists(addresses, blocked_address), F.lit(True))
    off_path = F.col("prefixes").isNull() | ((F.size("prefixes") > 0) & ~F.coalesce(F.exists("prefixes", lambda p: F.startswith("path", p)), F.lit(False)))
    reason = (
        F.when(F.col("url").isNull() | (F.col("scheme") == "") | (F.col("host") == ""), "invalid_url")
        .when(~F.col("scheme").isin("http", "https"), "unsupported_scheme")
        .when(F.col("host").isin(*LOCAL_HOSTS), "blocked_hostname")
        .when(F.col("idx").isNull(), "no_matching_authorization")
        .when(F.col("revoked_at").isNotNull(), "authorization_revoked")
        .when(F.coalesce(F.col("expires_at") <= now, F.lit(True)), "authorization_expired")
        .when(F.col("verified_at").isNull(), "authorization_not_verified")
        .when(F.coalesce((F.col("tier") > F.col("max_tier")) | (F.col("tier") > capability), F.lit(True)), "tier_exceeds_authorization")
        .when(off_path, "path_not_allowed")
        .when(refused, "host_resolves_to_blocked_address")
        .otherwise("ok")
    )
    return j.select("req_id", reason.alias("reason"), (reason == "ok").alias("allowed"))
