"""URLs, hosts, paths and addresses as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import blocked_ipv4, in_blocked_range

HOST = r"^(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def port(url: Column) -> Column:
    given = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*:(\d+)(?:[/?#]|$)", 1).try_cast("int")
    return F.coalesce(given, F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80))


def same_origin(a: Column, b: Column) -> Column:
    """Equal scheme, host and port; false where either is no URL."""
    return F.coalesce((host(a) != "") & (scheme(a) == scheme(b)) & (host(a) == host(b)) & (port(a) == port(b)), F.lit(False))


def normalize_host(x: Column) -> Column:
    """A host name from user input, or null: scheme and path dropped, lower case, no bare address."""
    bare = F.lower(F.trim(x))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[a-z][a-z0-9+.-]*://", ""), r"[/:?#].*$", "")
    bare = F.regexp_replace(bare, r"\.$", "")
    return F.when(bare.rlike(HOST) & ~bare.rlike(r"^\d+(\.\d+){3}$"), bare)


def blocked_ipv6(x: Column) -> Column:
    """Loopback, link-local, unique-local, and mapped IPv4, dotted or in two hex groups, that is blocked; what has no readable first group isn't."""
    low = F.trim(F.lower(x))
    dotted = F.regexp_extract(low, r"^::ffff:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    group = lambda pattern, k: F.conv(F.regexp_extract(low, pattern, k), 16, 10).cast("bigint")
    mapped = r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    first = group(r"^([0-9a-f]{1,4})(:|$)", 1)
    return F.coalesce(
        F.when(low.isin("::1", "0:0:0:0:0:0:0:1"), True)
        .when(dotted != "", blocked_ipv4(dotted))
        .when(low.rlike(mapped), in_blocked_range(group(mapped, 1) * 65536 + group(mapped, 2)))
        .otherwise(first.between(0xFE80, 0xFEBF) | first.between(0xFC00, 0xFDFF)),
        F.lit(False),
    )


def normalized_path(x: Column) -> Column:
    """'.' and '..' resolved; null if it leaves its root."""
    parts = F.filter(F.split(x, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("s"), F.lit(False).alias("out"))

    def step(a, p):
        up = p == ".."
        return F.struct(
            F.when(up, F.slice(a["s"], 1, F.greatest(F.size(a["s"]) - 1, F.lit(0)))).otherwise(F.concat(a["s"], F.array(p))).alias("s"),
            (a["out"] | (up & (F.size(a["s"]) == 0))).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda a: F.when(~a["out"], F.array_join(a["s"], "/")))


def disallowed_paths(robots: Column) -> Column:
    """Disallow values of the groups for every agent."""
    state = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("p"))

    def step(a, line):
        key, value = F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace(line, r"^[^:]*:", ""))
        return F.struct(
            F.when(key == "user-agent", value == "*").otherwise(a["on"]).alias("on"),
            F.when((key == "disallow") & a["on"] & (value != ""), F.concat(a["p"], F.array(value))).otherwise(a["p"]).alias("p"),
        )

    return F.aggregate(F.split(robots, r"\r?\n"), state, step, lambda a: a["p"])


def disallowed(path: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: F.startswith(path, p))


def sitemap_urls(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)
