"""Scalar column functions: masking, redaction, names, addresses, classifiers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocked IPv4 ranges (first address, prefix length). Fixed values.
BLOCKED_IPV4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)

#: Labels and patterns of injected instructions (a label may repeat). Fixed values.
INJECTIONS = (
    ("ignore-previous-instructions", r"(?i)ignore (all |any )?(previous|prior|above|earlier) instructions"),
    ("disregard-previous", r"(?i)disregard (all |any )?(previous|prior|above|earlier)"),
    ("role-override", r"(?i)you are now\b"),
    ("fake-system-marker", r"(?im)^\s*system\s*:"),
    ("new-instructions-claim", r"(?i)\bnew instructions?\b"),
    ("exfiltration-request", r"(?i)send (the |my |our )?(secret|password|token|api[ -]?key|credentials?)"),
    ("command-execution-request", r"(?i)run (this|the following|that) command"),
    ("prompt-extraction", r"(?i)reveal (your|the) (system prompt|instructions|configuration)"),
    ("role-override", r"(?i)act as (if you|though you)('re| are)"),
    ("jailbreak-persona", r"(?i)\bDAN\b.{0,20}\bmode\b"),
)


def mask_secret(x: Column) -> Column:
    n = F.length(x)
    return F.when(n <= 9, "[redacted]").otherwise(F.concat(F.substring(x, 1, 3), F.repeat(F.lit("*"), F.least(F.lit(8), n - 6)), F.right(x, F.lit(3))))


def redact_url(x: Column) -> Column:
    """A URL without its user and password; in what is no URL, they are replaced where they look like it."""
    whole = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*@)?[A-Za-z0-9.-]+(:\d{1,5})?([/?#]\S*)?\s*$"
    bare = F.regexp_replace(F.trim(x), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#\s]*@", "$1")
    return F.when(x.rlike(whole), bare).otherwise(F.regexp_replace(x, r"//[^/@\s]+@", "//[redacted]@"))


def slugify(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "org").otherwise(s)


def guess_apex(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def ipv4_to_int(x: Column) -> Column:
    """Null if x isn't four decimal bytes."""
    part = lambda k: F.split_part(x, F.lit("."), F.lit(k)).try_cast("bigint")
    ok = x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (part(1) < 256) & (part(2) < 256) & (part(3) < 256) & (part(4) < 256)
    return F.when(ok, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def _int(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def in_blocked_range(n: Column) -> Column:
    """Whether the address of that number is in a blocked range."""
    hit = F.lit(False)
    for first, bits in BLOCKED_IPV4:
        hit = hit | n.between(_int(first), _int(first) + (1 << (32 - bits)) - 1)
    return hit


def blocked_ipv4(x: Column) -> Column:
    """In a blocked range, or not an address at all."""
    return F.coalesce(in_blocked_range(ipv4_to_int(x)), F.lit(True))


def injection_labels(x: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(k)) for k, p in INJECTIONS])))


#: Categories of changed files by path, and the one by the change itself. Fixed values.
CHANGES = (
    ("auth_logic", r"(?i)auth|login|session|jwt|passport|oauth"),
    ("authorization_logic", r"(?i)permission|role|rbac|\bacl\b|policy|guard"),
    ("database_access", r"(?i)prisma|migration|schema\.prisma|\.sql$|repository|\bdao\b"),
    ("sensitive_configuration", r"(?i)(^|/)\.env|config|settings|secrets?"),
    ("dependency_manifest", r"(?i)package(-lock)?\.json$|pnpm-lock\.yaml$|yarn\.lock$|Gemfile\.lock$|requirements.*\.txt$|go\.sum$"),
    ("ci_cd_configuration", r"(?i)(^|/)\.github/workflows/|(^|/)Dockerfile$|docker-compose"),
)
PATCH_CHANGES = (("external_requests", r"\bfetch\(|axios\.\w+\(|https?\.request\(|https?\.get\("),)


def change_categories(path: Column, patch: Column | None = None) -> Column:
    """Categories of a changed file, in their order; a null path or patch has none."""
    found = [F.when(path.rlike(p), F.lit(k)) for k, p in CHANGES]
    if patch is not None:
        found += [F.when(patch.rlike(p), F.lit(k)) for k, p in PATCH_CHANGES]
    return F.array_compact(F.array(*found))


def format_duration(ms: Column) -> Column:
    return F.when(ms >= 1000, F.format_string("%.1fs", ms / F.lit(1000.0))).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def confidence_score(signals: Column) -> Column:
    """35 plus the present weights, within 5 and 95."""
    return F.least(F.lit(95), F.greatest(F.lit(5), F.aggregate(signals, F.lit(35), lambda a, x: a + F.coalesce(x, F.lit(0)))))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")
