"""Posture scores and policy verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import OPEN, SEVERITIES, rank

#: Fixed values of the score: weight by severity, factor by confidence.
WEIGHTS = {"critical": 20.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.5}
FACTORS = {"confirmed": 1.0, "high": 0.85, "medium": 0.6, "low": 0.35}


def _choose(col: Column, values: dict) -> Column:
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def penalty(now: Column, validated: Column | None = None) -> Column:
    """Weight, confidence, age (up to half more after 30 days) and validation (a fifth more)."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / F.lit(86_400_000_000.0))
    age = 1 + F.least(F.lit(1.0), days / 30) * 0.5
    shown = F.when(validated, 1.2).otherwise(1.0) if validated is not None else F.lit(1.0)
    return _choose(F.col("severity"), WEIGHTS) * _choose(F.col("confidence"), FACTORS) * age * shown


def is_open(status: Column) -> Column:
    return status.isin(*OPEN)


def at_or_above(severity: Column, least: str) -> Column:
    return rank(severity, SEVERITIES) >= SEVERITIES.index(least)


def score(total: Column) -> Column:
    """100 less the penalties, half up, not below 0; 100 without any."""
    return F.greatest(F.lit(0), F.floor(100 - F.coalesce(total, F.lit(0)).cast("double") + 0.5)).cast("int")


def exact(p: Column) -> Column:
    """Micro-units as a decimal: sums don't depend on their order."""
    return F.round(p, 6).cast("decimal(18,6)")


def security_score(findings: DataFrame, keys: list[str], now: Column) -> DataFrame:
    open_ = is_open(F.col("status"))
    p = F.sum(F.when(open_, exact(penalty(now))))
    return findings.groupBy(*keys).agg(score(p).alias("score"), F.sum(open_.cast("long")).alias("n_open"), F.coalesce(p, F.lit(0)).cast("double").alias("total_penalty"))


def breakdown(findings: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Open findings and penalty per severity present."""
    return findings.filter(is_open(F.col("status"))).groupBy(*keys, "severity").agg(F.count("*").alias("n"), F.sum(exact(penalty(now))).cast("double").alias("penalty"))


#: rule id, the condition of an offending row.
def policy_conditions(columns: list[str]) -> dict[str, Column]:
    """Without a column is_new every finding counts as new."""
    open_ = is_open(F.col("status"))
    new = F.coalesce(F.col("is_new"), F.lit(False)) if "is_new" in columns else F.lit(True)
    return {
        "fail_on_open_critical": open_ & at_or_above(F.col("severity"), "critical"),
        "fail_on_confirmed_high": (F.col("status") == "confirmed") & at_or_above(F.col("severity"), "high"),
        "fail_on_new_secrets": new & open_ & (F.col("source") == "secret_detection"),
        "fail_on_dependency_critical": open_ & (F.col("source") == "dependency_analysis") & at_or_above(F.col("severity"), "critical"),
    }


def evaluate_policies(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A row per violated rule with its offenders; every enabled rule is judged on its own, in one aggregation."""
    rules = policy_conditions(findings.columns)
    wide = findings.groupBy(*keys).agg(*[F.sum(c.cast("long")).alias(k) for k, c in rules.items()])
    return wide.unpivot(keys, list(rules), "rule", "offenders").filter("offenders > 0")


def policy_passed(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Whether no finding of the key breaks a policy: one aggregate. Null statuses and severities break none."""
    broken = F.lit(False)
    for c in policy_conditions(findings.columns).values():
        broken = broken | F.coalesce(c, F.lit(False))
    return findings.groupBy(*keys).agg((~F.bool_or(broken)).alias("passed"))
