"""Enumerations and ranks of the finding model. Fixed values of the data format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high", "confirmed")
#: Best first.
SOURCES = ("dynamic_validation", "rules_engine", "web_security", "api_security", "static_analysis", "ai_review", "secret_detection", "dependency_analysis", "code_intelligence")
OPEN = ("open", "confirmed", "likely", "needs_review")


def rank(col: Column, names: tuple) -> Column:
    """Position of col in names; null for other values."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(names):
        out = F.when(col == name, k).otherwise(out)
    return out


def name(col: Column, names: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), col.cast("int") + 1)
