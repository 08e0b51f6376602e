"""Snapshot writes: upsert that preserves human triage, child replacement, skip of duplicates, soft delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """old with new merged in: known keys take only the updated columns, unknown ones all; one full outer join."""
    o, n = old.alias("o"), new.alias("n")
    known = F.col(f"o.{keys[0]}").isNotNull()
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c in updated:
            cols.append(F.when(F.col(f"n.{keys[0]}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    return o.join(n, on, "full_outer").select(*cols)


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """children of parents that new speaks of are replaced by new's."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def insert_skip_duplicates(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return rows.unionByName(new.dropDuplicates(keys).join(rows.select(*keys), keys, "left_anti"))


def soft_delete(rows: DataFrame, which: Column, column: str, now: Column) -> DataFrame:
    return rows.withColumn(column, F.when(which & F.col(column).isNull(), now).otherwise(F.col(column)))
