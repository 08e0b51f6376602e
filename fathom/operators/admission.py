"""Ordered admission: budgets over a prefix, and decisions that depend on earlier decisions.

The prefix budget is a running sum. Rate, spend and delivery admission depend
on what was admitted before, so a key's rows pass in order through one task,
which holds a batch of them and a bounded state, whatever the key's length.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def budget_prefix(files: DataFrame, keys: list[str], order: list[Column], budget: int) -> DataFrame:
    """Rows accepted in order until one would exceed the budget; then none. files: size, is_binary (adds nothing but may trip)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(F.when(~F.col("is_binary"), F.col("size"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = files.withColumn("__trip", (before + F.col("size") > budget).cast("int"))
    f = f.withColumn("__out", F.max("__trip").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return f.filter("__out = 0 and not is_binary").drop("__trip", "__out")


def in_order(rows: DataFrame, key: str, order: list[str], value: str, new) -> DataFrame:
    """rows with admitted: new() makes a key's decision function, which is asked with the value of each of its rows in order.

    A null key is a key like others, null places come first, and a row with a null value isn't admitted.
    """
    names = rows.columns
    k, v = names.index(key), names.index(value)

    def run(batches):
        held, admits = None, None
        for batch in batches:
            out = []
            for x, y in zip(batch.column(k).to_pylist(), batch.column(v).to_pylist()):
                if admits is None or x != held:
                    held, admits = x, new()
                out.append(y is not None and admits(y))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*names, "admitted"])

    schema = StructType([*rows.schema.fields, StructField("admitted", BooleanType())])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def rate_limit(attempts: DataFrame, most: int = 100, per_second: int = 5) -> DataFrame:
    """attempts: run_id, seq, ts_ms. Admits while the total and the starts in the last 1000 ms allow; only admitted ones count."""

    def new():
        recent, total = deque(), 0

        def admits(t: int) -> bool:
            nonlocal total
            while recent and recent[0] <= t - 1000:
                recent.popleft()
            ok = total < most and len(recent) < per_second
            if ok:
                recent.append(t)
                total += 1
            return ok

        return admits

    return in_order(attempts.select("run_id", "seq", "ts_ms"), "run_id", ["seq"], "ts_ms", new)


def budget_guard(spend: DataFrame, cap: float) -> DataFrame:
    """spend: scan_id, seq, cost. Greedy: admits what keeps the scan's admitted sum within cap (no cap if not positive)."""

    def new():
        total = 0.0

        def admits(cost: float) -> bool:
            nonlocal total
            ok = cap <= 0 or total + cost <= cap
            total += cost if ok else 0.0
            return ok

        return admits

    return in_order(spend.select("scan_id", "seq", "cost"), "scan_id", ["seq"], "cost", new)


def delivery_dedup(rows: DataFrame, hours: int = 24) -> DataFrame:
    """rows: delivery_id, ts, with a unique event_id. The first of an id, and whatever comes the TTL after the last one processed, is processed.

    Sight times are told apart by what was processed. A row without a time isn't.
    """
    span = hours * 3_600_000_000

    def new():
        last = None

        def admits(t: int) -> bool:
            nonlocal last
            ok = last is None or t >= last + span
            last = t if ok else last
            return ok

        return admits

    timed = rows.select("delivery_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return in_order(timed, "delivery_id", ["t", "event_id"], "t", new).filter("admitted").select("delivery_id", "event_id")
