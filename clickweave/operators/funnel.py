"""Conversion funnels over an ordered list of steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def funnel(events: DataFrame, steps: list[tuple[str, Column]], keys: tuple[str, ...] = ("userId", "sessionId")) -> DataFrame:
    """step, name, sessions, conversionRate (of the sessions at the first step).

    A session reaches a step at its first matching event strictly after it has reached the step before. Step after step is a grouped
    minimum, combined before the shuffle, so a session's events are never held together. Events are read once a step.
    """
    at = None
    counts = []
    for k, (_, matches) in enumerate(steps):
        found = events.filter(matches).select(*keys, F.col("ts").alias("_ts"))
        if at is not None:
            before = at.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)), F.col("_at").alias("_before"))
            same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)))
            found = found.join(before, same & (F.col("_ts") > F.col("_before"))).select(*keys, "_ts")
        at = found.groupBy(*keys).agg(F.min("_ts").alias("_at"))
        counts.append(at.agg(F.count("_at").alias(f"n{k}")))
    counts = reduce(DataFrame.crossJoin, counts)
    rows = F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(name).alias("name"), F.col(f"n{k}").alias("sessions"), F.when(F.col("n0") > 0, F.col(f"n{k}") / F.col("n0")).otherwise(0.0).alias("conversionRate")) for k, (name, _) in enumerate(steps)))
    return counts.select(F.inline(rows))
