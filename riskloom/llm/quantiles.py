"""Percentiles of very large numeric columns from cumulative frequencies.

The state is a table of counts: (period, group, metric, value) -> n. States of
separate days or files are combined by adding counts. The percentile p of a
group is its first value, in order, whose running count reaches ceil(p * n).

Running counts take no task over a whole group: the counts are sorted by range
of (group, value), each partition sums its part of a group, these few sums become
offsets, and a window runs within (group, partition) only.

The result is exact while values are kept as they are. With `error` e > 0,
values are reduced to buckets of ratio (1 + e) / (1 - e) first, which bounds the
number of distinct values; a percentile is then within e of the exact one,
relatively, whatever states were combined.

Defined results: null and negative values are no values; a null group is a group;
a group without values has no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialise


def bucketed(value: Column, error: float) -> Column:
    """The middle of the value's bucket; 0 stays 0."""
    if not error:
        return value
    ratio = (1 + error) / (1 - error)
    k = F.ceil(F.log(F.greatest(value, F.lit(1e-300))) / math.log(ratio))
    return F.when(value == 0, F.lit(0.0)).when(value.isNotNull(), 2 * F.pow(F.lit(ratio), k) / (ratio + 1))


def frequencies(df: DataFrame, period: Column, groups: Sequence[str], metrics: Sequence[str], error: float = 0.0) -> DataFrame:
    """(period, groups, metric, value, n). Counts are summed in each task before the shuffle, so a hot group or value is one row per task."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    flat = df.select(period.alias("period"), *groups, pairs).filter("m.value >= 0 and not isnan(m.value)")
    flat = flat.select("period", *groups, "m.metric", bucketed(F.col("m.value"), error).alias("value"))
    return flat.groupBy("period", *groups, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def combine(*states: DataFrame) -> DataFrame:
    """The state of several: counts add up."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, groups: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """(groups, metric, n_values, one column per probability) from a state; periods that are no group are combined."""
    keys = [*groups, "metric"]
    summed = state.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    ranged = summed.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], "value").withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    parts = ranged.groupBy(*keys, "__part").agg(F.sum("n").alias("__in"))
    up_to = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = parts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__at"), F.coalesce(F.sum("__in").over(up_to), F.lit(0)).alias("__before"), F.sum("__in").over(whole).alias("__total"))
    same = F.col("__part") == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = Window.partitionBy(*keys, "__part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("__run", F.sum("n").over(within)).join(offsets, same).withColumn("__run", F.col("__run") + F.col("__before"))
    rank = {c: F.ceil(F.lit(p) * F.col("__total")) for c, p in probabilities.items()}
    first = [F.min(F.when(F.col("__run") >= F.greatest(r, F.lit(1)), F.col("value"))).alias(c) for c, r in rank.items()]
    return running.groupBy(*keys).agg(F.max("__total").alias("n_values"), *first)


def daily_and_combined(df: DataFrame, day: Column, group: str, metrics: Sequence[str], probabilities: dict[str, float], error: float = 0.0) -> DataFrame:
    """(group, day, metric, n_values, ...): percentiles of each day and, with a null day, of all days combined from the daily states."""
    state = materialise(frequencies(df, day, [group], metrics, error), "state")
    daily = percentiles(state.withColumn("day", F.col("period")), [group, "day"], probabilities)
    return daily.unionByName(percentiles(state, [group], probabilities).withColumn("day", F.lit(None).cast("date")).select(daily.columns))
