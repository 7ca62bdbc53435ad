"""Aggregates over labels, predictions, scores and durations.

Defined results: an undefined ratio is 0 in classification metrics, as a
division by zero; a share of no rows is null elsewhere; null labels are left out
where a docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import ratio_or_zero
from riskloom.operators.skew import quantile_slices, sliced_running
from riskloom.session import scalars


def class_balance(df: DataFrame, label: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, n, positives, negatives, positive_pct): rows with a label, and the percentage with label 1."""
    known = df.filter(F.col(label).isNotNull())
    out = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    return out.withColumn("positive_pct", ratio_or_zero(F.col("positives") * 100, F.col("n")))


def per_listed_group(df: DataFrame, label: str, group: str, listed: DataFrame) -> DataFrame:
    """class_balance for each listed group, groups without rows included with zeros. `listed` has one column of that name."""
    stats = class_balance(df, label, (group,)).withColumnRenamed(group, "__g")
    joined = listed.join(stats, listed[group] == stats["__g"], "left").drop("__g")
    return joined.select(group, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "positives", "negatives")], F.coalesce("positive_pct", F.lit(0.0)).alias("positive_pct"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, share) of the non-null values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = scalars(df, n=F.count(column))["n"]
    return counts.select("value", (F.col("n") / total).alias("share"))


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(n, accuracy, precision, recall, f1) for class 1."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select((tp + fp + fn + tn).alias("n"), ratio_or_zero(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio_or_zero(tp, tp + fp).alias("precision"), ratio_or_zero(tp, tp + fn).alias("recall"), ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"))


def group_fairness(df: DataFrame, group: Column, truth: str, predicted: str) -> DataFrame:
    """(grp, n, actual_rate, predicted_rate, accuracy) of each group that has rows."""
    one = lambda c: F.avg((F.col(c) == 1).cast("double"))
    hit = F.avg((F.col(truth) == F.col(predicted)).cast("double"))
    return df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n"), one(truth).alias("actual_rate"), one(predicted).alias("predicted_rate"), hit.alias("accuracy"))


def parity(fairness: DataFrame, a: str, b: str, limit: float) -> DataFrame:
    """(difference, passes): distance of two groups' predicted rates; both null if a group is missing."""
    rate = lambda g: F.max(F.when(F.col("grp") == g, F.col("predicted_rate")))
    return fairness.agg(F.abs(rate(a) - rate(b)).alias("difference")).withColumn("passes", F.col("difference") < limit)


def latency_summary(df: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """(n, mean, least, most, quantile): the quantile is the sorted value at place int(share * n), counted from 0.

    The values are grouped and ranked in slices, so neither a task nor a list holds them all.
    """
    known = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    counts = known.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    run = sliced_running(counts, [], quantile_slices(counts, F.col("v")), [F.col("v")], {"upto": F.col("c")})
    whole = known.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
    n = scalars(known, n=F.count(F.lit(1)))["n"]
    place = F.least(F.floor(F.lit(share) * n), n - 1)
    return whole.withColumn("quantile", scalars(run.filter(F.col("upto") > place), v=F.min("v"))["v"])


def best_by(df: DataFrame, score: str, order: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """The row with the highest score, the first in `order` among equals; null scores lose. Folds before the shuffle."""
    rank = F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))).alias("s"), (-F.col(order).cast("double")).alias("o"))
    return df.groupBy(*groups).agg(F.max_by(F.struct(*df.columns), rank).alias("r")).select("r.*")


def daily_pivot(df: DataFrame, moment: str, column: str, values: list[str]) -> DataFrame:
    """Per day with rows: the count of each listed value, 0 without; other values are not counted."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.groupBy(F.to_date(moment).alias("day")).agg(*counts)


def pivot_counts(df: DataFrame, key: Column, name: str, column: str, values: list[str]) -> DataFrame:
    """Per key: the count of each listed value, 0 without."""
    return df.groupBy(key.alias(name)).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def histogram_quantiles(df: DataFrame, value: str, bounds: list[float], shares: dict[str, float]) -> DataFrame:
    """Quantiles from cumulative buckets, interpolated within the bucket; values above the last bound count as it."""
    edges = [0.0, *bounds]
    counts = [F.count_if(F.col(value) <= b).alias(f"le{i}") for i, b in enumerate(bounds)]
    row = df.filter(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n"), *counts)
    out = []
    for name, q in shares.items():
        rank, expr = F.lit(q) * F.col("n"), F.lit(bounds[-1])
        for i in reversed(range(len(bounds))):
            below = F.col(f"le{i - 1}") if i else F.lit(0)
            inside = F.col(f"le{i}") - below
            expr = F.when(F.col(f"le{i}") >= rank, F.lit(edges[i]) + (edges[i + 1] - edges[i]) * F.try_divide(rank - below, inside.cast("double"))).otherwise(expr)
        out.append(expr.alias(name))
    return row.select("n", *out)


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key in the given order. A maximum, not a window: it folds before the shuffle."""
    rank = F.struct(*[F.col(c) for c in order])
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*df.columns), rank).alias("r")).select("r.*")


def ranked_versions(df: DataFrame, version: str) -> DataFrame:
    """Rows in numeric order of a version kept as text, with their place. Registries are small; one window over them is meant."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.try_to_number(version, F.lit("999999999")).cast("int"))))
