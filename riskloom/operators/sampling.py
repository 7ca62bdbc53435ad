"""Splits and samples that are the same whenever they are made: rows are ordered by a hash of key and seed.

Ranks over whole classes or tables come from slices of that hash, so no task
sorts a class. Defined results: a null class is a class; keys have to be unique,
equal keys share their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.skew import pieces, quantile_slices, sliced_running
from riskloom.session import scalars


def seeded(key: str, seed: int) -> Column:
    """The place of a row in the shuffle of a seed, as text."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def _placed(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, Column]:
    """With the place of each row, and the slice of places it lies in: two slices or more for each shuffle partition."""
    digits = len(f"{pieces(df, 256, 16**6) - 1:x}")
    return df.withColumn("__place", seeded(key, seed)), F.conv(F.substring("__place", 1, digits), 16, 10).cast("int")


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `is_test`: round(test_share * n) rows of each class are 1. A class's size comes with the offsets of its slices."""
    placed, part = _placed(df, key, seed)
    ranked = sliced_running(placed, [label], part, [F.col("__place"), F.col(key)], {"__rank": F.lit(1).cast("bigint")}, {"__rank": "__size"})
    return ranked.withColumn("is_test", (F.col("__rank") <= F.round(F.lit(test_share) * F.col("__size"))).cast("int")).select(*[c for c in df.columns if c != "is_test"], "is_test")


def stratified_sample(df: DataFrame, key: str, label: str, size: int, seed: int = 42) -> DataFrame:
    """About `size` rows with the table's share of label 1: int(size * share) of them, the rest others, as far as there are any."""
    known = df.filter(F.col(label).isNotNull())
    ones = F.floor(F.lit(float(size)) * scalars(known, share=F.avg((F.col(label) == 1).cast("double")))["share"])
    quota = F.when(F.col(label) == 1, ones).otherwise(F.lit(size) - ones)
    placed, part = _placed(known, key, seed)
    placed = placed.withColumn("__part", part)
    # Only the first slices of a class, which hold its quota, are ranked.
    before = Window.partitionBy("__one").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy((F.col(label) == 1).alias("__one"), F.col("__part").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    first = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).filter(F.col("__before") < F.when(F.col("__one"), ones).otherwise(F.lit(size) - ones))
    kept = placed.join(first, (F.col(label) == 1).eqNullSafe(F.col("__one")) & (F.col("__part") == F.col("__at")), "left_semi")
    ranked = kept.withColumn("__rank", F.row_number().over(Window.partitionBy(label).orderBy("__place", key)))
    return ranked.filter(F.col("__rank") <= quota).select(*df.columns)


def chronological_split(df: DataFrame, date: str, tie: str, share: float = 0.8) -> DataFrame:
    """Adds `part`: the first int(share * n) rows in order of date are `reference`, the others `current`."""
    total = scalars(df, n=F.count(F.lit(1)))["n"]
    number = F.unix_micros(F.col(date).cast("timestamp"))
    ranked = sliced_running(df, [], quantile_slices(df, number), [F.col(date).asc_nulls_first(), F.col(tie)], {"__rank": F.lit(1).cast("bigint")})
    part = F.when(F.col("__rank") <= F.floor(F.lit(share) * total), "reference").otherwise("current")
    return ranked.withColumn("part", part).select(*[c for c in df.columns if c != "part"], "part")


def fold(df: DataFrame, group: str, held_out: str) -> tuple[DataFrame, DataFrame]:
    """Training and test part with one group held out."""
    test = F.col(group).eqNullSafe(F.lit(held_out))
    return df.filter(~test), df.filter(test)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in the order of a seed, sorted by range over all tasks."""
    return df.orderBy(seeded(key, seed), key)
