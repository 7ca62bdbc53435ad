"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

Rows of heavy keys get a salt, partial results are made per (key, salt) and
merged by key, so no task works on one whole heavy key. The salt is a hash of
the row, not `rand()`: a task that is run again after a lost executor has to
send each row to the same place. Wholly equal rows share a salt; those fold
together before the shuffle, as partial aggregation does.

Defined results: a null key is a group of its own, as in SQL; an empty table
gives an empty result; extra columns are ignored unless named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import scalars

#: Name of the salt column while an aggregation runs.
SALT = "__salt"


def heavy_keys(df: DataFrame, key: str, min_share: float) -> DataFrame:
    """(heavy_key, rows, share) of the non-null keys with at least `min_share` of all rows.

    At most 1 / min_share rows, whatever the input: shares sum to one at most.
    Partial counts leave each task before the shuffle, so this pass has no hot task.
    """
    counts = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    share = F.col("__n") / scalars(df, n=F.count(F.lit(1)))["n"]
    return counts.filter("__key is not null").filter(share >= min_share).select(F.col("__key").alias("heavy_key"), F.col("__n").alias("rows"), share.alias("share"))


def with_salt(df: DataFrame, key: str, salts: int | None = None, heavy_share: float = 0.01, salt_on: Sequence[str] | None = None) -> DataFrame:
    """Adds the salt: 0 .. salts - 1 in rows of heavy or null keys, 0 in others; by default two salts for each shuffle partition.

    The list of heavy keys is broadcast; it has at most 1 / heavy_share rows.
    """
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (salt_on or df.columns)]), F.lit(salts or pieces(df, 32, 16_384))).cast("int")
    heavy = heavy_keys(df, key, heavy_share).select(F.col("heavy_key").alias("__heavy"))
    joined = df.join(F.broadcast(heavy), df[key] == F.col("__heavy"), "left")
    is_hot = F.col("__heavy").isNotNull() | F.col(key).isNull()
    return joined.withColumn(SALT, F.when(is_hot, spread).otherwise(F.lit(0))).drop("__heavy")


def salted_aggregate(df: DataFrame, key: str, partial: dict[str, Column], merge: dict[str, Column], salts: int | None = None, heavy_share: float = 0.01, salt_on: Sequence[str] | None = None) -> DataFrame:
    """`partial` per (key, salt), then `merge` per key over the partial columns."""
    first = with_salt(df, key, salts, heavy_share, salt_on).groupBy(key, SALT).agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(key).agg(*[c.alias(n) for n, c in merge.items()])


def salted_count(df: DataFrame, key: str, salt_on: Sequence[str], salts: int | None = None, heavy_share: float = 0.01) -> DataFrame:
    """(key, n): rows per key."""
    return salted_aggregate(df.select(key, *[c for c in salt_on if c != key]), key, {"n0": F.count(F.lit(1))}, {"n": F.sum("n0")}, salts, heavy_share, salt_on)


def skewed_join(many: DataFrame, few: DataFrame, key: str, salt_on: Sequence[str], how: str = "inner", heavy_share: float = 0.01) -> DataFrame:
    """`many` joined with `few` (inner or left) on `key`, where a few keys may hold most rows of `many`.

    Rows of `many` with a heavy key are spread over salts by a hash of `salt_on`,
    and the rows of `few` with that key are repeated once for each salt. The list of
    heavy keys is broadcast; it has at most 1 / heavy_share rows. Null keys meet nothing.
    """
    salts = pieces(many, 32, 16_384)
    heavy = F.broadcast(heavy_keys(many, key, heavy_share).select(F.col("heavy_key").alias("__heavy")))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in salt_on]), F.lit(salts)).cast("int")
    at = many.join(heavy, many[key] == F.col("__heavy"), "left").withColumn(SALT, F.when(F.col("__heavy").isNotNull() | F.col(key).isNull(), spread).otherwise(F.lit(0))).drop("__heavy")
    to = few.filter(F.col(key).isNotNull()).join(heavy, few[key] == F.col("__heavy"), "left")
    to = to.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.when(F.col("__heavy").isNotNull(), F.lit(salts - 1)).otherwise(F.lit(0))))).drop("__heavy")
    return at.join(to, [key, SALT], how).drop(SALT)


def pieces(df: DataFrame, least: int, most: int) -> int:
    """Into how many pieces a hot group is cut: two for each shuffle partition, within bounds."""
    return min(most, max(least, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def quantile_slices(df: DataFrame, column: Column, slices: int | None = None) -> Column:
    """The number of the slice a value lies in, cut at about equal counts; nulls lie in slice 0.

    At most `slices` cuts (64 to 1024, by the shuffle partitions) come to the
    driver; a row finds its slice in a binary tree of comparisons.
    """
    value, slices = column.cast("double"), slices or pieces(df, 64, 1024)
    cuts = sorted(set(df.select(value.alias("v")).approxQuantile("v", [i / slices for i in range(1, slices)], min(0.002, 0.25 / slices))))

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < cuts[middle], place(low, middle)).otherwise(place(middle + 1, high))

    return F.when(value.isNull(), F.lit(0)).otherwise(place(0, len(cuts)))


def sliced_running(df: DataFrame, keys: Sequence[str], slice_no: Column, order: Sequence[Column], sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """Adds running sums within `keys` in the given order, the row included, without a task over a whole group. `totals` names columns for whole sums of the group.

    `slice_no` has to rise with the order. A window runs within (keys, slice)
    only; the sums of a group's earlier slices, one row per slice, are added.
    Null keys are a group. Without keys the whole table is the group.
    """
    names = list(sums)
    work = df.withColumn("__slice", slice_no)
    for n in names:
        work = work.withColumn(f"__v_{n}", sums[n])
    before = Window.partitionBy(*[f"__k_{k}" for k in keys]).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    per = work.groupBy(*keys, "__slice").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    per = per.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__at"), *[f"__s_{n}" for n in names])
    per = per.select(*[f"__k_{k}" for k in keys], "__at", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in names], *[F.sum(f"__s_{n}").over(Window.partitionBy(*[f"__k_{k}" for k in keys])).alias(t) for n, t in (totals or {}).items()])
    own = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n in names:
        work = work.withColumn(f"__r_{n}", F.sum(f"__v_{n}").over(own))
    same = F.col("__slice") == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    done = work.join(per if keys else F.broadcast(per), same)  # without keys: one row per slice
    return done.select(*[F.col(c) for c in df.columns if c not in names], *[(F.coalesce(F.col(f"__r_{n}"), F.lit(0)) + F.col(f"__b_{n}")).alias(n) for n in names], *(totals or {}).values())


def earlier_rows(df: DataFrame, key: str, order: str, tie: str, out: str, slices: int | None = None) -> DataFrame:
    """Adds the number of earlier rows of the same key, in the order (order, tie).

    A row with a null key gets null. `tie` has to be unique within equal values
    of `order`. Rows with a null `order` come first, in slices of their own by `tie`.
    """
    keyed = df.filter(F.col(key).isNotNull())
    unordered = F.col(order).isNull()
    behind = (slices or pieces(df, 64, 1024)) + 1
    part = F.when(unordered, quantile_slices(keyed.filter(unordered), F.col(tie), slices)).otherwise(quantile_slices(keyed, F.col(order), slices) + behind)
    done = sliced_running(keyed, [key], part, [F.col(order).asc_nulls_first(), F.col(tie)], {out: F.lit(1).cast("bigint")})
    rest = df.filter(F.col(key).isNull()).withColumn(out, F.lit(None).cast("bigint"))
    kept = [c for c in df.columns if c != out]
    return done.withColumn(out, F.col(out) - 1).select(*kept, out).unionByName(rest.select(*kept, out))


def next_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, slices: int | None = None) -> DataFrame:
    """Adds `value` of the next row of the same keys, in the order of `order` (its first column has to be a timestamp or number).

    Works in slices of the first order column: `lead` within (keys, slice), and
    the last row of a slice takes the first value of the group's next slice.
    """
    first = F.col(order[0])
    number = F.unix_micros(first.cast("timestamp")) if dict(df.dtypes)[order[0]].startswith("timestamp") else first
    work = df.withColumn("__slice", quantile_slices(df, number, slices))
    heads = work.groupBy(*keys, "__slice").agg(F.min(F.struct(*order, F.col(value).alias("__value")))["__value"].alias("__head"))
    later = Window.partitionBy(*keys).orderBy("__slice")
    heads = heads.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__at"), F.lead("__head").over(later).alias("__next_head"))
    own = Window.partitionBy(*keys, "__slice").orderBy(*order)
    same = F.col("__slice") == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    led = work.withColumn("__lead", F.lead(value).over(own)).withColumn("__last", F.lead(F.lit(True)).over(own).isNull())
    return led.join(heads, same).withColumn(out, F.when(F.col("__last"), F.col("__next_head")).otherwise(F.col("__lead"))).select(*[c for c in df.columns if c != out], out)
