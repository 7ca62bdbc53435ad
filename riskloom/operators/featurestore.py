"""Feature store: online lookup of the latest row, and joins as of a point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.metrics import latest_per_key
from riskloom.operators.skew import quantile_slices


def prepared(rows: DataFrame, key: str = "hash", event_time: str = "date") -> DataFrame:
    """Feature rows with `commit_hash` and a timestamp `event_time`; rows without a readable time are dropped."""
    out = rows if "commit_hash" in rows.columns else rows.withColumn("commit_hash", F.col(key))
    if dict(out.dtypes)[event_time] == "string":
        out = out.withColumn(event_time, F.try_to_timestamp(event_time).cast("timestamp_ntz"))
    return out.filter(F.col(event_time).isNotNull())


def unreadable(rows: DataFrame, event_time: str = "date") -> DataFrame:
    """(n_rows, dropped): how many rows `prepared` drops for want of a readable time. One pass, nothing but two counts is shuffled."""
    moment = F.try_to_timestamp(event_time) if dict(rows.dtypes)[event_time] == "string" else F.col(event_time)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(moment.isNull()).alias("dropped"))


def online(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The online table: the last row per key."""
    return latest_per_key(rows, key, *order)


def lookup(requests: DataFrame, store: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Requests (key, position) with the features of each key, null where the store has none. The planner broadcasts the side whose size allows it."""
    right = store.select(F.col(key).alias("__key"), *columns)
    return requests.join(right, requests[key] == right["__key"], "left").drop("__key")


def as_of(events: DataFrame, features: DataFrame, key: str, event_time: str, event_id: str, feature_time: str, feature_id: str, ttl: str, columns: list[str]) -> DataFrame:
    """Each event with the features of its key's last feature row at or before it, not older than `ttl`; else nulls.

    One sort of both sides together instead of a range join: events and features
    are one stream per key, and the last feature row is carried forward. The
    stream of a key is cut into slices of time, so that no task sorts a whole hot
    key; the last feature row of each slice, one per slice, is carried into the
    later ones. The work is linear, however many feature rows an event has before
    it. A row with a null key gets nulls.
    """
    kind = lambda df, *c: df.select(F.struct(*c)).schema[0].dataType
    asked = events.filter(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col(event_time).alias("__t"), F.lit(1).alias("__side"), F.col(event_id).cast("string").alias("__i"), F.struct(*events.columns).alias("__e"), F.lit(None).cast(kind(features, feature_time, *columns)).alias("__f"))
    known = features.filter(F.col(key).isNotNull() & F.col(feature_time).isNotNull()).select(F.col(key).alias("__k"), F.col(feature_time).alias("__t"), F.lit(0).alias("__side"), F.lpad(F.col(feature_id).cast("string"), 40, "0").alias("__i"), F.lit(None).cast(kind(events, *events.columns)).alias("__e"), F.struct(feature_time, *columns).alias("__f"))
    both = asked.unionByName(known)
    both = both.withColumn("__slice", quantile_slices(both, F.unix_micros(F.col("__t").cast("timestamp"))))
    within = Window.partitionBy("__k", "__slice").orderBy("__t", "__side", "__i").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(F.col("__k").alias("__key"), F.col("__slice").alias("__at")).agg(F.max_by("__f", F.when(F.col("__side") == 0, F.struct("__t", "__i"))).alias("__end"))
    ends = ends.select("__key", "__at", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    carried = both.withColumn("__own", F.last("__f", ignorenulls=True).over(within)).filter("__side = 1").join(ends, (F.col("__k") == F.col("__key")) & (F.col("__slice") == F.col("__at")))
    carried = carried.withColumn("__last", F.coalesce("__own", "__before"))
    fresh = F.col(f"__last.{feature_time}") >= F.col("__t") - F.expr(f"interval {ttl}")
    matched = carried.select("__e.*", *[F.when(fresh, F.col(f"__last.{c}")).alias(f"feature_{c}") for c in (feature_time, *columns)])
    rest = events.filter(F.col(key).isNull())
    return matched.unionByName(rest.select("*", *[F.lit(None).cast(matched.schema[f"feature_{c}"].dataType).alias(f"feature_{c}") for c in (feature_time, *columns)]))
