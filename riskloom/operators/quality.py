"""Data-quality checks. A check is a row (check_name, severity, passed, measured), so checks combine by union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import violations
from riskloom.operators.skew import quantile_slices, sliced_running
from riskloom.schemas import FEATURES

NUMERIC = ("int", "bigint", "float", "double")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that the table lacks, in order."""
    return [c for c in required if c not in df.columns]


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    """Columns of a 32- or 64-bit number that are not on the list."""
    return [c for c, t in df.dtypes if t in NUMERIC and c not in but]


def features_and_target(df: DataFrame, columns: Sequence[str], target: str = "risky") -> DataFrame:
    """The feature columns in order and the target; raises ValueError with the names of missing columns."""
    if missing := missing_columns(df, [*columns, target]):
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns, target)


def with_alias(df: DataFrame, column: str, alias: str) -> DataFrame:
    """The column under a second name, unless a column of that name is there."""
    return df if alias in df.columns else df.withColumn(alias, F.col(column))


def column_after(df: DataFrame, column: str, anchor: str) -> DataFrame:
    """The table with one column moved behind another."""
    rest = [c for c in df.columns if c != column]
    at = rest.index(anchor) + 1
    return df.select(*rest[:at], column, *rest[at:])


def table_checks(df: DataFrame, required: Sequence[str], target: str = "risky", min_rows: int = 100, min_positive: float = 0.05) -> DataFrame:
    """Row count, target, required columns (errors) and class balance (a warning), in one pass over the target."""
    missing = missing_columns(df, required)
    has = target in df.columns
    stats = df.agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col(target) == 1).cast("double")) if has else F.lit(None).cast("double")).alias("share"))
    row = lambda name, severity, passed, measured: F.struct(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), passed.alias("passed"), measured.cast("double").alias("measured"))
    rows = F.array(
        row("min_rows", "error", F.col("n") >= min_rows, F.col("n")),
        row("target_present", "error", F.lit(has), F.lit(int(has))),
        row("class_balance", "warning", F.coalesce(F.col("share") >= min_positive, F.lit(False)), F.col("share")),
        row("required_columns", "error", F.lit(not missing), F.lit(len(missing))),
    )
    return stats.select(F.inline(rows))


def request_violations(df: DataFrame) -> DataFrame:
    """Adds `violations`: names of features that are missing or out of range."""
    limits = {"hour_of_day": (0, 23), "day_of_week": (0, 6), "is_fix_bug_revert": (0, 1)}
    return df.withColumn("violations", violations({c: F.col(c).between(*limits[c]) if c in limits else F.col(c) >= 0 for c in FEATURES}))


def response_violations(df: DataFrame) -> DataFrame:
    """Adds `violations`: names of response fields that are missing, null or out of range."""
    rules = {"risk_score": F.col("risk_score").cast("double").between(0, 1), "risk_label": F.col("risk_label").isin("low", "medium", "high")}
    return df.withColumn("violations", violations(rules))


def key_leakage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys in both parts."""
    return train.select(key).filter(F.col(key).isNotNull()).join(test.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_semi").distinct()


def content_leakage(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, n_train, n_test): contents that stand in both parts, nulls equal. Contents are counted first, so repeated ones meet once."""
    a = train.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_train"))
    b = test.groupBy(*[F.col(c).alias(f"__{c}") for c in columns]).agg(F.count(F.lit(1)).alias("n_test"))
    same = F.lit(True)
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(b, same).select(*columns, "n_train", "n_test")


def drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per column: (column_name, n_reference, n_current, statistic, p_value, drifted).

    Values are counted per part first; running counts over values work in slices.
    The p-value is the asymptotic series, of which 20 terms are summed. Nulls are no values.
    """
    long = None
    for df, r, c in ((reference, 1, 0), (current, 0, 1)):
        part = df.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).cast("double").alias("v")) for x in columns])).alias("x")).select("x.*").filter("v is not null and not isnan(v)")
        part = part.groupBy("column_name", "v").agg((F.count(F.lit(1)) * r).alias("r"), (F.count(F.lit(1)) * c).alias("c"))
        long = part if long is None else long.unionByName(part)
    counts = long.groupBy("column_name", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    run = sliced_running(counts, ["column_name"], quantile_slices(counts, F.col("v")), [F.col("v")], {"run_r": F.col("r"), "run_c": F.col("c")})
    total = counts.groupBy(F.col("column_name").alias("__c")).agg(F.sum("r").alias("n_reference"), F.sum("c").alias("n_current"))
    gap = F.abs(F.try_divide("run_r", F.col("n_reference").cast("double")) - F.try_divide("run_c", F.col("n_current").cast("double")))
    ks = run.join(F.broadcast(total), F.col("column_name") == F.col("__c")).groupBy("column_name").agg(F.first("n_reference").alias("n_reference"), F.first("n_current").alias("n_current"), F.max(gap).alias("statistic"))  # a row per column
    return ks.withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n_reference"), F.col("n_current"))).withColumn("drifted", F.col("p_value") < alpha)


def ks_p_value(statistic, n, m):
    """The asymptotic two-sided p-value."""
    en = F.sqrt(F.try_divide((n * m).cast("double"), (n + m).cast("double")))
    lam = (en + 0.12 + 0.11 / en) * statistic
    series = sum((2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))


def drift_share(report: DataFrame) -> DataFrame:
    """(columns, drifted, share)."""
    return report.agg(F.count(F.lit(1)).alias("columns"), F.count_if("drifted").alias("drifted")).withColumn("share", F.try_divide(F.col("drifted").cast("double"), F.col("columns").cast("double")))
