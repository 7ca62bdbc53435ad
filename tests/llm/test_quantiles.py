import math
import random

from pyspark.sql import functions as F

from riskloom.llm.quantiles import combine, daily_and_combined, frequencies, percentiles

P = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


def make(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "hot", "x", None]), f"2024-01-0{rng.randint(1, 3)}", rng.choice([None, -4, 0, rng.randint(0, 9), rng.randint(0, 100_000)]), 1) for _ in range(900)]
    return data, spark.createDataFrame(data, "g string, d string, v int, period int")


def exact(values, p):
    own = sorted(values)
    return float(own[max(math.ceil(p * len(own)), 1) - 1])


def test_exact_percentiles_of_groups_and_days(spark):
    data, df = make(spark)
    got = {(r.g, str(r.day) if r.day else None): r for r in daily_and_combined(df, F.to_date("d"), "g", ["v"], P).collect()}
    for (g, day), r in got.items():
        values = [v for a, d, v, _ in data if a == g and (day is None or d == day) and v is not None and v >= 0]
        assert r.n_values == len(values) and all(r[c] == exact(values, p) for c, p in P.items())
    assert len(got) == 12


def test_states_of_parts_combine(spark):
    _, df = make(spark)
    parts = [frequencies(df.filter(F.col("d") == f"2024-01-0{k}"), F.col("d"), ["g"], ["v"]) for k in (1, 2, 3)]
    one = {(r.g, r.p50) for r in percentiles(combine(*parts), ["g"], P).collect()}
    assert one == {(r.g, r.p50) for r in percentiles(frequencies(df, F.lit(1), ["g"], ["v"]), ["g"], P).collect()}


def test_bounded_error(spark):
    data, df = make(spark)
    got = {r.g: r for r in percentiles(frequencies(df, F.lit(1), ["g"], ["v"], error=0.02), ["g"], P).collect()}
    for g, r in got.items():
        values = [v for a, _, v, _ in data if a == g and v is not None and v >= 0]
        for c, p in P.items():
            want = exact(values, p)
            assert abs(r[c] - want) <= 0.02 * want + 1e-9


def test_empty_and_valueless(spark):
    df = spark.createDataFrame([("a", None), ("a", -1)], "g string, v int")
    assert percentiles(frequencies(df, F.lit(1), ["g"], ["v"]), ["g"], P).count() == 0
