import random

from pyspark.sql import functions as F

from riskloom.operators.skew import earlier_rows, heavy_keys, next_in_group, quantile_slices, salted_aggregate, salted_count, sliced_running


def rows(n=600):
    random.seed(1)
    keys = ["hot"] * 5 + ["a", "b", None]
    return [(i, random.choice(keys), random.randint(0, 40)) for i in range(n)]


def test_heavy_keys_are_the_ones_at_or_above_the_share(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id int, k string")
    assert {(r.heavy_key, r.rows) for r in heavy_keys(df, "k", 0.5).collect()} == {("x", 2)}


def test_salted_count_equals_a_plain_count(spark):
    data = rows()
    df = spark.createDataFrame(data, "id int, k string, v int")
    got = {r.k: r.n for r in salted_count(df, "k", ["id"], salts=7).collect()}
    want = {}
    for _, k, _ in data:
        want[k] = want.get(k, 0) + 1
    assert got == want


def test_salted_count_of_repeated_rows_nulls_and_an_empty_table(spark):
    same = spark.createDataFrame([("x",)] * 50 + [(None,)] * 3, "k string")
    assert {r.k: r.n for r in salted_count(same, "k", ["k"]).collect()} == {"x": 50, None: 3}
    assert salted_count(same.limit(0), "k", ["k"]).count() == 0


def test_heavy_rows_are_spread_over_salts(spark):
    from riskloom.operators.skew import SALT, with_salt

    df = spark.createDataFrame([(i, "hot" if i % 3 else "rare%d" % i) for i in range(300)], "id int, k string")
    salts = with_salt(df, "k", 8, 0.1, ["id"]).groupBy("k").agg(F.count_distinct(SALT).alias("s"))
    assert {r.s for r in salts.collect() if r.k == "hot"} == {8}
    assert {r.s for r in salts.collect() if r.k != "hot"} == {1}


def test_salted_aggregate_merges_partials(spark):
    data = rows()
    df = spark.createDataFrame(data, "id int, k string, v int")
    got = {r.k: (r.s, r.m) for r in salted_aggregate(df, "k", {"s0": F.sum("v"), "m0": F.max("v")}, {"s": F.sum("s0"), "m": F.max("m0")}).collect()}
    for k in {k for _, k, _ in data}:
        own = [v for _, x, v in data if x == k]
        assert got[k] == (sum(own), max(own))


def test_earlier_rows_with_ties_nulls_and_clashing_columns(spark):
    data = [(i, random.Random(i).choice(["a", "b", None]), i // 4 if i % 9 else None, "x") for i in range(200)]
    df = spark.createDataFrame(data, "id int, k string, o int, earlier string")
    got = {r.id: r.earlier for r in earlier_rows(df, "k", "o", "id", "earlier", slices=6).collect()}
    order = sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    seen = {}
    for i, k, _, _ in order:
        assert got[i] == (None if k is None else seen.get(k, 0))
        seen[k] = seen.get(k, 0) + 1


def test_next_in_group_equals_a_window(spark):
    data = [(i, random.Random(i).choice(["a", "a", "a", "b", None]), random.Random(i * 7).randint(0, 30)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, k string, o int")
    got = {r.id: r.nx for r in next_in_group(df, ["k"], ["o", "id"], "o", "nx", slices=5).collect()}
    by = {}
    for i, k, o in data:
        by.setdefault(k, []).append((o, i))
    for own in by.values():
        own.sort()
        for (o, i), nxt in zip(own, own[1:] + [(None, None)]):
            assert got[i] == nxt[0]


def test_running_sums_over_the_whole_table(spark):
    df = spark.createDataFrame([(i, i % 17) for i in range(100)], "id int, v int")
    got = {r.id: r.s for r in sliced_running(df, [], quantile_slices(df, F.col("id"), 5), [F.col("id")], {"s": F.col("v")}).collect()}
    total = 0
    for i in range(100):
        total += i % 17
        assert got[i] == total
    empty = df.limit(0)
    assert sliced_running(empty, [], quantile_slices(empty, F.col("id"), 5), [F.col("id")], {"s": F.col("v")}).count() == 0


def test_many_rows_without_an_order_lie_in_slices(spark):
    rows = [(i, "hot" if i % 3 else "other", None if i % 2 else i % 40) for i in range(600)]
    got = {r.id: r.n for r in earlier_rows(spark.createDataFrame(rows, "id int, k string, at int"), "k", "at", "id", "n", slices=8).collect()}
    want = {}
    for key in ("hot", "other"):
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        want |= {r[0]: place for place, r in enumerate(own)}
    assert got == want
