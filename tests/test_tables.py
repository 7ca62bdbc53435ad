from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import featurestore, issues, metrics, models, quality, registry, sampling
from riskloom.schemas import FEATURES, ISSUE, MODEL_VERSION
from riskloom.sources import readers, sinks

NOW = datetime(2024, 5, 1)


def make_issues(spark):
    rows = [(i, i % 4, "drift" if i % 2 else "schema", "r" if i else None, s, None, None, None, datetime(2024, 4, 1 + i), NOW) for i, s in enumerate(["open", "resolved", "odd", "open"])]
    return spark.createDataFrame(rows, ISSUE)


def test_issue_tables(spark):
    df = make_issues(spark)
    assert issues.totals(df).first().asDict() == {"open": 2, "resolved": 1, "total": 3}
    assert [r.id for r in issues.page(df, 2, 1).collect()] == [2, 1]
    assert {r.gate: r.open for r in issues.by_gate(df).collect()} == {"gate_0": 1, "gate_1": 0, "gate_2": 0, "gate_3": 1}
    assert issues.filtered(df, "", None).count() == 4 and issues.filtered(df, "open", "r").count() == 1
    assert issues.toggled(df, 2, NOW).filter("id = 2").first().status == "open"
    assert issues.toggled(df, 0, NOW).filter("id = 0").first().status == "resolved"
    assert issues.new_rows(df).count() == 3 and issues.totals(df.limit(0)).first().total == 0
    assert '"repo":null' in issues.as_json(df).filter("id = 0").first().json


def test_metrics_with_zero_divisions_and_empty_groups(spark):
    df = spark.createDataFrame([(1, 0, 9), (0, 0, 9), (1, 0, 9), (None, 1, 0)], "t int, p int, prior int")
    m = metrics.classification(df, "t", "p").first()
    assert (m.n, m.precision, m.recall, m.f1) == (3, 0.0, 0.0, 0.0) and abs(m.accuracy - 1 / 3) < 1e-12
    f = metrics.group_fairness(df, F.when(F.col("prior") < 5, "new").otherwise("old"), "t", "p")
    assert metrics.parity(f, "new", "old", 0.1).first().difference is None
    b = metrics.class_balance(df, "t").first()
    assert (b.n, b.positives, b.negatives) == (3, 2, 1)


def test_latency_takes_the_place_of_the_sorted_list(spark):
    values = [float(x) for x in range(10)] + [None]
    r = metrics.latency_summary(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert r["quantile"] == 9.0 and r.n == 10 and r["mean"] == 4.5
    assert metrics.latency_summary(spark.createDataFrame([], "v double"), "v").first().n == 0


def test_best_by_prefers_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 0), ("c", None, 2)], "name string, f1 double, ord int")
    assert registry.best_candidate(df).first().name == "b"


def test_promotion(spark):
    v = lambda *rows: spark.createDataFrame(rows, MODEL_VERSION)
    assert registry.decide(v(("1", "r", "None", None)), "1").first().promote
    old = ("9", "r9", "Production", 0.7)
    assert not registry.decide(v(old, ("10", "r", "None", 0.7)), "10").first().promote
    assert not registry.decide(v(old, ("10", "r", "None", None)), "10").first().promote
    done = {r.version: r.stage for r in registry.promoted(v(old, ("10", "r", "None", 0.8)), "10").collect()}
    assert done == {"9": "Archived", "10": "Production"}
    assert registry.production(v(old, ("10", "x", "Production", 0.1))).first().version == "10"
    assert registry.production(v(("1", "r", "None", 0.1))).count() == 0 and registry.latest(v(old, ("x", "r", "None", 0.1))).first().version == "9"


def test_as_of_join(spark):
    t = lambda d, h=0: datetime(2024, 1, d, h)
    e = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(2)), (3, "b", t(5)), (4, None, t(5)), (5, "a", t(9))], "eid int, k string, t timestamp_ntz")
    f = spark.createDataFrame([(1, "a", t(3), 1.0), (2, "a", t(5), 2.0), (3, "a", t(6), 3.0), (4, None, t(1), 9.0), (5, "b", None, 8.0)], "fid int, k string, t timestamp_ntz, v double")
    got = {r.eid: r.feature_v for r in featurestore.as_of(e, f, "k", "t", "eid", "t", "fid", "2 days", ["v"]).collect()}
    assert got == {1: 2.0, 2: None, 3: None, 4: None, 5: None}


def test_online_lookup_and_preparation(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("b", "bad", 3), (None, "2024-01-03", 4)], "hash string, date string, v int")
    ready = featurestore.prepared(rows)
    assert ready.count() == 3
    store = featurestore.online(ready, "commit_hash", "date")
    asked = spark.createDataFrame([("a", 1), ("z", 2)], "commit_hash string, place int")
    assert {(r.commit_hash, r.v) for r in featurestore.lookup(asked, store, "commit_hash", ["v"]).collect()} == {("a", 2), ("z", None)}


def test_table_checks(spark):
    df = spark.createDataFrame([(0,)] * 99 + [(1,)], "risky int")
    got = {r.check_name: r.passed for r in quality.table_checks(df, ["risky", "hash"]).collect()}
    assert got == {"min_rows": True, "target_present": True, "class_balance": False, "required_columns": False}
    none = {r.check_name: r.passed for r in quality.table_checks(df.limit(0).drop("risky"), []).collect()}
    assert not none["min_rows"] and not none["target_present"] and none["required_columns"]
    with pytest.raises(ValueError, match="hash"):
        quality.features_and_target(df, ["hash"])


def test_request_ranges(spark):
    good = (5, 2, 1, 1, 500, 14, 1, 25, 0)
    df = spark.createDataFrame([good, (-1, *good[1:5], 24, 7, 25, 2), (None, *good[1:])], ", ".join(f"{c} int" for c in FEATURES))
    assert [len(r.violations) for r in quality.request_violations(df).collect()] == [0, 4, 1]


def test_drift_of_equal_and_moved_samples(spark):
    a = spark.createDataFrame([(float(i), i % 7) for i in range(200)], "x double, y int")
    b = spark.createDataFrame([(float(i + 150), i % 7) for i in range(200)], "x double, y int")
    got = {r.column_name: r for r in quality.drift(a, b, ["x", "y"]).collect()}
    assert abs(got["x"].statistic - 0.75) < 1e-9 and got["x"].drifted and got["y"].statistic == 0 and not got["y"].drifted
    assert quality.drift_share(quality.drift(a, b, ["x", "y"])).first().share == 0.5


def test_content_leakage_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(None, 1), ("x", 1), ("x", 1)], "m string, n int")
    b = spark.createDataFrame([(None, 1), ("x", 2)], "m string, n int")
    assert [(r.m, r.n_train, r.n_test) for r in quality.content_leakage(a, b, ["m", "n"]).collect()] == [(None, 1, 1)]


def test_splits_have_exact_sizes(spark):
    df = spark.createDataFrame([(i, None if i % 50 == 0 else i % 3 == 0, "old") for i in range(500)], "id int, b boolean, is_test string").withColumn("y", F.col("b").cast("int")).drop("b")
    got = sampling.stratified_split(df, "id", "y")
    sizes = {r.y: (r.n, r.t) for r in got.groupBy("y").agg(F.count("id").alias("n"), F.sum("is_test").alias("t")).collect()}
    assert all(t == int(n * 0.2 + 0.5) for n, t in sizes.values()) and sum(n for n, _ in sizes.values()) == 500
    assert got.select("id", "is_test").orderBy("id").collect() == sampling.stratified_split(df.orderBy(F.desc("id")), "id", "y").select("id", "is_test").orderBy("id").collect()
    assert sampling.stratified_split(df.limit(0), "id", "y").count() == 0
    assert sampling.stratified_sample(df, "id", "y", 100).count() == 100
    train, test = sampling.fold(df, "y", "1")
    assert train.count() + test.count() == 500


def test_column_functions(spark):
    df = spark.createDataFrame([("https://h/a/b.git/", 0.6, 0.29), (None, None, None)], "u string, s double, p double")
    r = df.select(C.repo_name(F.col("u")).alias("n"), C.risk_level(F.col("s")).alias("l"), C.percent(F.col("p")).alias("p"), C.lookup(F.col("u"), {"x": "y"}, "?").alias("m")).collect()
    assert tuple(r[0]) == ("b", "medium", 28, "?") and tuple(r[1]) == (None, None, None, "?")
    w = spark.sql("select timestamp_ntz'2024-01-01 23:00:00' a, timestamp_ntz'2024-01-09 00:00:01' b, timestamp_ntz'2024-01-09 23:00:00' c").select(C.whole_days(F.col("a"), F.col("b")).alias("x"), C.within_days(F.col("a"), F.col("b"), 7).alias("y"), C.within_days(F.col("a"), F.col("c"), 7).alias("z")).first()
    assert tuple(w) == (7, True, False)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\nc', None), ("2", "", 0.5)], "version string, run_id string, f1 double").withColumn("stage", F.lit("None")).select("version", "run_id", "stage", "f1")
    sinks.csv(df, str(tmp_path / "c"))
    assert {r.version: r.run_id for r in readers.csv(spark, str(tmp_path / "c"), MODEL_VERSION).collect()}["1"] == 'a "b"\nc'
    assert readers.cached(spark, str(tmp_path / "none"), MODEL_VERSION, lambda: df) is df
    assert readers.cached(spark, str(tmp_path / "c"), MODEL_VERSION, lambda: None).count() == 2
    sinks.append(df, str(tmp_path / "p"))
    sinks.append(df, str(tmp_path / "p"))
    assert readers.parquet(spark, str(tmp_path / "p"), ["version"]).count() == 4
    assert readers.newest_file(spark, str(tmp_path / "p"), "*.parquet").first().path.endswith(".parquet")
    (tmp_path / "conf.yaml").write_text("a: 1\nlist:\n  - x\n  - y\nmodel:\n  rate: 0.05\n")
    assert readers.config(str(tmp_path / "conf.yaml"), {"b": 2}) == {"b": 2, "a": 1, "list": ["x", "y"], "model": {"rate": 0.05}}
    u = readers.union_repos({"one": df.withColumnRenamed("version", "hash"), "two": None})
    assert u.columns[:2] == ["hash", "source_repo"] and u.count() == 2


def test_models_score_keep_columns_and_reload(spark, tmp_path):
    rows = [(i, *[(i * k) % 11 for k in range(1, 10)], int((i * 3) % 11 > 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} int" for c in FEATURES) + ", risky int")
    model = models.export(models.fit(df, "forest"), str(tmp_path / "m"))
    got = models.scored(model, df.limit(5).withColumn("lines_added", F.lit(None).cast("int")))
    assert got.columns == [*df.columns, "risk_score", "predicted", "risk_label"] and got.filter("lines_added is null").count() == 5
    assert models.importance(spark, model).count() == 9
