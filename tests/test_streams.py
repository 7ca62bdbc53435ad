import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskloom.operators.history import retouched
from riskloom.operators.models import fit
from riskloom.schemas import FEATURES
from riskloom.session import materialise, scalars, shared_dir, spread
from riskloom.streaming import streams

TOUCH = "touch_id long, hash string, source_repo string, new_path string, old_path string, date timestamp_ntz, seq long, ord int"


def test_the_label_keeps_its_state_between_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"h{i // 2}", "r", f"p{rng.randint(0, 12)}", None, datetime(2024, 1, 1) + timedelta(days=i * 0.9), i, 0) for i in range(200)]
    for k in range(4):  # arrive in order of date, in four files
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], TOUCH).coalesce(1).write.mode("append").parquet(str(tmp_path / "touches"))
    stream = spark.readStream.schema(TOUCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "touches"))
    got = {r.hash for r in streams.retouched_once(stream).collect()}
    assert got == {r.hash for r in retouched(spark.createDataFrame(rows, TOUCH)).collect()} and got


def test_sliding_counts_and_scores(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, i % 5), "a" if i % 2 else "b") for i in range(50)]
    spark.createDataFrame(rows, "ts timestamp_ntz, kind string").write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("ts timestamp_ntz, kind string").parquet(str(tmp_path / "events"))
    got = streams.run_once(streams.sliding_counts(stream, "ts", "1 hour", "2 hours", "1 hour", "kind"), "complete")
    assert got.agg(F.sum("events")).first()[0] == 100
    data = [(i, *[(i * k) % 7 for k in range(1, 10)], i % 2) for i in range(80)]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{c} int" for c in FEATURES) + ", risky int")
    df.write.parquet(str(tmp_path / "requests"))
    requests = spark.readStream.schema(df.schema).parquet(str(tmp_path / "requests"))
    assert streams.run_once(streams.scored_stream(requests, fit(df, "logistic")), "append").filter("risk_label is not null").count() == 80


def test_session_helpers(spark):
    df = spark.range(10)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialise(df.withColumn("x", F.rand()), "t").count() == 10
    m = scalars(df, n=F.count("id"), top=F.max("id"))
    assert df.filter(F.col("id") < m["top"]).count() == 9
    one = df.coalesce(1)
    assert spread(one, "id").count() == 10
