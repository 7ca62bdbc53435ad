import base64
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm.mixing import BINS, PATTERN, TOKENIZER, count_tokens, encoder, mix_report, mix_sources, plan_mix, poisson_cdf, rate_for, steps_for

SHARES = [("a", 0.5, 1), ("b_c", 0.3, 4), ("tiny", 0.1, 2), ("none", 0.1, 2)]


def documents(spark):
    rows = [(i, "word " * (5 + i % 40), "A" if i % 2 else " a", "x") for i in range(600)]
    rows += [(1000 + i, "token here " * (3 + i % 9), "b-c", "x") for i in range(300)]
    rows += [(3000 + i, "few", "tiny", "x") for i in range(5)] + [(4000, None, "a", "x"), (4001, "", "a", "x"), (4002, "other", "unlisted", "x"), (4003, "other", None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")


def test_token_counts_agree_with_a_second_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(TOKENIZER), "byte_bpe_50k.json"))
    texts = ["Hello, world's  end\n\n 123", "Größe 日本語 ünïcode 😀", "", " ", "x" * 50_000, "<|endoftext|>"]
    t.encode_special_tokens = True
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    got = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, t string").withColumn("n", count_tokens(F.col("t"))).orderBy("i").collect()
    assert [r.n for r in got] == [*want, None]
    assert encoder(TOKENIZER).decode(encoder(TOKENIZER).encode_ordinary(texts[1])) == texts[1] and PATTERN and base64


def test_shares_caps_and_report(spark):
    targets = spark.createDataFrame(SHARES, "source string, target_share double, max_repeats int")
    mixed = mix_sources(documents(spark), targets)
    got = {r.source: r for r in mix_report(mixed, targets).collect()}
    assert got["none"].copies == 0 and got["none"].actual_share == 0
    assert got["tiny"].most_copies == 2 and got["tiny"].documents == 5  # used up to its cap
    assert got["a"].most_copies == 1 and got["b_c"].most_copies <= 4
    assert abs(got["a"].tokens / got["b_c"].tokens - 5 / 3) < 0.05
    rows = mixed.collect()
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows) and not {4000, 4001, 4002, 4003} & {r.doc_id for r in rows}
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    again = mix_sources(documents(spark).orderBy(F.desc("doc_id")), targets).select("doc_id", "copy_no").collect()
    assert {tuple(r) for r in again} == {(r.doc_id, r.copy_no) for r in rows}


def test_copies_follow_the_law(spark):
    """Of 20,000 equal documents, the counts of copies are those of a Poisson law cut at the cap."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.lit("a").alias("source"))
    targets = spark.createDataFrame([("a", 1.0, 5)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(docs, targets, total=3.0 * 20_000 * 1.5)
    copies = [r[0] for r in mixed.groupBy("doc_id").agg(F.max("copy_no")).select("max(copy_no)").collect()]
    cdf = [*poisson_cdf(rate_for(np.full(BINS, 1.0), 1.5 * BINS, 5), 5), 1.0]
    want = np.diff([0.0, *cdf]) * 20_000
    seen = np.bincount(copies, minlength=6)
    seen[0] = 20_000 - len(copies)
    assert ((seen - want) ** 2 / want).sum() < 25 and abs(seen @ np.arange(6) / 20_000 - 1.5) < 0.03


def test_empty(spark):
    targets = spark.createDataFrame(SHARES, "source string, target_share double, max_repeats int")
    assert mix_sources(documents(spark).limit(0), targets).count() == 0
    assert mix_sources(documents(spark), targets.limit(0)).count() == 0


def test_rates_and_plans():
    tokens = np.full(BINS, 10.0)
    for target in (0.2, 0.9, 2.5):
        rate = rate_for(tokens, target * tokens.sum(), 4)
        held = sum(1 - c for c in poisson_cdf(rate, 4))
        assert abs(held - target) < 1e-3
    heavy = np.zeros(BINS)
    heavy[::7] = np.arange(len(heavy[::7])) % 50 * 100.0
    for target in (0.2, 0.9, 2.5):
        steps = steps_for(heavy, target * heavy.sum(), 4)
        held = sum(heavy[int(x * BINS) :].sum() for x in steps)
        assert abs(held / heavy.sum() - target) < 0.02 and steps == sorted(steps) and steps == poisson_cdf(rate_for(heavy, target * heavy.sum(), 4), 4)
    assert steps_for(heavy, 0, 2) == [1.0, 1.0] and steps_for(heavy, heavy.sum() * 2, 2) == [0.0, 0.0]
    assert rate_for(tokens, 4 * tokens.sum(), 4) == float("inf") and poisson_cdf(float("inf"), 2) == [0.0, 0.0]
    plan = plan_mix({"a": 100.0, "b": 100.0}, {"a": (0.5, 1), "b": (0.4, 1), "c": (0.1, 1)}, 0.5)
    assert abs(plan["a"] / sum(plan.values()) - 5 / 9) < 1e-9 and abs(plan["a"] - 100) < 1e-9
    assert plan_mix({}, {"a": (1.0, 1)}, 0.5) == {}
