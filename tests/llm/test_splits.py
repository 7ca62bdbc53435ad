import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import splits
from riskloom.llm.overlaps import hash_key
from riskloom.llm.queries import QUERIES
from riskloom.llm.splits import anneal, assign_splits, connected, keyed_authors, name_key, split_report, variant_pairs, with_components

SAME = ["José Kopibek", "JOSÉ KOPIBEK", "Jose Kopibek", "José Kopibek", "Kopibek, José", "jose.kopibek", "jose_kopibek", "José Kopibek", "José  Kopibek ", "José Kopibek <j@example.org>", "José Kopibek (on leave)", "José Kopibek".encode().decode("latin-1"), "José Kopibek [x]"]


def test_spellings_of_one_name():
    assert {name_key(x) for x in SAME} == {"jose kopibek"}
    assert len({name_key(x) for x in ("Jan Vogasos", "Jana Vogasos", "Jan Vogaso", "Jan-Vogasos Jan", "larch-bot")}) == 5
    assert name_key("larch-bot[bot]") == name_key("Larch-Bot") and name_key("  ") == "" and name_key("(x)") == "x"


@pytest.mark.parametrize("small", [splits.SMALL, 0])
def test_components_equal_a_plain_search(spark, monkeypatch, small):
    monkeypatch.setattr(splits, "SMALL", small)  # 0: hubs are met in salts
    rng = np.random.default_rng(2)
    links = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 120, (90, 2))] + [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(x)
    got = {}
    for r in connected(spark.createDataFrame(links, "a string, b string")).collect():
        got.setdefault(r.component, set()).add(r.node)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    assert {frozenset(g) for g in got.values()} == want
    assert connected(spark.createDataFrame([], "a string, b string")).count() == 0


def make(spark, n=600):
    rows = [(i, f"Author {i % 97}" if i % 11 else (f"AUTHOR {i % 97}" if i % 2 else None), f"{i // 26:012x}".ljust(40, "a") if i % 13 == 0 else f"{i + 10**6:012x}".ljust(40, "b") if i % 5 else None, i % 3 % 2 if i % 17 else None, "old", "kept") for i in range(n)]
    return spark.createDataFrame(rows, "row_id int, author string, hash string, risky int, split string, node string")


@pytest.fixture(scope="module")
def assigned(spark):
    df = keyed_authors(make(spark), "author")
    return assign_splits(df, "row_id", F.col("author_key"), hash_key("hash"), "risky", steps=3000, chains=4).cache()


def test_units_and_records_stay_together(assigned):
    rows = assigned.collect()
    assert len(rows) == 600 and len({r.row_id for r in rows}) == 600 and {r.node for r in rows} == {"kept"}
    for key in ("author_key", "hash", "component"):
        by = {}
        for r in rows:
            if r[key] is not None:
                by.setdefault(r[key], set()).add(r.split)
        assert all(len(s) == 1 for s in by.values())


def test_proportions_and_labels(assigned):
    got = {r.split: r for r in split_report(assigned, "risky").collect()}
    for s, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(got[s].row_share - share) < 0.02
    overall = sum(r.label_share * r.row_share for r in got.values())
    assert all(abs(r.label_share - overall) < 0.06 for r in got.values())


def test_variants_and_an_empty_table(spark, assigned):
    got = {(r.author_a, r.author_b) for r in variant_pairs(assigned, "author", "author_key").collect()}
    names = {r.author for r in assigned.select("author").distinct().collect() if r.author}
    assert got == {(a, b) for a, b in itertools.product(names, names) if a < b and name_key(a) == name_key(b)} and got
    empty = keyed_authors(make(spark).limit(0), "author")
    assert assign_splits(empty, "row_id", F.col("author_key"), hash_key("hash"), "risky", steps=10, chains=1).count() == 0


def test_annealing_keeps_the_best():
    n, ones = np.array([100.0, 10, 10, 5, 5, 60, 10]), np.array([50.0, 5, 5, 2, 3, 30, 5])
    cost, at = anneal(n, ones, np.array([0.8, 0.1, 0.1]), np.array([0.9, 0.1, 0.5, 0.3, 0.7, 0.2, 0.6]), 1, 2000)
    sizes = np.bincount(at, n, 3)
    assert abs(sizes[0] - 160) <= 10 and cost < 0.2


def test_a_commit_under_another_hash_stays_together(spark):
    rows = [(0, "ann", "a" * 12, "1"), (1, None, "b" * 12, "1"), (2, None, None, "1"), (3, "bob", "b" * 12, None), (4, None, None, "2"), (5, None, None, None), (6, "cid", None, "2"), (7, None, "c" * 12, "3")]
    df = spark.createDataFrame(rows, "row_id int, author string, hash string, seq string")
    got = {r.row_id: r["__component"] for r in with_components(df, "row_id", F.col("author"), hash_key("hash"), F.col("seq")).collect()}
    assert len({got[i] for i in (0, 1, 2, 3)}) == 1 and got[4] == got[6] and len(set(got.values())) == 4


@pytest.mark.parametrize("query", ["p3_split_by_author", "p3_split_by_repo"])
def test_rows_of_one_seq_get_one_split(spark, query):
    d = "/root/testdata/sf0.1"
    rows = QUERIES[query](spark, d).join(spark.read.parquet(f"{d}/commit_features.parquet").select("row_id", "seq"), "row_id")
    rows = rows.cache()
    assert rows.count() == 40000 and rows.groupBy("seq").agg(F.count_distinct("split", "component").alias("k")).filter("k > 1").count() == 0
    share = {r.split: r["count"] / 40000 for r in rows.groupBy("split").count().collect()}
    assert all(abs(share[s] - x) < 0.01 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    rows.unpersist()
