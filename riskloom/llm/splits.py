"""Splits that keep related records together: train, validation and test by whole components.

Records that share a unit (an author, however written, or a repository) or a
commit (known by its hash, by the number it was mined under, or both) form a
component. Components are found by large-star and small-star
rounds over the links between units, all in tables.

The search exchanges whole components. Heavy components, at most
1 / HEAVY_SHARE of them, are pieces of their own; all lighter ones are put into
BUCKETS pieces by a hash of the component. The pieces, whose number does not
depend on the input, are given to parallel annealing chains; each chain starts
from another hashed assignment, moves or swaps pieces to lessen the deviation of
sizes and label shares, and the best result over all chains is kept.

Defined results: a row without a unit and without a commit is a component of its
own, by its id; null labels count for sizes only; an empty table gives an empty
result; extra columns stay, and the results `split` and `component` replace columns of
those names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.skew import skewed_join
from riskloom.session import materialise, scalars

SPLITS = ("train", "validation", "test")
HEAVY_SHARE = 0.002
BUCKETS = 400
#: Up to so many links a plain join is used.
SMALL = 200_000

_NOTE = re.compile(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|（[^（）]*）|\S+[@＠]\S+")
_WORDS = re.compile(r"[^\W_]+")
_CODES = re.compile("[\u00c2-\u00f4][\u0080-\uffff]")


def name_key(name: str) -> str:
    """The words of a name without case, accents, order, signs, notes and mail addresses. A name of nothing else keeps its letters."""
    text = name
    if _CODES.search(text):  # UTF-8 that was read as Latin-1
        for codec in ("latin-1", "cp1252"):
            try:
                text = text.encode(codec).decode("utf-8")
                break
            except UnicodeError:
                pass
    text = unicodedata.normalize("NFKC", text)
    bare = _NOTE.sub(" ", text)
    for t in (bare, text):
        plain = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
        if words := sorted(_WORDS.findall(plain)):
            return " ".join(words)
    return text.strip().casefold()


@F.pandas_udf(T.StringType())
def _name_key(names: pd.Series) -> pd.Series:
    place, values = pd.factorize(names)  # each spelling of a batch once
    keys = np.array([name_key(x) if x.strip() else None for x in values] + [None], dtype=object)
    return pd.Series(keys[place])


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b) of strings: large-star and small-star rounds until nothing changes.

    The component is its least node. Each round is written, so its cost does not
    pile up; the number of rounds grows with the logarithm of the longest path.
    A node with very many neighbours is met in salts; up to SMALL links no task is long.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    state = lambda e: e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.count_distinct("u"), F.lit(0))).first()
    now = state(edges)
    while True:
        join = (lambda many, few: many.join(few, "u")) if now[0] <= SMALL else (lambda many, few: skewed_join(many, few, "u", ["v"]))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = join(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        down = materialise(down, "links") if now[0] > SMALL else down
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = join(down, low).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u != v").distinct(), "links")
        before, now = now, state(edges)
        if now[0] == now[2] and (now[0], now[1]) == (before[0], before[1]):  # each node has one link, to its root
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_components(df: DataFrame, row_id: str, unit: Column, *records: Column) -> DataFrame:
    """Adds __component: rows of one unit (string, null for none) or one value of any of the records (strings, null for none) share it.

    Rows of a heavy unit, and the units of a heavy record, are joined in salts: none is whole in one task.
    """
    own = F.concat(F.lit("row:"), F.col(row_id).cast("string"))
    named = [F.concat(F.lit(f"record{i or ''}:"), r) for i, r in enumerate(records)]
    base = materialise(df.withColumn("__node", F.coalesce(F.concat(F.lit("unit:"), unit), *named, own)).withColumn("__records", F.array_compact(F.array(*named))), "nodes")
    # Partial minima leave each task before the shuffle: one record's rows are never gathered.
    per_record = base.select(F.explode("__records").alias("__record"), "__node").distinct()
    first = per_record.groupBy("__record").agg(F.min("__node").alias("a"), F.max("__node").alias("z")).filter("a < z").select("__record", "a")
    shared = materialise(per_record.join(first, "__record", "left_semi"), "records")  # of records in more than one node
    star = shared.groupBy("__record").agg(F.min("__node").alias("a"))
    roots = connected(skewed_join(shared, star, "__record", ["__node"]).select("a", F.col("__node").alias("b")))
    roots = roots.select(F.col("node").alias("__node"), F.col("component").alias("__root"))
    return skewed_join(base, roots, "__node", [row_id], "left").withColumn("__component", F.coalesce("__root", "__node")).drop("__root", "__node", "__records")


def deviation(sizes: np.ndarray, ones: np.ndarray, shares: np.ndarray, total: float, label: float) -> float:
    """How far sizes are from their shares and label shares from the overall one."""
    return float(np.abs(sizes / total - shares).sum() + 0.5 * (np.abs(ones / np.maximum(sizes, 1) - label) * np.sqrt(shares)).sum())


def anneal(n: np.ndarray, ones: np.ndarray, shares: np.ndarray, start: np.ndarray, seed: int, steps: int) -> tuple[float, np.ndarray]:
    """One chain over pieces with n rows, of which `ones` have the label: its best deviation and assignment. start: each piece's hash, from 0 to 1."""
    rng = np.random.default_rng(seed)
    k, total = len(n), float(max(n.sum(), 1))
    label = float(ones.sum()) / total
    at = np.searchsorted(np.cumsum(shares), start).clip(0, len(shares) - 1)
    size, one = np.bincount(at, n, len(shares)), np.bincount(at, ones, len(shares))
    now = deviation(size, one, shares, total, label)
    best, kept = now, at.copy()
    pick, to, dice, swap = rng.integers(0, k, (steps, 2)), rng.integers(0, len(shares), steps), rng.random(steps), rng.random(steps) < 0.5
    for s in range(steps):
        i, j = pick[s]
        a, b = at[i], (at[j] if swap[s] else to[s])
        if a == b:
            continue
        dn, do = (n[i] - n[j], ones[i] - ones[j]) if swap[s] else (n[i], ones[i])
        size[a] -= dn
        size[b] += dn
        one[a] -= do
        one[b] += do
        new = deviation(size, one, shares, total, label)
        if new <= now or dice[s] < math.exp(-(new - now) / (0.05 * (1 - s / steps) ** 2 + 1e-9)):
            now, at[i] = new, b
            if swap[s]:
                at[j] = a
            if now < best:
                best, kept = now, at.copy()
        else:
            size[a] += dn
            size[b] -= dn
            one[a] += do
            one[b] -= do
    return best, kept


def assign_splits(df: DataFrame, row_id: str, unit: Column, record: Column | list[Column], label: str, shares: tuple[float, ...] = (0.8, 0.1, 0.1), chains: int = 12, steps: int = 6000, seed: int = 42) -> DataFrame:
    """`df` with `split`: whole components in proportions `shares`, label shares about equal. `record` may be several keys, each of which alone tells a commit."""
    spark = df.sparkSession
    rows = materialise(with_components(df, row_id, unit, *(record if isinstance(record, list) else [record])), "components")
    sizes = rows.groupBy("__component").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("ones"))
    total = rows.count()
    bucket = F.concat(F.lit("b"), F.pmod(F.xxhash64("__component"), F.lit(BUCKETS)).cast("string"))
    piece = F.when(F.col("n") >= HEAVY_SHARE * max(total, 1), F.col("__component")).otherwise(bucket)
    placed = sizes.select("__component", piece.alias("piece"), "n", "ones")
    # At most 1 / HEAVY_SHARE heavy pieces and BUCKETS others: a bound that no input changes.
    pieces = placed.groupBy("piece").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("piece").toPandas()
    if len(pieces):
        n, ones, want, names = pieces["n"].to_numpy(float), pieces["ones"].to_numpy(float), np.array(shares), pieces["piece"].tolist()

        def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for s in pdf["id"]:
                    start = np.array([xxhash.xxh64_intdigest(x, seed * 1000 + int(s)) / 2.0**64 for x in names])
                    best, at = anneal(n, ones, want, start, seed * 1000 + int(s), steps)
                    yield pd.DataFrame({"chain": [int(s)], "cost": [best], "at": [at.astype(int).tolist()]})

        won = spark.range(0, chains, 1, chains).mapInPandas(chain, "chain bigint, cost double, at array<int>").orderBy("cost", "chain").first()
        pieces["split"] = [SPLITS[i] if len(shares) == 3 else str(i) for i in won["at"]]
    else:
        pieces["split"] = pd.Series(dtype=object)
    chosen = spark.createDataFrame(list(pieces[["piece", "split"]].astype(str).itertuples(index=False, name=None)), "piece string, split string")
    by_component = placed.join(F.broadcast(chosen), "piece").select("__component", "split")  # at most 1 / HEAVY_SHARE + BUCKETS rows are broadcast
    # Rows of a heavy component take the split from the small table, so that no hot component is shuffled.
    heavy = by_component.join(placed.filter(F.col("n") >= HEAVY_SHARE * max(total, 1)).select("__component"), "__component", "left_semi")
    light = by_component.join(heavy.select("__component"), "__component", "left_anti")
    kept = [c for c in rows.columns if c not in ("split", "component", "__component")]
    hot = rows.join(F.broadcast(heavy.withColumnRenamed("split", "__split")), "__component")
    cold = rows.join(F.broadcast(heavy.select("__component")), "__component", "left_anti").join(light.withColumnRenamed("split", "__split"), "__component")
    return hot.unionByName(cold).select(*kept, F.col("__split").alias("split"), F.col("__component").alias("component"))


def variant_pairs(assigned: DataFrame, author: str, key: str) -> DataFrame:
    """(author_a, author_b): values of one author, from the components that the split keeps together; a component may hold several authors, so the keys are compared."""
    seen = assigned.filter(F.col(key).isNotNull()).select("component", "split", author, key).distinct()
    a = seen.select(F.col(author).alias("author_a"), F.col(key).alias("k"), "component", "split")
    b = seen.select(F.col(author).alias("author_b"), F.col(key).alias("k"), "component", "split")
    return a.join(b, ["component", "split", "k"]).filter("author_a < author_b").select("author_a", "author_b").distinct()


def keyed_authors(df: DataFrame, author: str, out: str = "author_key") -> DataFrame:
    """Adds the author key. A column function: no shuffle, so no hot author."""
    return df.withColumn(out, _name_key(F.col(author)))


def split_report(assigned: DataFrame, label: str) -> DataFrame:
    """Per split: rows, share of rows and share of rows with the label."""
    per = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("ones"))
    total = scalars(assigned, n=F.count(F.lit(1)))["n"]
    return per.select("split", "n", (F.col("n") / total).alias("row_share"), (F.col("ones") / F.col("n")).alias("label_share"))


def torn(assigned: DataFrame, key: Column) -> DataFrame:
    """(keys, torn): how many values of a key there are, and how many of them lie in more than one split. Partial minima are shuffled, no group."""
    per = assigned.select(key.alias("k"), "split").filter("k is not null").groupBy("k").agg(F.min("split").alias("a"), F.max("split").alias("z"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("a") != F.col("z")).alias("torn"))


