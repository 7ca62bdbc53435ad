"""Mixing sources to target shares of tokens by Poisson replication.

Every document gets a uniform number from a hash of its id and the seed. The
inverse Poisson distribution at that number, cut at the source's cap, is its
number of copies; the rate of each source is set so that the copies' tokens meet
its share. The count is monotone in the rate, so a histogram of tokens over the
uniform numbers, one small row set per source, suffices to find the rate. Copies
are exploded and ordered globally by a second hash.

The total is the largest at which every source with documents reaches its share
within its cap, but not under `least_total` of the listed sources' tokens; then
sources too small for it are used up to their cap, and the report says so. The
share of a source without documents is spread over the others in proportion.

Defined results: documents without text, or of no listed source, take no part;
source names are compared without case, blanks around them and the kind of
separator; an empty table gives an empty mix; extra columns stay.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialise, scalars, spread

#: Where the public tokenizers' vocabulary files are.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this byte-level vocabulary cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 4096


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; null for null. A text is encoded whole, however long."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for s in texts:
            yield pd.Series([None if t is None else len(own.encode_ordinary(t)) for t in s], dtype="Int64")

    return count(text)


def source_key(source: Column) -> Column:
    """A source name without differences of spelling."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_")


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from a hash; the same for the same row whenever a task runs."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / float(1 << 52)


def poisson_cdf(rate: float, most: int) -> list[float]:
    """P(X <= k) for k = 0 .. most - 1: a uniform number at or above the k-th gives more than k copies."""
    if math.isinf(rate):
        return [0.0] * most
    term, total, out = math.exp(-rate), 0.0, []
    for k in range(most):
        total += term
        out.append(min(total, 1.0))
        term *= rate / (k + 1)
    return out


def rate_for(tokens: np.ndarray, target: float, cap: int) -> float:
    """The rate at which copies hold `target` tokens; tokens: of documents by bin of their uniform number."""
    above = np.r_[np.cumsum(tokens[::-1])[::-1], 0.0]  # tokens at or above the start of each bin

    def held(rate: float) -> float:
        at = np.array(poisson_cdf(rate, cap)) * BINS
        return float(np.interp(at, np.arange(BINS + 1), above).sum())

    if target <= 0:
        return 0.0
    if target >= cap * above[0] * (1 - 1e-12):
        return math.inf
    lo, hi = 0.0, 1.0
    while held(hi) < target and hi < 700:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if held(mid) < target else (lo, mid)
    return hi


def steps_for(tokens: np.ndarray, target: float, cap: int) -> list[float]:
    """The uniform numbers at or above which a document has more than 0, 1 .. copies: the inverse distribution at the rate that meets the target."""
    return poisson_cdf(rate_for(tokens, target, cap), cap) if target > 0 else [1.0] * cap


def plan_mix(sizes: dict[str, float], targets: dict[str, tuple[float, int]], least_total: float, total: float | None = None) -> dict[str, float]:
    """Tokens wanted of each source that has any."""
    present = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    if not present:
        return {}
    shares = {s: t[0] / sum(x[0] for x in present.values()) for s, t in present.items()}
    if total is None:
        total = max(min(present[s][1] * sizes[s] / shares[s] for s in present), least_total * sum(sizes[s] for s in present))
    return {s: min(total * shares[s], present[s][1] * sizes[s]) for s in present}


def mix_sources(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, seed: int = 42, least_total: float = 0.5, total: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mix: `keep` (default: all columns) with n_tokens, copy_no (from 1) and shuffle_key, in the order of shuffle_key."""
    keep = [c for c in keep or documents.columns if c not in ("mix_source", "n_tokens", "copy_no", "shuffle_key")]
    listed = targets.groupBy(source_key(F.col("source")).alias("s")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    used = documents.filter(F.col(text).isNotNull()).select(*dict.fromkeys([*keep, doc_id, text, source]))
    sized = spread(used, doc_id).withColumn("__source", source_key(F.col(source)))
    # The targets are one row per source; a table of documents never has more sources in the mix than are listed.
    sized = sized.join(F.broadcast(listed.select(F.col("s").alias("__s"))), F.col("__source") == F.col("__s"), "left_semi")
    sized = sized.withColumn("__tokens", count_tokens(F.col(text), tokenizer)).withColumn("__u", uniform(seed, F.col("__source"), F.col(doc_id)))
    sized = materialise(sized.filter("__tokens > 0").select(*keep, F.col(doc_id).alias("__id"), "__source", "__tokens", "__u"), "tokens")
    bins = sized.groupBy("__source", F.floor(F.col("__u") * BINS).cast("int").alias("bin")).agg(F.sum("__tokens").alias("n"))
    by_source: dict[str, np.ndarray] = {}
    for r in bins.toLocalIterator():  # at most BINS rows for each listed source
        by_source.setdefault(r["__source"], np.zeros(BINS))[r["bin"]] = r["n"]
    want = {r["s"]: (float(r["share"] or 0), int(r["cap"] or 0)) for r in listed.toLocalIterator()}
    goal = plan_mix({s: float(x.sum()) for s, x in by_source.items()}, want, least_total, total)
    rows = [(s, steps_for(by_source[s], goal[s], want[s][1])) for s in goal]
    steps = documents.sparkSession.createDataFrame(rows, "s string, steps array<double>")
    counted = sized.join(F.broadcast(steps), sized["__source"] == F.col("s")).withColumn("__n", F.size(F.filter("steps", lambda x: F.col("__u") >= x)))
    copies = counted.filter("__n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    mixed = copies.select(*keep, F.col("__source").alias("mix_source"), F.col("__tokens").alias("n_tokens"), "copy_no", F.xxhash64(F.lit(seed + 1), "__id", "copy_no").alias("shuffle_key"))
    return mixed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target and actual share of tokens, documents, copies and the most copies of one document."""
    per_doc = mixed.groupBy("mix_source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    per = per_doc.groupBy("mix_source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("copies"), F.max("n").alias("most_copies"), F.sum("t").alias("tokens"))
    all_tokens = scalars(mixed, t=F.sum("n_tokens"))["t"]
    listed = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    joined = listed.join(per, listed["source"] == per["mix_source"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("most_copies"), zero("tokens"), (F.coalesce("tokens", F.lit(0)) / all_tokens).alias("actual_share"))
