"""Passages of evaluation items inside a training corpus.

The items form an inverted BM25 index with block maxima: the items are cut into
blocks, and beside each term's weights stands its largest weight in each block.
Every document is a row of overlapping passages, each passage a query. A
block whose summed maxima stay below the threshold is skipped whole; in the others
all items at or above the threshold are retrieved. Weights are divided by the
item's own threshold, the least score that a stretch of STRETCH words of it
with EDITS words missing can have, so retrieval loses no case.

Retrieved pairs are verified: a run of equal words is extended on both sides
over at most EDITS changed, dropped or added words, and has to reach STRETCH
words of the item. The answer of the item is looked for in the same pass.

The index is broadcast, as items are a fixed test set; `MOST_ITEMS` is checked,
and beyond it the items are searched in slices of that size.

Defined results: null, empty and short texts leak nothing; repeated documents
are cases each; whole texts are read; extra columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import spread

STRETCH, EDITS = 30, 2
PASSAGE, STEP = 64, 32  # any stretch of 32 words lies within one passage
BLOCK = 16
#: Passages that are evaluated together.
CHUNK = 3000
K1, B = 1.2, 0.75
MOST_ITEMS = 20_000

# Letters of other scripts that look like Latin ones.
_ALIKE = str.maketrans("аеорсухіјѕԁһқԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαρνі", "aeopcyxijsdhkqwABEZHIKMNOPTYXoapvi")
_LATIN = re.compile("[a-zA-Z]")
_OTHER = re.compile("[Ͱ-ԯ]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_MARK = re.compile(r"(?m)^[^\S\n]*(?:(?:[>|#*+•-]+|//+|\d{1,3}[.)])[^\S\n]+)+")
_HYPHEN = re.compile(r"(?<=\w)[-‐­]\s*\n[^\S\n]*(?:(?:>+|//+|#+|\*)[^\S\n]+)*(?=\w)")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿︀-️]")
_LOOSE = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<=\w)—(?=\w)")


def plain_words(text: str) -> list[str]:
    """Words without case, punctuation, markup, marks at line starts, hyphens at line ends and invisible characters."""
    t = _HYPHEN.sub("", text) if "-\n" in text or "‐" in text or "\xad" in text or "- " in text else text
    if "<" in t:
        t = _TAG.sub("", t)
    if "&" in t:
        t = html.unescape(t)
    if "](" in t:
        t = _LINK.sub(r"\1", t)
    t = _MARK.sub("", t)
    plain = t.isascii()
    if not plain:
        t = _SPACED.sub(" ", _INVISIBLE.sub("", t))
        t = unicodedata.normalize("NFKD", t)
        t = "".join(c for c in t if not unicodedata.combining(c))
    words = [w for w in (x if x.isalnum() else _LOOSE.sub("", x) for x in t.casefold().split()) if w]
    if plain or not _OTHER.search(t):
        return words
    return [w.translate(_ALIKE) if not w.isascii() and _OTHER.search(w) and _LATIN.search(w) else w for w in words]


class ItemIndex:
    """An inverted index of items with block maxima."""

    def __init__(self, items: list[tuple]) -> None:
        """items: (id, text) or (id, text, answer)."""
        kept = [(i, w, plain_words(more[0]) if more and more[0] else []) for i, t, *more in items if t and len(w := plain_words(t)) >= STRETCH - EDITS]
        self.ids = np.array([i for i, _, _ in kept], dtype=np.int64)
        self.vocabulary = {w: k for k, w in enumerate(sorted({x for _, ws, answer in kept for x in (*ws, *answer)}))}
        self.words = [np.array([self.vocabulary[w] for w in ws], dtype=np.int32) for _, ws, _ in kept]
        self.answers = [np.array([self.vocabulary[w] for w in answer], dtype=np.int32) for _, _, answer in kept]
        n, mean = len(kept), np.mean([len(w) for w in self.words]) if kept else 1.0
        df = np.zeros(len(self.vocabulary))
        for w in self.words:
            df[np.unique(w)] += 1
        # A term of half the items says nothing; its weight is 0, in the thresholds as well, and it has no postings.
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)
        term, item, weight, always = [], [], [], []
        for k, w in enumerate(self.words):
            own, tf = np.unique(w, return_counts=True)
            value = idf[own] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            least, said = self.least_score(w, dict(zip(own.tolist(), value.tolist()))), value > 0
            if least <= 0:
                always.append(k)  # a stretch of it has no term that says anything: it is verified in every document
                continue
            term.append(own[said])
            item.append(np.full(said.sum(), k))
            weight.append(value[said] / least)
        self.always = always
        term, item, weight = (np.concatenate(x) if x else np.zeros(0, dtype=kind) for x, kind in ((term, np.int64), (item, np.int64), (weight, float)))
        # Postings by term and item; those of one term in one block stand together.
        order = np.lexsort((item, term))
        term, self.item, self.weight = term[order], item[order], weight[order]
        part = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.item[1:] // BLOCK != self.item[:-1] // BLOCK)]) if len(term) else np.zeros(0, dtype=np.int64)
        self.part_start, self.part_size = part, np.diff(np.r_[part, len(term)])
        self.part_block = self.item[part] // BLOCK
        self.part_max = np.maximum.reduceat(self.weight, part) if len(part) else np.zeros(0)
        self.blocks = -(-max(n, 1) // BLOCK)
        self.term_parts = np.bincount(term[part], minlength=len(self.vocabulary)) if len(part) else np.zeros(len(self.vocabulary), dtype=np.int64)
        self.term_start = np.cumsum(self.term_parts) - self.term_parts
        # Runs of GRAM words: hash, item and place, in the order of the hash.
        runs = [grams(w) for w in self.words]
        g = np.concatenate(runs) if runs else np.zeros(0, dtype=np.uint64)
        order = np.argsort(g, kind="stable")
        self.run_hash = g[order]
        self.run_item = np.repeat(np.arange(n), [len(r) for r in runs])[order]
        self.run_place = np.concatenate([np.arange(len(r)) for r in runs])[order] if runs else np.zeros(0, dtype=np.int64)
        self.listed = [w.tolist() for w in self.words]

    @staticmethod
    def least_score(words: np.ndarray, weight: dict[int, float]) -> float:
        """The least score of a stretch of the item, as the word edits may take its best terms and shorten it."""
        own = words.tolist()
        size = min(STRETCH - EDITS, len(own))
        best = np.inf
        for s in range(len(own) - size + 1):
            w = sorted(weight[t] for t in set(own[s : s + size]))
            best = min(best, sum(w[: max(1, len(w) - EDITS)]))
        return best * (1 - 1e-5)

    def retrieve(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """(document, item) pairs of which a passage scores at least the item's threshold."""
        owner, start, stop = [], [], []
        at, flat = 0, []
        for d, w in enumerate(docs):
            for s in range(0, max(1, len(w) - STEP), STEP):
                owner.append(d)
                start.append(at + s)
                stop.append(at + min(s + PASSAGE, len(w)))
            flat.append(w)
            at += len(w)
        if not owner or not len(self.ids):
            return []
        words, found = np.concatenate(flat), {(d, k) for d, w in enumerate(docs) if len(w) for k in self.always}
        for c in range(0, len(owner), CHUNK):  # bounds memory, however long a document is
            found |= self._retrieve(words, np.array(owner[c : c + CHUNK]), np.array(start[c : c + CHUNK]), np.array(stop[c : c + CHUNK]))
        return sorted(found)

    def _retrieve(self, words: np.ndarray, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> set[tuple[int, int]]:
        size = stop - start
        passage = np.repeat(np.arange(len(owner)), size)
        term = words[np.arange(len(passage)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]
        keep = term >= 0
        pair = np.unique(passage[keep].astype(np.int64) * len(self.vocabulary) + term[keep])
        passage, term = pair // len(self.vocabulary), (pair % len(self.vocabulary)).astype(np.int64)
        if not len(pair):
            return set()
        # Sums of block maxima; blocks under the threshold are not opened.
        part = expand(self.term_start[term], self.term_parts[term])
        at = np.repeat(passage, self.term_parts[term]) * self.blocks + self.part_block[part]
        opened = (np.bincount(at, self.part_max[part], len(owner) * self.blocks) >= 1)[at]
        part, at = part[opened], at[opened] // self.blocks
        posting = expand(self.part_start[part], self.part_size[part])
        key = np.repeat(at, self.part_size[part]) * len(self.ids) + self.item[posting]
        if len(owner) * len(self.ids) <= 4_000_000:
            hit = np.flatnonzero(np.bincount(key, self.weight[posting], len(owner) * len(self.ids)) >= 1)
        else:  # many items: only the pairs that occur
            known, place = np.unique(key, return_inverse=True)
            hit = known[np.bincount(place, self.weight[posting]) >= 1] if len(known) else known
        return set(zip(owner[hit // len(self.ids)].tolist(), (hit % len(self.ids)).tolist()))

    def answered(self, doc: np.ndarray, item: int) -> bool:
        """Whether the words of an item's answer stand in a document in a row; False without an answer."""
        answer = self.answers[item]
        at = np.flatnonzero(doc[: len(doc) - len(answer) + 1] == answer[0]) if 0 < len(answer) <= len(doc) else ()
        return any(np.array_equal(doc[s : s + len(answer)], answer) for s in at)

    def leaks(self, docs: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(document, item, words of the longest stretch) of verified pairs."""
        by_doc: dict[int, set[int]] = {}
        for d, k in self.retrieve(docs):
            by_doc.setdefault(d, set()).add(k)
        if not by_doc:
            return []
        # Runs of equal words in all these documents at once; -3 parts them, so that no run crosses two.
        part = [np.r_[docs[d], -3] for d in by_doc]
        first = np.cumsum([0, *(len(x) for x in part)])[:-1]
        g = grams(np.concatenate(part))
        low, high = np.searchsorted(self.run_hash, g, "left"), np.searchsorted(self.run_hash, g, "right")
        hits = np.flatnonzero(high > low)
        owner = np.searchsorted(first, hits, "right") - 1
        names, texts, best, done = list(by_doc), {}, {}, {}
        for o, j, a, b in zip(owner.tolist(), (hits - first[owner]).tolist(), low[hits].tolist(), high[hits].tolist()):
            d = names[o]
            wanted = by_doc[d]
            for k, i in zip(self.run_item[a:b].tolist(), self.run_place[a:b].tolist()):
                if k in wanted and done.get((d, k, j - i), -1) < j:
                    if d not in texts:
                        texts[d] = docs[d].tolist()
                    n, upto = stretch(self.listed[k], texts[d], i, j)
                    done[(d, k, j - i)] = upto
                    best[(d, k)] = max(best.get((d, k), 0), n)
        return [(d, k, n) for (d, k), n in best.items() if n >= STRETCH]


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of each range, one range after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


GRAM = 10  # two edits leave three runs of 28 equal words, so one of ten at least


def grams(words: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM words; runs with an unknown word have hashes that no item has."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = h * np.uint64(1_000_003) + (words[k : k + n].astype(np.int64) + 2).astype(np.uint64)
            h ^= h >> np.uint64(31)
    return h


def _reach(a: list[int], b: list[int], i: int, j: int, step: int) -> list[int]:
    """The farthest item word reached from (i, j) in a direction with 0 .. EDITS edits, each followed by an equal word."""

    n, m = len(a), len(b)

    def slide(i: int, j: int) -> tuple[int, int]:
        while 0 <= i < n and 0 <= j < m and a[i] == b[j]:
            i, j = i + step, j + step
        return i, j

    front = {slide(i, j)}
    best = [max(abs(x - i) for x, _ in front)]
    for _ in range(EDITS):
        new = set()
        for x, y in front:
            for p, q in ((x + step, y + step), (x + step, y), (x, y + step)):
                new.add(slide(p, q))
        # An edit at the rim counts only if an equal word follows it.
        front = new
        best.append(max([best[-1], *(abs(x - i) for x, y in new if 0 <= x - step < len(a) and 0 <= y - step < len(b) and a[x - step] == b[y - step])]))
    return best


def stretch(a: list[int], b: list[int], i: int, j: int) -> tuple[int, int]:
    """Words of item a in the longest stretch around the equal words a[i], b[j], and how far b's equal run goes."""
    right, left = _reach(a, b, i, j, 1), _reach(a, b, i - 1, j - 1, -1)
    return max(left[e] + right[EDITS - e] for e in range(EDITS + 1)), j + right[0] - 1


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str = "answer", batch: int = 256) -> DataFrame:
    """(doc_id, item_id, words, with_answer): documents that contain a stretch of an item, its length in words, and whether the item's answer (false if there is none) stands in the document as well.

    Items come to the driver a slice at a time.
    """
    listed = items.select(item_id, item_text, F.col(answer) if answer in items.columns else F.lit(None).cast("string")).filter(F.col(item_text).isNotNull()).orderBy(item_id).toLocalIterator()
    spark = documents.sparkSession
    source = spread(documents.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "doc_id")
    found = None
    while (part := [tuple(r) for r in itertools.islice(listed, MOST_ITEMS)]) or found is None:
        index = spark.sparkContext.broadcast(ItemIndex(part))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            own = index.value
            for pdf in batches:
                rows = []
                for s in range(0, len(pdf), batch):
                    part = pdf.iloc[s : s + batch]
                    ids = part["doc_id"].to_numpy()
                    docs = []
                    for t in part["text"]:
                        w = plain_words(t) if len(t) >= STRETCH else []
                        docs.append(np.array([own.vocabulary.get(x, -1) for x in w], dtype=np.int32) if len(w) >= STRETCH - EDITS else np.zeros(0, dtype=np.int32))
                    rows += [(ids[d], own.ids[k], n, own.answered(docs[d], k)) for d, k, n in own.leaks(docs)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "with_answer"]).astype({"doc_id": "int64", "item_id": "int64", "words": "int32", "with_answer": "bool"})

        part = source.mapInPandas(run, "doc_id bigint, item_id bigint, words int, with_answer boolean")
        found = part if found is None else found.unionByName(part)
    return found


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked item: documents, the longest stretch, and documents that hold its answer, too."""
    per = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("words").alias("longest_words"), F.count_distinct(F.when(F.col("with_answer"), F.col("doc_id"))).alias("with_answer"))
    suites = items.select(F.col("item_id").cast("bigint").alias("item_id"), "suite").dropDuplicates(["item_id"])
    return per.join(suites, "item_id", "left").select("item_id", "suite", "documents", "longest_words", "with_answer")
