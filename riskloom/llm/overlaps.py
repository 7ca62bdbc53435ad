"""Records of one change in the training split and in an evaluation split.

Candidates come from similarity-hash fingerprints. A message is normalised to
words (layout, case, punctuation, prefixes, references and sign-off lines go).
Each word belongs, by its hash, to one of 14 segments; the fingerprint is the
row of their symbols, the 24-bit similarity hash of each segment's words. Changing a
word touches two symbols at most, so texts within three changed words agree in
at least eight symbols, and in one of the seven code blocks of symbols (0, 1),
(2, 3) and so on. The splits are joined on the code blocks, and what lies within the
Hamming radius of six symbols is kept. Keys that too many texts share are lengthened
by further symbols, in a way that loses no pair within the radius. Texts with
a code block of no word, mostly short ones, have no key of that block; they are
joined on blocks by place as well: a training text is cut into four blocks of
words, of which three changes leave one whole, and an evaluation text is looked
up by every stretch of words that can be that block. What is left is verified
word by word.

Equal normalised texts form one class first: fingerprints, joins and checks work
on classes, and only the result is expanded to rows.

Defined results: rows without a data_split, and messages that are null or under
12 words, are in no text pair; an empty table gives none; extra columns are
ignored; a row is paired by its id, so repeated rows each count.
"""

from __future__ import annotations

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
from riskloom.session import materialise, spread

SEGMENTS, BITS = 14, 24
#: A list of classes or keys up to this many rows is broadcast; a longer one is shuffled.
SMALL = 200_000
#: A key that meets in more pairs than FEW is lengthened, at most DEPTH times; then its training side is split into salts of CHUNK classes.
FEW, DEPTH, CHUNK = 10_000, 4, 2_000

_TRAILER = re.compile(r"^[ \t>]*(?:[A-Za-z]+(?:-[A-Za-z]+)*-by|cc|refs?|references|fixes|closes|resolves|see[- ]also|issue|bug|ticket|change-id|reviewed-on|link|part-of)[ \t]*:.*$|\(?cherry[ -]picked from commit [0-9a-f]+\)?", re.I | re.M)
_REFERENCE = re.compile(r"\(?\b(?:gh-|pr ?|issue ?)?#\d+\)?|\b[A-Z]{2,10}-\d+\b(?=\s*[:\]])")
_PREFIX = re.compile(r"^(?:\s*(?:\[[^\]\n]+\]|(?:re|re-?apply|fwd?|aw|wip|backport|squash!|fixup!|draft|hotfix)\s*[:!]))+", re.I)
_REVERT = re.compile(r"^\W*((?:revert\w*\W+)+)", re.I)
_BUMP = re.compile(r"(\S+)\s+from\s+v?(\d\S*)\s+to\s+v?(\d\S*)", re.I)
_LOOSE = re.compile(r"[\W_]+")


_HINTS = ("by:", "by :", "cherry", "cc:", "ref", "fixes", "closes", "resolves", "see-also", "see also", "issue", "bug", "ticket", "change-id", "reviewed-on", "link", "part-of")


def normal_words(text: str) -> list[str]:
    """The words that make a message what it is."""
    t = text if text.isascii() else unicodedata.normalize("NFKC", text)
    low = t.lower()
    if any(h in low for h in _HINTS):
        t = _TRAILER.sub(" ", t)
    if "#" in t or "-" in t:
        t = _REFERENCE.sub(" ", t)
    t = _PREFIX.sub(" ", t)
    words = t.casefold().split()
    return [w for w in (x if x.isalnum() else _LOOSE.sub("", x) for x in words) if w]


def reverts(text: str) -> int:
    """How often a message says that it takes a change back."""
    m = _REVERT.match(_PREFIX.sub("", text))
    return len(re.findall(r"\w+", m[1])) if m else 0


def bumps(text: str) -> list[str]:
    """Package and versions of an automatic update message, in each of its mentions; empty for other messages."""
    head = text.lstrip().split("\n", 1)[0]
    if not _BUMP.search(head) or not re.search(r"\b(?:bump|update|upgrade)s?\b", head, re.I):
        return []
    return sorted({" ".join(x.strip(".,;:`'\"()") for x in m).casefold() for m in _BUMP.findall(text)})


def word_edits(a: list[str], b: list[str], most: int) -> int:
    """Words to change, drop or add between two texts; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(new) > most:
            return most + 1
        row = new
    return min(row[-1], most + 1)


def same_text(a: str, b: str, most: int) -> bool:
    """At most `most` words differ, and one at least is kept."""
    x, y = a.split(" "), b.split(" ")
    allowed = min(most, max(len(x), len(y)) - 1)
    return word_edits(x, y, allowed) <= allowed


_HASHES: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        h = _HASHES[word] = xxhash.xxh64_intdigest(word)
    return h


def fingerprints(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the fingerprint as blocks of two symbols, and whether each block has words."""
    n = len(texts)
    h = np.fromiter((_hash(w) for ws in texts for w in ws), dtype=np.uint64)
    owner = np.repeat(np.arange(n), [len(ws) for ws in texts])
    cell = owner * SEGMENTS + ((h >> np.uint64(40)) % np.uint64(SEGMENTS)).astype(np.int64)
    counts = np.bincount(cell, minlength=n * SEGMENTS)
    symbols = np.zeros(n * SEGMENTS, dtype=np.int64)
    for b in range(BITS):  # the sign of each bit's sum over the segment's words
        ones = np.bincount(cell[((h >> np.uint64(b)) & np.uint64(1)).astype(bool)], minlength=n * SEGMENTS)
        symbols |= (2 * ones > counts).astype(np.int64) << b
    symbols, counts = symbols.reshape(n, SEGMENTS // 2, 2), counts.reshape(n, SEGMENTS // 2, 2)
    return symbols[:, :, 0] << BITS | symbols[:, :, 1], counts.sum(axis=2) > 0


def _block_key(number: int, n: int, words: list[str]) -> int:
    return xxhash.xxh64_intdigest(f"{number} {n} {' '.join(words)}")


def block_keys(words: list[str], most: int) -> list[int]:
    """Keys of the most + 1 even blocks of a text; of its single words, if there are no more of them than `most`."""
    n = len(words)
    if n <= most:
        return [_block_key(-1, n, [w]) for w in set(words)]
    cuts = [n * i // (most + 1) for i in range(most + 2)]
    return [_block_key(i, n, words[cuts[i] : cuts[i + 1]]) for i in range(most + 1)]


def probe_keys(words: list[str], most: int) -> list[int]:
    """Keys of which one at least is in `block_keys` of each text that `most` words to change, drop or add turn into this one, and that shares a word with it.

    Of the blocks of the other text, one is whole, has just as many changes before it
    as its number and at most the rest of them behind it. So it is moved by no more
    than its number, and by no more than the rest from its distance to the end.
    """
    out = set()
    for n in range(max(1, len(words) - most), len(words) + most + 1):
        if n <= most:
            out.update(_block_key(-1, n, [w]) for w in set(words))
            continue
        longer = len(words) - n
        for i in range(most + 1):
            lo, hi = n * i // (most + 1), n * (i + 1) // (most + 1)
            for by in range(max(-i, longer - (most - i), -lo), min(i, longer + (most - i), len(words) - hi) + 1):
                out.add(_block_key(i, n, words[lo + by : hi + by]))
    return list(out)


def folded(blocks: np.ndarray) -> np.ndarray:
    """A fingerprint with its symbols folded to four bits each. Equal symbols stay equal, so no distance grows."""
    symbols = np.stack([blocks >> BITS, blocks & ((1 << BITS) - 1)], axis=2).reshape(len(blocks), SEGMENTS)
    for by in (12, 8, 4):
        symbols = symbols ^ (symbols >> by)
    return ((symbols & 15) << (4 * np.arange(SEGMENTS))).sum(axis=1)


def symbols_apart(a: Column, b: Column) -> Column:
    """The Hamming distance of two folded fingerprints in symbols."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x0011111111111111)))


def fingerprint_rows(batches: Iterator[pd.DataFrame], least: int, most: int) -> Iterator[pd.DataFrame]:
    """(id, text, side) to (id, side, class, a second hash, words, normal text, folded fingerprint, its blocks, null for those without words, kinds, keys of places). Keys of places are those of the side, null where each block has words."""
    for pdf in batches:
        pdf = pdf[[isinstance(t, str) and len(t.split()) >= least for t in pdf["text"]]]
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            words = [normal_words(t) for t in part["text"]]
            depth = [reverts(t) for t in part["text"]]
            slots = [bumps(t) for t in part["text"]]
            blocks, filled = fingerprints(words)
            text = [" ".join(w) for w in words]
            whole = [f"{d}|{'|'.join(s)}|{t}" for t, d, s in zip(text, depth, slots)]
            longs = lambda f: np.fromiter((f(x) for x in whole), dtype=np.uint64, count=len(whole)).view(np.int64)
            yield pd.DataFrame({
                "id": part["id"].to_numpy(), "side": part["side"].to_numpy(), "cls": longs(xxhash.xxh64_intdigest), "proof": longs(xxhash.xxh3_64_intdigest),
                "n": np.array([len(w) for w in words], dtype=np.int16), "normal": text, "code": folded(blocks),
                "blocks": [[x if f else None for x, f in zip(row, own)] for row, own in zip(blocks.tolist(), filled.tolist())],
                "kinds": [[xxhash.xxh32_intdigest(f"{d} {x}") for x in (s or [""])] for d, s in zip(depth, slots)],
                "places": [None if own.all() else np.array((block_keys if side == 1 else probe_keys)(w, most), dtype=np.uint64).view(np.int64) for own, w, side in zip(filled, words, part["side"])],
            })


_ROWS = "id bigint, side int, cls bigint, proof bigint, n smallint, normal string, code bigint, blocks array<bigint>, kinds array<bigint>, places array<bigint>"


def text_rows(df: DataFrame, row_id: str, text: str, split: str, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows with a text, fingerprinted, and their classes: one row per normalised text, told apart by 128 bits."""
    known = F.col(split).isin("train", "validation", "test") & F.col(text).isNotNull()
    rows = df.filter(known).select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.when(F.col(split) == "train", 1).otherwise(2).cast("int").alias("side"))
    made = materialise(spread(rows, "id").mapInPandas(lambda it: fingerprint_rows(it, least, most), _ROWS), "fingerprints")
    of_side = lambda side: F.first(F.when(F.col("side") == side, F.col("places")), ignorenulls=True).alias(f"places_{side}")
    while True:
        classes = made.groupBy("cls").agg(F.bit_or("side").alias("sides"), *[F.first(c).alias(c) for c in ("n", "code", "blocks", "kinds")], of_side(1), of_side(2), F.min("proof").alias("low"), F.max("proof").alias("high"))
        classes = materialise(classes, "classes")
        if classes.filter("low <> high").isEmpty():
            return made, classes
        made = made.withColumn("cls", F.xxhash64("cls", "proof"))  # two texts met in one class


def keyed(classes: DataFrame, side: int, end: str) -> DataFrame:
    """(key, cls, n, code, blocks, used) of the classes of a side: a row for each code block and each key of a place. used: the symbols in the key."""
    none = F.array().cast("array<bigint>")
    of_block = lambda kind, no, block: F.struct(F.xxhash64(kind, no, block).alias("key"), F.array(2 * no, 2 * no + 1).cast("array<int>").alias("used"))
    number = F.sequence(F.lit(0), F.lit(SEGMENTS // 2 - 1))
    of_blocks = lambda kind: F.transform(F.filter(number, lambda no: F.get("blocks", no).isNotNull()), lambda no: of_block(kind, no, F.get("blocks", no)))
    of_places = lambda kind: F.transform(F.coalesce(f"places_{side}", none), lambda k: F.struct(F.xxhash64(kind, k).alias("key"), F.array().cast("array<int>").alias("used")))
    keys = F.inline(F.flatten(F.transform("kinds", lambda kind: F.concat(of_blocks(kind), of_places(kind)))))
    own = classes.filter(F.col("sides").bitwiseAND(side) != 0)
    return own.select(F.col("cls").alias(f"cls_{end}"), F.col("n").alias(f"n_{end}"), F.col("code").alias(f"code_{end}"), "blocks", keys)


def lengthened(rows: DataFrame) -> DataFrame:
    """Each key lengthened by one of seven symbols that it has not used: as at most six differ, one of the seven is equal as well."""
    free = F.slice(F.filter(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda s: ~F.array_contains("used", s)), 1, SEGMENTS // 2)
    block = lambda s: F.coalesce(F.get("blocks", F.shiftright(s, 1)), F.lit(-1))
    symbol = lambda s: F.when(s.bitwiseAND(1) == 0, F.shiftright(block(s), BITS)).otherwise(block(s).bitwiseAND((1 << BITS) - 1))
    keys = F.inline(F.transform(free, lambda s: F.struct(F.xxhash64("key", s, symbol(s)).alias("longer"), F.array_append("used", s.cast("int")).alias("using"))))
    kept = [c for c in rows.columns if c not in ("key", "used")]
    return rows.select(*kept, keys).withColumnsRenamed({"longer": "key", "using": "used"})


def candidates(classes: DataFrame, most: int) -> DataFrame:
    """(cls_a, cls_b) of a training and another evaluation class within the Hamming radius, from equal code blocks.

    A key that would give more than FEW pairs is lengthened, up to DEPTH times;
    of what is then still frequent, the training side is split into salts of CHUNK
    classes. No key, however frequent, is dropped or met whole in one task.
    """
    a, b = keyed(classes, 1, "a"), keyed(classes, 2, "b")
    near = (F.col("cls_a") != F.col("cls_b")) & (F.abs(F.col("n_a") - F.col("n_b")) <= most) & (symbols_apart(F.col("code_a"), F.col("code_b")) <= 2 * most)
    out = None
    for depth in range(DEPTH + 1):
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        counts = a.select("key", one.alias("a"), none.alias("b")).unionByName(b.select("key", none.alias("a"), one.alias("b"))).groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        hot = materialise(counts.filter(F.col("a") * F.col("b") > FEW), "frequent")
        many = hot.count()
        listed = F.broadcast(hot) if many <= SMALL else hot  # at most SMALL rows
        rest = lambda rows: rows.select(*[c for c in rows.columns if c not in ("blocks", "used")]).join(listed.select("key"), "key", "left_anti") if many else rows.drop("blocks", "used")  # noqa: B023, E731
        met = rest(a).join(rest(b), "key").filter(near).select("cls_a", "cls_b")
        out = met if out is None else out.unionByName(met)
        if not many:
            break
        if depth == DEPTH:
            salts = F.ceil(F.col("a") / F.lit(CHUNK)).cast("int")
            salted_a = a.join(listed.select("key", salts.alias("salts")), "key").withColumn("salt", F.pmod("cls_a", F.col("salts")).cast("int"))
            salted_b = b.join(listed.select("key", salts.alias("salts")), "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            out = out.unionByName(salted_a.drop("blocks", "used", "salts").join(salted_b.drop("blocks", "used", "salts"), ["key", "salt"]).filter(near).select("cls_a", "cls_b"))
            break
        a, b = (materialise(lengthened(rows.join(listed.select("key"), "key", "left_semi")), "longer") for rows in (a, b))
    return out.distinct()


def text_classes(df: DataFrame, row_id: str, text: str, split: str, least: int = 12, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, side, cls) of the rows with a text, and (cls_a, cls_b) of a training and an evaluation class within `most` words, equal ones included.

    Copies are not expanded: a class of equal texts is one row in every step.
    """
    made, classes = text_rows(df, row_id, text, split, least, most)
    pairs = materialise(candidates(classes, most), "candidates")
    wanted = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    if pairs.count() * 2 <= SMALL:
        wanted = F.broadcast(wanted)  # at most SMALL rows
    texts = made.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("normal").alias("normal"))
    pairs = pairs.join(texts.select(F.col("cls").alias("cls_a"), F.col("normal").alias("text_a")), "cls_a").join(texts.select(F.col("cls").alias("cls_b"), F.col("normal").alias("text_b")), "cls_b")
    same = F.pandas_udf(lambda a, b: pd.Series([same_text(x, y, most) for x, y in zip(a, b)], dtype=bool), T.BooleanType())
    links = pairs.filter(same("text_a", "text_b")).select("cls_a", "cls_b")
    equal = classes.filter(F.col("sides") == 3).select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    return made.select("id", "side", "cls"), materialise(links.unionByName(equal), "links")


def text_overlaps(df: DataFrame, row_id: str, text: str, split: str, least: int = 12, most: int = 3) -> DataFrame:
    """(id_a, id_b): rows of different sides, training and evaluation, whose texts differ in at most `most` words."""
    members, links = text_classes(df, row_id, text, split, least, most)
    train = members.filter("side = 1").select(F.col("id").alias("id_train"), F.col("cls").alias("cls_a"))
    held = members.filter("side = 2").select(F.col("id").alias("id_held"), F.col("cls").alias("cls_b"))
    found = skewed_join(held, skewed_join(train, links, "cls_a", ["id_train"]), "cls_b", ["id_held"])
    return found.select(F.least("id_train", "id_held").alias("id_a"), F.greatest("id_train", "id_held").alias("id_b"))


def hash_key(column: str) -> Column:
    """The first 12 hexadecimal digits of a commit hash, however it is written; null if there are fewer."""
    digits = F.regexp_extract(F.lower(F.col(column)), r"([0-9a-f]{12,40})", 1)
    return F.when(F.length(digits) >= 12, F.substring(digits, 1, 12))


def hash_overlaps(df: DataFrame, row_id: str, hash_column: str, split: str) -> DataFrame:
    """(id_a, id_b): rows of different sides with one hash."""
    rows = df.filter(F.col(split).isin("train", "validation", "test")).select(F.col(row_id).cast("bigint").alias("id"), hash_key(hash_column).alias("key"), split).filter(F.col("key").isNotNull())
    train = rows.filter(F.col(split) == "train").select("key", F.col("id").alias("id_train"))
    held = rows.filter(F.col(split) != "train").select("key", F.col("id").alias("id_held"))
    return skewed_join(train, held, "key", ["id_train"]).select(F.least("id_train", "id_held").alias("id_a"), F.greatest("id_train", "id_held").alias("id_b"))


def cross_split_overlaps(df: DataFrame, row_id: str = "row_id", hash_column: str = "hash", text: str = "commit_msg", split: str = "data_split") -> DataFrame:
    """(id_a, id_b), smaller first: a training and an evaluation row that record one change, by hash or by text."""
    return hash_overlaps(df, row_id, hash_column, split).unionByName(text_overlaps(df, row_id, text, split)).distinct()


def overlap_rows(df: DataFrame, row_id: str = "row_id", hash_column: str = "hash", text: str = "commit_msg", split: str = "data_split", label: str = "risky") -> DataFrame:
    """Per evaluation row with a twin in training: (row_id, class_id, text_twins, hash_twins, other_label).

    Twins are counted per class and per hash first and never listed, so a class
    or hash that holds much of the table costs one row. other_label: whether a
    twin has another label than the row; class_id is null for rows without a
    text long enough.
    """
    rows = df.filter(F.col(split).isin("train", "validation", "test")).select(F.col(row_id).cast("bigint").alias("id"), hash_key(hash_column).alias("h"), F.col(label).alias("y"), (F.col(split) == "train").alias("t"))
    counts = lambda: (F.count(F.lit(1)).alias("k"), F.count_if(F.col("y") == 0).alias("k0"), F.count_if(F.col("y") == 1).alias("k1"))
    by_hash = rows.filter("t and h is not null").groupBy("h").agg(*counts())
    members, links = text_classes(df, row_id, text, split)
    labelled = members.filter("side = 1").select(F.col("id").alias("m"), "cls").join(rows.select("id", "y"), F.col("m") == F.col("id"))
    by_class = labelled.groupBy(F.col("cls").alias("cls_a")).agg(*counts())
    near = skewed_join(links, by_class, "cls_a", ["cls_b"]).groupBy(F.col("cls_b").alias("class_id")).agg(*[F.sum(c).alias(f"t_{c}") for c in ("k", "k0", "k1")])
    held = members.filter("side = 2").select(F.col("id").alias("m"), F.col("cls").alias("class_id"))
    own = materialise(rows.filter("not t").join(held, F.col("id") == F.col("m"), "left").drop("m"), "held")
    own = skewed_join(skewed_join(own, near, "class_id", ["id"], "left"), by_hash, "h", ["id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    other = F.when(F.col("y") == 1, zero("t_k0") + zero("k0") > 0).when(F.col("y") == 0, zero("t_k1") + zero("k1") > 0).otherwise(F.lit(False))
    return own.select(F.col("id").alias("row_id"), "class_id", zero("t_k").alias("text_twins"), zero("k").alias("hash_twins"), other.alias("other_label")).filter("text_twins + hash_twins > 0")


def overlap_report(df: DataFrame, row_id: str = "row_id", hash_column: str = "hash", text: str = "commit_msg", split: str = "data_split", source: str = "source_repo", label: str = "risky") -> DataFrame:
    """Per evaluation split and source: rows with a twin in training, links by text and by hash, and rows of which a twin has another label."""
    twins = overlap_rows(df, row_id, hash_column, text, split, label).withColumnRenamed("row_id", "__id")
    rows = df.select(F.col(row_id).alias("__row"), F.col(split).alias("data_split"), F.col(source).alias("source_repo"))
    joined = twins.join(rows, F.col("__id") == F.col("__row"))
    return joined.groupBy("data_split", "source_repo").agg(F.count(F.lit(1)).alias("overlapping_rows"), F.sum("text_twins").alias("text_links"), F.sum("hash_twins").alias("hash_links"), F.count_if("other_label").alias("label_conflicts"))
