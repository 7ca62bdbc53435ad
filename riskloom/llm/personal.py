"""Personal information in free text: found and replaced by typed placeholders.

Mail addresses, phone numbers and street addresses have forms of their own.
Identity numbers have a cue before them; the shape of a number (its digits and letters
as classes) is a term as well, and what it discloses is the information that it
gives about a cue, over the whole corpus. A shape above the threshold is an identity number
without a cue, too. Names have no form, so words are judged by what they disclose: over
the whole corpus, each capitalised term is counted, and counted again where it
opens a name beyond doubt (a sign-off line, a mail header, a user field). The
pointwise mutual information of term and person, as a share of the information
in "a person", is the term's disclosure. Terms above the threshold are given
names; frequent terms below it are ordinary words; a given name beside a word
that is not ordinary is a name. In capitals or in small letters throughout, the
word beside it must not be one that the corpus often has in small letters.
A name in a place beyond doubt is reported whatever the counts say. Given names
are those that open two certain names or more; the frequent ones are sent to each
task, the others are joined to the texts that hold them.

Defined results: null or empty text stays as it is and has no finding; whole
texts are read; repeated rows each count; extra columns stay.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialise, scalars, spread

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}

#: Share of the information in "a person" that a term has to disclose.
DISCLOSURE = 0.5
#: A given name that opens at least this share of the certain names is sent to each task, a rarer one is joined; an ordinary word is at least this share of the capitalised words: 1 / share bounds both lists.
LEAST_NAME, LEAST_WORD = 1e-5, 1e-4
#: A common word is at least this share of the words in small letters, and seen OFTEN times.
LEAST_COMMON, OFTEN = 2e-6, 20

_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_AT = r"(?:[@＠]|\s?[\[({<]\s?at\s?[\])}>]\s?|&#64;)"
_DOT = r"(?:[.．]|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
_LOCAL = r"[^\W_](?:[\w.+%'-]*[\w])?"
EMAIL = re.compile(rf"(?<![\w.+/@-])(?P<local>{_LOCAL})(?:{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+|\s(?:at|AT)\s[^\W_][\w-]*(?:(?:\s(?:dot|DOT)\s|\s?[\[(]dot[\])]\s?)[^\W_][\w-]*)+)", re.I)

_GAP = r"[\s.\-/]"
PHONE = re.compile(
    r"(?<![\w.\-/+])(?:"
    rf"\+\d{{1,3}}(?:{_GAP}?\(?\d{{1,5}}\)?){{2,7}}"
    rf"|00\d{{2}}\s?(?:\(0\)\s?)?\d{{1,5}}(?:{_GAP}?\d{{2,8}}){{1,4}}"
    r"|\(0?\d{2,5}\)\s?\d{3,6}(?:[\s\-.]\d{2,6}){1,3}"
    r"|0\d{2,4}[\s\-/]\d{3,5}[\s\-]\d{3,5}"
    r"|0\d(?:[.\s\-]\d{2}){4}"
    r"|[2-9]\d{2}(?P<s>[.\-])\d{3}(?P=s)\d{4}"
    r"|[2-9]\d{2}\s[2-9]\d{2}\s\d{4}"
    r"|1[2-9]\d{2}[2-9]\d{6}|0[1-9]\d{9}|(?<=tel=)0[1-9]\d{8}"
    r")(?:\s?(?:ext|x|extension)\.?\s?\d{1,5}(?!\w)|(?!\w|[-/.]\w))",
)

_ID_CUE = r"(?:social\s+security(?:\s+(?:number|no\.?))?|\bSSN\b|\bpassport(?:\s+(?:number|no\.?))?|\bnational\s+id(?:entity)?(?:\s+(?:number|no\.?))?|\b(?:ID|identity)\s+card(?:\s+(?:number|no\.?))?|\btax(?:payer)?\s+(?:number|id|no\.?)|\bdriv(?:er|ing)(?:'?s)?\s+licen[cs]e(?:\s+(?:number|no\.?))?)"
ID_NUMBER = re.compile(rf"(?i:{_ID_CUE})\s*[:=#]?\s*(?P<v>(?=[A-Z\d])[A-Z]{{0,3}}\d[\dA-Z]*(?:[-/\s]\d[\dA-Z]*)*)")
#: Tokens that may be identity numbers without a cue, and the cue where there is one. Whether a token's shape is one of theirs is learned.
_NUMBER = re.compile(r"(?<![\w.\-/])[A-Z]{0,3}\d[\dA-Z]*(?:[-/][\dA-Z]+)*(?![\w\-/]|\.\d)")
_CUED = re.compile(rf"(?i:{_ID_CUE})\s*[:=#]?\s*$")
_DIGITS, _CAPITALS = re.compile(r"\d"), re.compile("[A-Z]")

_TOWN = rf"{_CAP}(?:[ \t]{_CAP}|-{_CAP})?"
_KIND = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.|Boulevard|Blvd\.?|Court|Ct\.|Square|Terrace|Close|Crescent|Way|Highway)"
ADDRESS = re.compile(
    rf"(?<![\w.])(?:(?:Flat|Apt\.?|Unit|Suite)\s\d+\w?,\s)?\d{{1,4}}[A-Z]?\s(?:{_CAP}\s){{1,3}}{_KIND}(?!\w)(?:,\s(?:Apt|Flat|Unit|Suite)\.?\s\d+\w?)?(?:,\s{_TOWN}(?:\s\d{{5}})?)?"
    rf"|(?<!\w){_CAP}(?:straße|strasse|str\.|weg|platz|gasse|allee)\s\d{{1,4}}[a-z]?(?!\w)(?:,\s\d{{4,5}}\s{_TOWN})?"
    rf"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Via|Viale|Rua)\s(?:(?:de|del|de\sla|de\slos|da|do|dos)\s)?(?:{_CAP}\s){{1,2}}\d{{1,4}}(?!\w)(?:,\s\d{{1,2}}[ºª°]?\s?\w?)?(?:,\s{_TOWN})?"
    rf"|(?<!\w)\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|quai|allée|impasse)\s(?:(?:de|des|du|de\sla|la|le|les)\s|d['’]|de\sl['’]|l['’])?{_CAP}(?:\s{_CAP})?(?:,\s\d{{5}}\s{_TOWN})?",
)

_WORD = re.compile(_CAP)
#: As counted: a term before a dot and a number is an abbreviation, another term.
_TERM = re.compile(rf"{_CAP}(?!\w|\.\s?\d)")
#: Where a name stands beyond doubt: sign-off lines and other places where a mail address, a signature or a field of that meaning is beside it.
_CERTAIN = re.compile(rf"(?:-by:\s+|\"(?:user|name|author|owner)\":\s*\"|(?:^|\n)(?:Regards|Best|Cheers|Thanks),\s*\n|\b(?:owner|user|author|name)=)(?P<a>{_CAP})[\s_](?P<c>{_CAP})|(?<!\w)(?P<b>{_CAP})\s(?P<d>{_CAP})(?=\s*<[^\s<>]+@|;[^\s;]+@)")
_LOWER = re.compile(r"(?<![\w.@+'’-])[^\W\d_A-Z]{2,}(?![\w@+'’-])")
_BESIDE = re.compile(r"\s+([^\W\d_]{3,})(?![\w@])")
_NEXT = re.compile(rf"(?:\s|_)+((?:(?:van|von|de|da|del|la|bin|al)\s)?{_CAP})")
_BEFORE = re.compile(rf"(?<!\w)({_CAP}),\s$")
_AFTER_PRODUCT = re.compile(r"\s+(?:release|milestone|theme|edition)\b")


def number_shapes(text: str) -> list[tuple[int, int, str]]:
    """Span and shape of the tokens of five digits and more that may be identity numbers: # and the token with 9 for a digit, A for a letter."""
    found = [m for m in _NUMBER.finditer(text)] if any(c in text for c in "0123456789") else []
    return [(*m.span(), "#" + _CAPITALS.sub("A", shape)) for m in found if (shape := _DIGITS.sub("9", m.group())).count("9") >= 5]


def _may_be_certain(text: str) -> bool:
    return "by:" in text or "=" in text or "@" in text or '"' in text or ",\n" in text


def term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text) to (small, term, n, opens, ends), summed over a task: capitalised terms and how often they open and end a certain name; shapes of numbers and how often a cue of identity numbers stands before them; words in small letters."""
    n, opens, ends, small = Counter(), Counter(), Counter(), Counter()

    def out() -> pd.DataFrame:
        terms = [*n, *small]
        counts = {"n": [*n.values(), *small.values()], "opens": [*(opens[t] for t in n), *[0] * len(small)], "ends": [*(ends[t] for t in n), *[0] * len(small)]}
        return pd.DataFrame({"small": np.array([False] * len(n) + [True] * len(small), dtype=bool), "term": pd.Series(terms, dtype=object)} | {k: pd.Series(c, dtype="int64") for k, c in counts.items()})

    for pdf in batches:
        for t in pdf["text"]:
            if t:
                n.update(_TERM.findall(t.replace("_", " ")))
                small.update(_LOWER.findall(t))
                for s, _, shape in number_shapes(t):
                    n[shape] += 1
                    opens[shape] += _CUED.search(t, max(0, s - 60), s) is not None
                if _may_be_certain(t):
                    for m in _CERTAIN.finditer(t):
                        opens[m["a"] or m["b"]] += 1
                        ends[m["c"] or m["d"]] += 1
        if len(n) + len(small) > 300_000:
            yield out()
            for c in (n, opens, ends, small):
                c.clear()
    yield out()


def disclosures(texts: DataFrame) -> DataFrame:
    """Terms frequent enough to judge, from a table with a column `text`: (small, term, n, opens, named, listed, disclosure, as_opening).

    listed: of a share that bounds the list, whatever the corpus; disclosure: of the term anywhere in a name; as_opening: where it opens one.
    """
    counts = texts.mapInPandas(term_counts, "small boolean, term string, n bigint, opens bigint, ends bigint").groupBy("small", "term").agg(*[F.sum(c).alias(c) for c in ("n", "opens", "ends")])
    counts = materialise(counts, "terms")  # used twice
    shape = F.col("term").startswith("#")
    of = lambda kind, c: F.sum(F.when(kind, F.col(c)))
    total = scalars(counts, n=of(~F.col("small") & ~shape, "n"), small=of(F.col("small"), "n"), opens=of(~shape, "opens"), numbers=of(shape, "n"), cued=of(shape, "opens"))
    entity = F.when(shape, F.least(total["cued"] / total["numbers"], F.lit(0.5))).otherwise(total["opens"] / total["n"])
    share = lambda k: F.when(k > 0, F.log2((k / F.col("n")) / entity) / -F.log2(entity)).otherwise(F.lit(0.0))
    named = F.col("opens") >= 2
    frequent = named & (F.col("opens") >= LEAST_NAME * total["opens"])
    often = F.when(shape, F.lit(False)).when(F.col("small"), F.col("n") >= F.greatest(F.lit(OFTEN), LEAST_COMMON * total["small"])).otherwise(F.col("n") >= F.greatest(F.lit(2), LEAST_WORD * total["n"]))
    return (
        counts.filter(named | often)
        .select("small", "term", "n", "opens", named.alias("named"), (frequent | often).alias("listed"), share(F.col("opens") + F.col("ends")).alias("disclosure"), share(F.col("opens")).alias("as_opening"))
    )


def judged(texts: DataFrame) -> tuple[tuple[frozenset[str], frozenset[str], frozenset[str]], DataFrame]:
    """The lists of `judged_terms`, and (term): the given names too rare for the list, however many."""
    terms = disclosures(texts)
    is_given = F.col("named") & (F.col("as_opening") >= DISCLOSURE)
    given, ordinary, common = [], [], []
    for r in terms.filter("listed").select("small", "term", is_given.alias("given"), (F.col("disclosure") < DISCLOSURE).alias("ordinary")).toLocalIterator():
        if r.small:
            common.append(r.term)
        elif r.given:
            given.append(r.term)
        elif r.ordinary:
            ordinary.append(r.term)
    return (frozenset(given), frozenset(ordinary), frozenset(common)), terms.filter(~F.col("listed") & ~F.col("small") & is_given).select("term")


def judged_terms(texts: DataFrame) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Given names, ordinary and common words: at most 1 / LEAST_NAME + 1 / LEAST_WORD, 1 / LEAST_WORD + 1 / LEAST_NAME and 1 / LEAST_COMMON terms, whatever the corpus."""
    return judged(texts)[0]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words_of(texts: pd.Series) -> pd.Series:
    """The words and number shapes of a text in small letters, each once."""
    found = ({w for m in _WORD.findall(t.replace("_", " ")) for w in (m.lower(), m.capitalize().lower())} | set(_LOWER.findall(t)) | {shape.lower() for _, _, shape in number_shapes(t)} if t else set() for t in texts)
    return pd.Series([sorted(x) for x in found], dtype=object)


@F.pandas_udf(T.StringType())
def _in_small(terms: pd.Series) -> pd.Series:
    return terms.str.lower()


def with_rare(df: DataFrame, text: str, rare: DataFrame) -> DataFrame:
    """Adds __rare: the rare given names that the row's text holds, null for none. Rows that share a hash may share names; a name that a text does not hold changes nothing in it."""
    if rare.isEmpty():
        return df.withColumn("__rare", F.lit(None).cast("array<string>"))
    row = F.xxhash64(*[f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)])  # of the whole row: no hot text
    words = df.select(row.alias("__row"), F.explode(_words_of(F.col(text))).alias("__word"))
    held = words.join(rare.select("term", _in_small(F.col("term")).alias("__word")), "__word").groupBy("__row").agg(F.collect_set("term").alias("__rare"))
    return df.withColumn("__row", row).join(held, "__row", "left").drop("__row")


def _remote(text: str, m: re.Match) -> bool:
    """A git remote, which looks like a mail address."""
    rest = text[m.end() : m.end() + 2]
    return (rest[:1] == ":" and rest[1:2].strip() != "" and m.group().count(" ") == 0 and re.match(r":[\w~.-]*[/\d]", text[m.end() : m.end() + 80]) is not None) or text[max(0, m.start() - 3) : m.start()] == "://"


def find_personal(text: str, given: frozenset[str], ordinary: frozenset[str], common: frozenset[str] = frozenset(), rare: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) in order, none in another."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if "@" in text or "＠" in text or "dot" in low or "at)" in low or "at]" in low or "at}" in low or "&#64;" in text:
        out += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text) if not _remote(text, m)]
    digits = any(c in text for c in "0123456789")

    def free(s: int, e: int) -> bool:
        return all(e <= a or s >= b for a, b, _ in out)

    if digits:
        for m in ID_NUMBER.finditer(text):
            s, e = m.span("v")
            if sum(c.isdigit() for c in text[s:e]) >= 5 and free(s, e):
                out.append((s, e, "id_number"))
        for s, e, shape in number_shapes(text):
            if (shape in given or shape in rare) and free(s, e):
                out.append((s, e, "id_number"))
        for m in ADDRESS.finditer(text):
            if free(*m.span()):
                out.append((*m.span(), "address"))
        for m in PHONE.finditer(text):
            if 7 <= sum(c.isdigit() for c in m.group()) <= 20 and free(*m.span()):
                out.append((*m.span(), "phone"))
    plain = text.replace("_", " ") if "_" in text else text
    for m in _WORD.finditer(plain):
        w = m.group()
        s, e = m.span()
        if len(w) > 1 and w.isupper() and (w.capitalize() in given or w.capitalize() in rare) and free(s, e):
            other = lambda x: len(x) > 2 and x.isupper() and x.lower() not in common and x.capitalize() not in ordinary and x not in ordinary
            if (f := _BESIDE.match(text, e)) and other(f[1]) and free(s, f.end()):
                out.append((s, f.end(), "name"))
            elif (b := _BEFORE.search(plain, max(0, s - 60), s)) and other(b[1]) and free(b.start(1), e):
                out.append((b.start(1), e, "name"))
            continue
        if (w not in given and w not in rare) or not free(s, e):
            continue
        if (f := _NEXT.match(text, e)) and f[1].split()[-1] not in ordinary and len(f[1]) > 1 and free(s, f.end()):
            if not _AFTER_PRODUCT.match(text, f.end()):
                out.append((s, f.end(), "name"))
        elif (b := _BEFORE.search(plain, max(0, s - 60), s)) and b[1] not in ordinary and len(b[1]) > 1 and free(b.start(1), e):
            out.append((b.start(1), e, "name"))
    for names in (_small(given), frozenset(g.lower() for g in rare)):
        if not names.isdisjoint(text.split()):
            for m in _LOWER.finditer(text):
                if m.group() in names and (f := _BESIDE.match(text, m.end())) and f[1].islower() and f[1] not in common and free(m.start(), f.end()):
                    out.append((m.start(), f.end(), "name"))
    if _may_be_certain(text):
        for m in _CERTAIN.finditer(text):
            s, e = m.start("a" if m["a"] else "b"), m.end("c" if m["a"] else "d")
            if free(s, e) and not _AFTER_PRODUCT.match(text, e):
                out.append((s, e, "name"))
    return sorted(out)


@functools.lru_cache(maxsize=4)
def _small(given: frozenset[str]) -> frozenset[str]:
    return frozenset(g.lower() for g in given)


def sanitise(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its placeholder."""
    parts, at = [], 0
    for s, e, kind in spans:
        parts += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join([*parts, text[at:]])


def personal_types(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pii_type): one row per type that a row's text holds."""
    terms, rare = judged(texts.select(F.col(text).alias("text")))
    schema = T.StructType([texts.schema[k] for k in keys] + [T.StructField("pii_type", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [sorted({k for _, _, k in find_personal(t, *terms, frozenset(() if r is None else r))}) if t else [] for t, r in zip(pdf[text], pdf["__rare"])]
            at = np.repeat(np.arange(len(pdf)), [len(k) for k in kinds])
            out = pdf[keys].iloc[at].copy()
            out["pii_type"] = np.array([x for k in kinds for x in k], dtype=object)
            yield out

    return spread(with_rare(texts.select(*keys, text), text, rare), keys[-1]).mapInPandas(run, schema)


def sanitised(df: DataFrame, text: str, out: str = "sanitised_text") -> DataFrame:
    """`df` with the text in which each finding is a placeholder."""
    terms, rare = judged(df.select(F.col(text).alias("text")))

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series, rare: pd.Series) -> pd.Series:
        return pd.Series([sanitise(t, find_personal(t, *terms, frozenset(() if r is None else r))) if t else t for t, r in zip(texts, rare)], dtype=object)

    return with_rare(df, text, rare).withColumn(out, clean(F.col(text), F.col("__rare"))).drop("__rare")
