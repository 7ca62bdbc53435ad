"""Sentences of texts in many languages and scripts, as spans of code points.

Every gap at which a sentence could end is a node of a lattice, and every run
of text between two gaps an edge, a sentence that may be one. An edge costs what it
costs to end at its last gap and to pass the gaps within it, given where it
starts, and more if it is a mere scrap or leaves a quotation open. The cheapest path
through a block is its sentences. Costs are log odds: of the end mark, the
quotations around it, the word before (abbreviations: fixed ones as priors,
others from the corpus) and the word after (how often it opens a block in the corpus).
Runs of scripts without spaces are cut into words by a lattice of dictionary
words, whose dictionary is counted in the corpus; gaps are judged by the particle
that ends the run before and by the word that opens the run after.
Thai is cut where a blank stands between two Thai letters.

The corpus counts cover all texts. Frequent terms are sent to each task; the
others, however many, are joined to the texts that hold them at a gap.

Defined results: null, empty and blank texts have no sentence; repeated rows
each have theirs; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.skew import skewed_join
from riskloom.session import materialise, spread

#: A word opens sentences if at least this share of its occurrences opens a block or follows a certain end.
OPENS = 0.02
#: Openers and abbreviations with at least this share of all openings or dotted words are sent to each task, rarer ones are joined to their texts; dictionary words have at least this share of all: 1 / share bounds each list.
LEAST = 2e-5
#: A gap with log odds beyond this is an end, or none, on every path.
SURE = 8.0
#: How far back what is judged at a gap may lie, besides quotations.
NEAR = 80
#: What tells abbreviations from words that end sentences: at most this share stands without a dot, at most this share of the dotted ends a block, and one of n letters is seen with a dot in SEEN * 2 ** (n - 1) documents at least.
BARE, LAST, SEEN = 0.1, 0.005, 8
#: Up to so many terms of the corpus are all sent to each task; of more, those below LEAST are joined.
MOST_TERMS = 100_000
#: A word carries sentences on after a closed quotation if it is at least this share of the small words that follow one.
FOLLOWS = 1e-3

# Abbreviations after which a sentence goes on.
INNER = frozenset("""
dr mr mrs ms prof sr sra srta st jr fig figs sec secs no nos nr p pp cf vs approx e.g i.e eg ie al ed eds vol ch art op resp incl excl
bzw ca vgl abb tab kap z.b d.h u.a o.ä s.o s.u evtl ggf inkl max min mind zzgl bspw sog hr fr
p.ex p.ej núm pág págs cap ej ex mme mlle m n av
т.е см стр рис г гг им напр табл гл п пп ст тыс млн млрд
π.χ δηλ σελ κ αρ βλ
डॉ श्री प्रो पृ सं
""".split())  # fmt: skip
# Abbreviations with which a sentence may be over.
OUTER = frozenset("etc usw ff a.m p.m u.s e.u u.k u.n ee.uu inc ltd co corp bros u.s.a jan feb mar apr jun jul aug sep sept oct nov dec т.д т.п др проч κ.λπ κλπ κ.ά q.v f u.s.w".split())
# Months after an ordinal number, and words before one.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner quartal mal jahrhundert".split())
BEFORE_ORDINAL = frozenset("am zum vom bis dem der den im das die des seit ab".split())
# Words that carry a Chinese or Japanese sentence on after a quotation or a pause, and particles that end one.
CARRY_ON = ("然后", "最后", "之后", "接着", "但", "而", "并", "后", "と", "って", "という", "との", "などと", "とは", "を", "は", "が", "に", "の", "も", "で", "、", "，")
FINAL = ("吗", "呢", "吧", "啊", "了", "か", "ね", "よ", "な", "ぞ", "だ", "た", "です", "ます", "ない", "して")

OPEN, CLOSE = "([{（［｛【「『《〈“„‘‚«‹", ")]}）］｝】」』》〉”’»›"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "｛": "｝", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "„": "“”", "‘": "’", "‚": "‘’", "«": "»", "‹": "›", '"': '"', "'": "'", "”": "”"}
_CLOSERS = CLOSE + "\"'“‘*_`"
_BLOCKS = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_MARKS = re.compile(r"[^\S\n]*(?:(?P<q>>+|//+)|(?P<h>#{1,6})|(?P<l>[-*•+]|\d{1,3}\)))(?=[^\S\n]|$)", re.M)
_ENDS = re.compile("[.!?…。！？．｡؟۔।॥;;‼⁇⁈⁉]+(?:[^\\S\\n]?[!?]+)*|[^\\S\\n][!?]+")
_QUOTES = re.compile("[" + re.escape(OPEN + CLOSE + "\"'") + "]")
_SPACELESS = re.compile("[぀-ヿ㐀-鿿豈-﫿々〆ー]")
_RUN = re.compile("[぀-ヿ㐀-鿿豈-﫿々〆ー]+")
_THAI_GAP = re.compile("(?<=[ก-ฺเ-๎])\\s+(?=[ก-ฺเ-๎])")
_WORD = re.compile(r"[^\W\d_](?:[\w'’.-]*\w)?|\d[\d.,]*")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


@dataclass(frozen=True)
class Lexicon:
    """What the corpus says: lower-case words that open sentences, those that follow a closed quotation or a pause, how often a capital follows an abbreviation, and dictionary words of spaceless scripts with their log shares and opening shares."""

    openers: frozenset[str] = frozenset()
    followers: frozenset[str] = frozenset()
    outer: dict[str, float] | None = None
    words: dict[str, float] | None = None
    opening: dict[str, float] | None = None
    short: frozenset[str] = frozenset()  # abbreviations that the corpus shows
    cuts: dict[str, list[str]] = field(default_factory=dict, compare=False)

    def cut(self, run: str) -> list[str]:
        """The dictionary words of a run without spaces; runs are kept, as many come again."""
        found = self.cuts.get(run)
        if found is None:
            if len(self.cuts) > 50_000:
                self.cuts.clear()
            found = self.cuts[run] = lattice_words(run, self.words or {})
        return found

    def with_rare(self, openers: Iterable[str], short: Iterable[str]) -> Lexicon:
        """With terms that are in one text only of those at hand."""
        return replace(self, openers=self.openers.union(openers), followers=self.followers.difference(openers), short=self.short.union(short))


def lattice_words(run: str, words: dict[str, float], longest: int = 4) -> list[str]:
    """The most likely cut of a run of letters into dictionary words; letters that no word covers stand alone."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        best.append(max((best[s][0] + words.get(run[s:end], -14.0 if end - s == 1 else -1e9), s) for s in range(max(0, end - longest), end)))
    out, at = [], len(run)
    while at:
        out.append(run[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


def _spans(block: str) -> list[tuple[int, int]]:
    """Quotations and brackets that close within the block; marks without a partner are none."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _QUOTES.finditer(block):
        c, i = m.group(), m.start()
        before, after = block[i - 1 : i], block[i + 1 : i + 2]
        if c in "\"'’‘“”":
            at = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRS[stack[k][0]]), None)
            starts = (not before or before.isspace() or before in "([{（«„\"'>*_`") and after.strip() != ""
            if c in "'’" and before.isalnum() and after.isalnum():
                continue  # an apostrophe
            if at is not None and not (c in "\"'“‘" and starts and not (before and not before.isspace())):
                out.append((stack[at][1], i))
                del stack[at:]
            elif c != "’" and (starts or c in "“‘"):
                stack.append((c, i))
        elif c in PAIRS:
            stack.append((c, i))
        else:
            at = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRS[stack[k][0]]), None)
            if at is not None:
                out.append((stack[at][1], i))
                del stack[at:]
    return sorted(out)


def _opens(block: str, at: int, lex: Lexicon) -> tuple[bool, str]:
    """Whether what stands at a place may open a sentence, and the word there."""
    while at < len(block) and (block[at] in "\"'“‘”„«‹([{¿¡（「『《*_`" or block[at].isspace()):
        at += 1
    m = _WORD.match(block, at)
    if not m:
        return True, ""
    word = _INVISIBLE.sub("", m.group())
    if word[0].isdigit():
        return True, word
    if word[0].islower():
        return word in lex.openers, word
    if word[0].isupper() and word.lower() in lex.followers:
        nxt = _WORD.search(block, m.end())  # in titles and capitals the case says nothing
        return not (nxt and nxt.group()[0].isupper()), word
    return True, word


def _caseless(block: str, start: int, at: int) -> bool:
    """Whether the words around a place are capitalised throughout, so that case says nothing."""
    words = [w for w in re.findall(r"[^\W\d_]{2,}", block[max(start, at - 60) : at + 60]) if w.lower() != w or w.upper() != w]
    return len(words) > 3 and sum(w[0].isupper() for w in words) >= 0.8 * len(words)


def _spaceless_odds(block: str, a: int, at: int, lex: Lexicon) -> float:
    """In a script without spaces: the log odds that a sentence is over after a closed quotation or a pause."""
    run = _RUN.match(block, at)
    if not run:
        return -SURE if block[at : at + 1] in tuple("、，,；;：:") else SURE
    if run.group().startswith(CARRY_ON):
        return -6.0
    first = lex.cut(run.group())[0]
    if lex.opening is not None and first in lex.opening:
        return min(5.0, max(-5.0, 3 * math.log((lex.opening[first] + 1e-9) / OPENS))) or 1e-9
    low = a
    while low and _SPACELESS.match(block[low - 1]):
        low -= 1
    last = lex.cut(block[low:a])[-1] if low < a else ""
    return 3.0 if last.endswith(FINAL) else -3.0


def _dot_odds(block: str, start: int, a: int, nxt: int, lex: Lexicon) -> float:
    """The log odds that a single dot at `a` ends a sentence that began at `start`; what follows begins at `nxt`."""
    ends = _dot_ends(block, start, a, nxt, lex)
    return -3.0 if ends is None else SURE if ends else -SURE


def _dot_ends(block: str, start: int, a: int, nxt: int, lex: Lexicon) -> bool | None:
    """Whether a dot ends a sentence; None after an abbreviation of the corpus, of which less is known."""
    low = a
    while low > start and not block[low - 1].isspace():
        low -= 1
    if low == a:
        return True
    word = _INVISIBLE.sub("", block[low:a]).lstrip("\"'“‘„«‹([{¿¡（「*_`").lower()
    opens, after = _opens(block, nxt, lex)
    if word.replace(",", "").isdigit():
        if len(word) <= 2 and after:
            previous = block[max(start, low - NEAR + 20) : low].split()
            if after.lower() in MONTHS or (previous and previous[-1].lower() in BEFORE_ORDINAL and after[0].isalpha() and len(word) < 3):
                return False
        return True
    # Parts of an abbreviation with blanks: the letters before count as one with it.
    joined = word
    if len(word) <= 3:
        head = re.search(r"(?<!\S)[(\"'“„«]?([^\W\d_]{1,3})\.(?:[\s>#*-]|//)+$", block[max(start, low - 14) : low])
        if head:
            joined = f"{head[1].lower()}.{word}"
    for w in (joined, word):
        if w in OUTER:
            if lex.outer is not None and opens and _caseless(block, start, a):
                return lex.outer.get(w, 1.0) >= 0.5 and not after[:1].isdigit()
            return opens and not after[:1].isdigit()
        if w in INNER:
            return False
    if len(word) == 1 and word.isalpha():
        initial = block[a - 1].isupper() and after and not after[0].isdigit()
        tail = re.match(r"([^\W\d_]{1,3})(?=\.|$|[\s,;)])", block[nxt : nxt + 8])
        pair = f"{word}.{tail[1].lower()}" if tail else ""
        return not initial and not (pair in INNER or pair in OUTER or tail and len(tail[1]) == 1 and tail[1].islower())
    return None if word in lex.short else True


def cut_block(block: str, lex: Lexicon) -> list[tuple[int, int]]:
    """Spans of the sentences in a block without blank lines."""
    forced: set[int] = set()  # places before which a sentence ends
    skip: dict[int, int] = {}  # line start to the end of its marks
    at = 0
    for line in block.split("\n"):
        pos, listed, heading = at, False, False
        while m := _MARKS.match(block, pos, at + len(line)):
            if m["l"] and listed:
                break
            listed, heading, pos = listed or bool(m["l"]), heading or bool(m["h"]), m.end()
            if heading:
                break
        if pos > at:
            skip[at] = pos
        if listed or heading:
            forced.add(at)
        if heading:
            forced.add(at + len(line))
        at += len(line) + 1
    cuts: list[int] = sorted(forced)
    if "฀" <= max(block, default="") and re.search("[฀-๿]", block):
        cuts += [m.start() for m in _THAI_GAP.finditer(block)]
    hard = sorted(set(cuts))
    found = best_path(block, hard, forced, skip, lex)
    out: list[tuple[int, int]] = []
    at = 0
    for c in sorted({*hard, *found, len(block)}):
        s, e = at, c
        while s < e and (block[s].isspace() or s in skip):
            s = max(s + 1, skip[s]) if s in skip else s + 1
        while e > s and block[e - 1].isspace():
            e -= 1
        if s < e:
            out.append((s, e))
        at = c
    return out


class Gap(NamedTuple):
    """A place at which a sentence may end: the mark's start, the sentence's end, where the next one begins, the mark, and whether nothing or a forced end follows."""

    a: int
    e: int
    nxt: int
    mark: str
    last: bool


def _gaps(block: str, forced: set[int], skip: dict[int, int]) -> list[Gap]:
    out = []
    for m in _ENDS.finditer(block):
        a, b = m.span()
        mark = m.group().strip()
        if ";" in mark or ";" in mark:
            left = next((c for c in reversed(block[max(0, a - 12) : a]) if c.isalpha()), "")
            if not ("Ͱ" <= left <= "Ͽ" or "ἀ" <= left <= "῿") or (b < len(block) and not block[b].isspace() and block[b] not in _CLOSERS):
                continue
        e = b
        while e < len(block):
            if block[e] in _CLOSERS and not (block[e] in "\"'“‘*_`" and e + 1 < len(block) and block[e + 1].isalnum() and not _SPACELESS.match(block[e + 1])):
                e += 1
            elif block[e] in "\u00a0\u202f " and block[e + 1 : e + 2] in ("»", "›") and block[e + 1 : e + 2]:
                e += 2
            else:
                break
        nxt = e
        while nxt < len(block) and (block[nxt].isspace() or nxt in skip and block[nxt - 1 : nxt] in ("", "\n")):
            nxt = skip[nxt] if nxt in skip and block[nxt - 1 : nxt] in ("", "\n") else nxt + 1
        out.append(Gap(a, e, nxt, mark, nxt >= len(block) or any(e <= f <= nxt for f in forced)))
    return out


def _odds(block: str, start: int, g: Gap, around: list[tuple[int, int]], lex: Lexicon) -> float:
    """The log odds that a sentence which began at `start` ends at a gap. around: quotations and brackets with the gap in them."""
    inside = [c for o, c in around if o >= start]
    if any(c >= g.e for c in inside):
        return -SURE  # a quotation or bracket around it goes on
    if g.last:
        return SURE
    closed = any(g.a <= c < g.e for c in inside)
    after, mark = block[g.nxt], g.mark
    spaceless = bool(_SPACELESS.match(after))
    wide = mark[-1] in "。！？．｡" or spaceless or mark[-1] == "…" and bool(_SPACELESS.match(block[g.a - 1 : g.a] or " "))
    if not wide and g.e < len(block) and not block[g.e].isspace() and not _INVISIBLE.match(block[g.e]):
        return -SURE  # a version, file name or address
    pause = set(mark) <= set("….⋯")
    if wide:
        if mark[-1] not in "。！？．｡…" and not pause and not block[g.e].isspace() and not _SPACELESS.match(block[g.a - 1 : g.a] or " "):
            return -SURE
        if (closed or pause) and (spaceless or after in "、，,；;：:"):
            odds = _spaceless_odds(block, g.a, g.nxt, lex)
            if odds < 0:
                return odds
        if closed and not spaceless and not _opens(block, g.nxt, lex)[0]:
            return -SURE
        return _dot_odds(block, start, g.a, g.nxt, lex) if mark == "." and not closed else SURE
    if after in ",;:)]}":
        return -SURE
    if closed and (after in "–—" or not _opens(block, g.nxt, lex)[0]):
        return -SURE
    if mark == ".":
        return _dot_odds(block, start, g.a, g.nxt, lex)
    if not closed and pause and not _opens(block, g.nxt, lex)[0]:
        return -5.0  # dots for a pause
    return SURE


def _cost(odds: float) -> float:
    """The cost, in nats, of an end with these log odds."""
    return math.log1p(math.exp(-odds)) if odds > -30 else -odds


def best_path(block: str, hard: list[int], forced: set[int], skip: dict[int, int], lex: Lexicon) -> list[int]:
    """Ends of the sentences on the cheapest path through the lattice of a block's gaps. Places in `hard` are on every path.

    Paths are carried from gap to gap, each with the place where its sentence began.
    A gap that is an end beyond doubt ends all sentences; one that is none beyond doubt ends
    none. Of sentences that began more than NEAR letters ago, and in the same
    quotations, the cheapest goes on: what follows is the same for all of them.
    """
    gaps = _gaps(block, forced, skip)
    if not gaps:
        return []
    spans, s, h = _spans(block), 0, 0
    around: list[tuple[int, int]] = []
    back = [0] * (len(gaps) + 1)  # node k: a sentence begins behind gap k - 1; node 0: at the block's start
    running: list[tuple[int, float, int]] = [(0, 0.0, 0)]  # where a sentence began, the cost so far, its node
    for k, g in enumerate(gaps, 1):
        while s < len(spans) and spans[s][0] < g.a:
            around.append(spans[s])
            s += 1
        if around:
            around = [x for x in around if x[1] >= g.a]
        begun = 0
        while h < len(hard) and hard[h] <= g.a:
            begun = hard[h]
            h += 1
        if begun:  # a sentence ended here, whatever the path
            start, cost, node = min(running, key=lambda r: r[1])
            running = [(max(start, begun), cost, node)]
        going, best = [], (math.inf, 0)
        for start, cost, node in running:
            odds = _odds(block, start, g, around, lex)
            if odds > -SURE:
                best = min(best, (cost + _cost(odds) + _scrap(block, start, g, odds), node))
            if odds < SURE:
                going.append((start, cost + _cost(-odds), node))
        if best[0] < math.inf:
            back[k] = best[1]
            going.append((g.e, best[0], k))
        running = going
        if len(running) > 1:
            cheapest: dict[tuple[int, int], tuple[int, float, int]] = {}
            for r in running:
                key = (sum(o >= r[0] for o, _ in around), 0) if r[0] < g.a - NEAR else (-1, r[0])
                if key not in cheapest or r[1] < cheapest[key][1]:
                    cheapest[key] = r
            running = list(cheapest.values())
    at = min(running, key=lambda r: (r[1], -r[2]))[2]
    out = []
    while at > 0:
        out.append(gaps[at - 1].e)
        at = back[at]
    return out[::-1]


def _scrap(block: str, start: int, g: Gap, odds: float) -> float:
    """What an uncertain sentence costs if it is a word of three letters at most."""
    return 1.0 if odds < SURE and len(block[start : g.a].strip()) <= 3 else 0.0


def sentence_spans(text: str, lex: Lexicon) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points counted from 0."""
    text = text.replace("\r", "\n") if "\r" in text and "\r\n" not in text else text.replace("\r\n", " \n")
    out, at = [], 0
    for m in [*_BLOCKS.finditer(text), None]:
        end = m.start() if m else len(text)
        out += [(at + s, at + e) for s, e in cut_block(text[at:end], lex)]
        at = m.end() if m else end
    return out


_AFTER = re.compile(r"(?:[.!?…][\"”»’]|…|\.\.\.)\s+([a-zà-ÿа-яα-ω]\w*)")
_FIRST = re.compile(r"(?:^|\n[^\S\n]*\n)[^\S\n]*(?:[>#*/-]+[^\S\n]+|\d+\)[^\S\n]+)*([a-zà-ÿа-яα-ω][\w-]*)")
_SURE_RUN = re.compile("(?:^|\n\\s*\n|[。！？])\\s*([぀-ヿ㐀-鿿]{1,4})")
_SMALL_WORD = re.compile(r"(?<!\S)[a-zà-ÿа-яα-ω][\w-]*")
_QUOTED = re.compile(r'"(?:[^"\n]|\n(?!\s*\n))*"|“[^”]*”|«[^»]*»|„[^“]*“|\([^()]*\)')
_BARE = re.compile(r"[^\W\d_](?:[\w.'’-]*\w)?")
_LEFT, _RIGHT = "\"'“‘„«‹([{¿¡（「*_`", ",;:!?…)\"”»’]"


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text) to (kind, term, n, opens, bare): words in small letters (w; opens: at a block's start), those after a closed quotation or a pause (f), abbreviations that may end a sentence (a; opens: before a capital), documents with a short word before a dot outside of quotations (d; opens: at a block's end; bare: without a dot) and n-grams of spaceless runs (g; opens: at a block's start or after a certain end)."""
    n: dict[str, Counter] = {k: Counter() for k in "wfagt"}
    opens: dict[str, Counter] = {k: Counter() for k in "wfagt"}

    def out() -> pd.DataFrame:
        dotted, last, bare = Counter(), Counter(), Counter()
        for token, c in n["t"].items():
            t = token.lstrip(_LEFT)
            if t[-1:] == "." and t[-2:-1] != "." and _BARE.fullmatch(t[:-1]):
                dotted[t[:-1].lower()] += c
                last[t[:-1].lower()] += opens["t"][token]
            elif (t := t.rstrip(_RIGHT)).isalpha():
                bare[t.lower()] += c
        rows = [(k, t, c, opens[k][t], 0) for k in "wfag" for t, c in n[k].items()] + [("d", t, dotted[t], last[t], bare[t]) for t in {*dotted, *bare}]
        return pd.DataFrame(rows, columns=["kind", "term", "n", "opens", "bare"]).astype({"n": "int64", "opens": "int64", "bare": "int64"})

    for pdf in batches:
        for t in pdf["text"]:
            if not t:
                continue
            opens["w"].update(_FIRST.findall(t))
            n["w"].update(_SMALL_WORD.findall(t))
            n["f"].update(_AFTER.findall(t))
            plain = _QUOTED.sub(" ", t)
            words = t.split()
            n["t"].update({w for w in (plain.split() if plain != t else words) if len(w) < 11})  # once a document
            opens["t"].update({w for b in _BLOCKS.split(plain) if (w := b[-11:].split()[-1:]) and len(w := w[0]) < 11 and w[-1] == "."})
            for w, nxt in zip(words, words[1:]):
                if w[-1] == "." and len(w) < 9 and nxt[0].isalpha() and (w := w[:-1].lower().lstrip("\"'(“„«")) in OUTER:
                    n["a"][w] += 1
                    opens["a"][w] += nxt[0].isupper()
            if _SPACELESS.search(t):
                for r in _RUN.findall(t):
                    n["g"].update(r[i : i + k] for k in (1, 2, 3, 4) for i in range(len(r) - k + 1))
                for r in _SURE_RUN.findall(t):
                    opens["g"].update(r[:k] for k in range(1, len(r) + 1))
        if len(n["w"]) + len(n["g"]) + len(n["t"]) > 400_000:
            yield out()
            for c in (*n.values(), *opens.values()):
                c.clear()
    yield out()


def learn_lexicon(texts: DataFrame) -> tuple[Lexicon, DataFrame | None]:
    """The lexicon of all texts (column `text`), and (kind, term) of openers and abbreviations that are too many for it, if they are.

    Whether a term is kept depends on its own counts, not on the size of the corpus. Followers and
    dictionary words are kept by their share, which is what their use is about.
    """
    counts = texts.mapInPandas(count_words, "kind string, term string, n bigint, opens bigint, bare bigint").groupBy("kind", "term").agg(*[F.sum(c).alias(c) for c in ("n", "opens", "bare")])
    counts = materialise(counts, "words")  # used twice
    total = counts.groupBy("kind").agg(F.sum("n").alias("all_n"), F.sum("opens").alias("all_opens"))
    is_kind = lambda k: F.col("kind") == k
    least = lambda share, of: F.greatest(F.lit(2.0), share * F.col(of))
    keep = (
        F.when(is_kind("a"), F.lit(True))
        .when(is_kind("f"), F.col("n") >= least(FOLLOWS, "all_n"))
        .when(is_kind("w"), F.col("opens") >= F.greatest(F.lit(2.0), OPENS * F.col("n")))
        .when(is_kind("d"), (F.col("n") - F.col("opens") >= SEEN * F.pow(F.lit(2.0), F.length("term") - 1)) & (F.col("bare") <= BARE * (F.col("n") + F.col("bare"))) & (F.col("opens") <= LAST * F.col("n")))
        .otherwise(F.col("n") >= least(LEAST, "all_n"))
    )
    listed = F.when(is_kind("w"), F.col("opens") >= LEAST * F.col("all_opens")).when(is_kind("d"), F.col("n") >= LEAST * F.col("all_n")).otherwise(F.lit(True))
    judged = counts.join(F.broadcast(total), "kind").select("kind", "term", "n", "opens", "all_n", keep.alias("keep"), listed.alias("listed"))  # five rows
    kept = materialise(judged.filter("keep"), "lexicon")
    few = kept.filter("not listed").count() <= MOST_TERMS
    openers, followers, outer, words, opening, short = set(), set(), {}, {}, {}, set()
    for r in (kept if few else kept.filter("listed")).toLocalIterator():
        if r.kind == "w":
            openers.add(r.term)
        elif r.kind == "f":
            followers.add(r.term)
        elif r.kind == "a":
            outer[r.term] = r.opens / r.n
        elif r.kind == "d":
            short.add(r.term)
        else:
            words[r.term] = math.log(r.n / r.all_n) + 1.5 * (len(r.term) - 1)
            opening[r.term] = r.opens / r.n
    return Lexicon(frozenset(openers), frozenset(followers - openers), outer, words, opening, frozenset(short)), None if few else kept.filter("not listed").select("kind", "term")


_GAP_WORD = re.compile(r"[.!?…][^\w\s]*\s+(?:[^\w\s]+\s+)*[^\w\s]*([^\W\d_][\w'’.-]*)")


def gap_terms(text: str) -> list[str]:
    """Terms at the gaps of a text that the lexicon may know: w and the word after an end mark, d and the short word before a dot."""
    after = {f"w{x}" for w in _GAP_WORD.findall(text) for x in (w, w.rstrip(".'’-")) if w[0].islower()}
    before = {f"d{_INVISIBLE.sub('', t).lstrip(_LEFT)[:-1].lower()}" for t in text.split() if len(t) < 16 and t[-1] == "."}
    return sorted(after | before)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _gap_terms(texts: pd.Series) -> pd.Series:
    return pd.Series([gap_terms(t) if t else [] for t in texts], dtype=object)


def with_rare(source: DataFrame, rare: DataFrame) -> DataFrame:
    """Adds __rare: the terms of `rare` that stand at gaps of the row's text, after their kind. Rows are told by a hash; equal rows share theirs."""
    row = F.xxhash64("doc_id", "text")
    terms = source.select(row.alias("__row"), F.explode(_gap_terms("text")).alias("__term")).distinct()
    found = skewed_join(terms, rare.select(F.concat("kind", "term").alias("__term")), "__term", ["__row"]).groupBy("__row").agg(F.collect_set("__term").alias("__rare"))
    return source.withColumn("__row", row).join(found, "__row", "left").drop("__row")


def sentence_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos): one row per sentence."""
    source = spread(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "doc_id")
    lex, rare = learn_lexicon(source.select("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [lex] * len(pdf)
            if "__rare" in pdf:
                own = [lex if r is None else lex.with_rare([t[1:] for t in r if t[0] == "w"], [t[1:] for t in r if t[0] == "d"]) for r in pdf["__rare"]]
            spans = [sentence_spans(t, x) if t else [] for t, x in zip(pdf["text"], own)]
            flat = np.array([x for s in spans for x in s], dtype=np.int32).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy(), [len(s) for s in spans]), "start_pos": flat[:, 0], "end_pos": flat[:, 1]})

    return (source if rare is None else with_rare(source, rare)).mapInPandas(run, "doc_id bigint, start_pos int, end_pos int")
