import random

import numpy as np
import pytest

from riskloom.llm.leakage import EDITS, STRETCH, ItemIndex, leak_report, leaked_items, plain_words, stretch

RNG = random.Random(4)
WORDS = [f"word{i}" for i in range(300)]
ITEMS = [(i, " ".join(["shared", "opening", "line", *RNG.choices(WORDS, k=80)]), "s", "high") for i in range(1, 41)]


def noise(n):
    return RNG.choices(WORDS, k=n)


def test_words():
    text = "> The **bold** wo-\n> rd, nes­ted ﬁne <em>See</em> [link](http://x) &amp; it​s\n// new **line**\n- Entry ÄÖ"
    assert plain_words(text) == "the bold word nested fine see link its new line entry ao".split()
    assert plain_words("") == [] and plain_words(" .,- ") == []


@pytest.mark.parametrize("length, edits, found", [(30, 0, True), (32, 2, True), (60, 2, True), (27, 0, False), (40, 7, False)])
def test_stretches(length, edits, found):
    item = ITEMS[0][1].split()
    part = item[10 : 10 + length]
    for k in range(edits):
        at = (k + 1) * length // (edits + 1)
        part[at] = "changed"
    doc = [*noise(50), *part, *noise(50)]
    index = ItemIndex([(i, t) for i, t, _, _ in ITEMS])
    ids = [np.array([index.vocabulary.get(w, -1) for w in doc], dtype=np.int32)]
    assert ([(index.ids[k]) for _, k, _ in index.leaks(ids)] == [1]) == found


def test_dropped_and_added_words():
    item = ITEMS[2][1].split()
    index = ItemIndex([(i, t) for i, t, _, _ in ITEMS])
    own = lambda ws: [np.array([index.vocabulary.get(w, -1) for w in ws], dtype=np.int32)]
    part = item[5:37]
    assert index.leaks(own([*noise(20), *part[:10], *part[11:20], "added", *part[20:], *noise(9)]))[0][2] >= STRETCH
    a = np.array([index.vocabulary[w] for w in item], dtype=np.int32)
    assert stretch(a, a, 40, 40)[0] == len(item)


def test_retrieval_loses_no_case_of_brute_force():
    index = ItemIndex([(i, t) for i, t, _, _ in ITEMS])
    docs = []
    for _ in range(150):
        w = noise(RNG.randint(20, 90))
        for _ in range(RNG.randint(0, 2)):
            item = RNG.choice(ITEMS)[1].split()
            s = RNG.randint(0, 40)
            part = item[s : s + RNG.randint(20, 40)]
            for _ in range(RNG.randint(0, EDITS)):
                part[RNG.randrange(len(part))] = "odd"
            w += part + noise(5)
        docs.append(np.array([index.vocabulary.get(x, -1) for x in w], dtype=np.int32))
    got = {(d, k) for d, k, _ in index.leaks(docs)}
    want = set()
    for d, w in enumerate(docs):
        for k, a in enumerate(index.words):
            if any(a[i] == w[j] and stretch(a, w, i, j)[0] >= STRETCH for i in range(len(a)) for j in range(len(w)) if j + 9 < len(w) and i + 9 < len(a) and (a[i : i + 9] == w[j : j + 9]).all()):
                want.add((d, k))
    assert got == want and len(want) > 40


def test_items_of_frequent_words_only():
    items = [(i, " ".join(["the", "of"] * 40 if i < 30 else ["the", "of", *noise(70)])) for i in range(40)]
    index = ItemIndex(items)
    ids = lambda ws: [np.array([index.vocabulary.get(w, -1) for w in ws], dtype=np.int32)]
    assert len(index.always) == 30 and {k for _, k, _ in index.leaks(ids([*noise(9), *["the", "of"] * 20]))} == set(range(30))
    assert index.leaks(ids(noise(99))) == []


def test_tables(spark):
    text = ITEMS[4][1]
    docs = [(1, text, "x"), (2, text.upper(), "x"), (3, None, "x"), (4, "", "x"), (5, " ".join(noise(2000)), "x"), (6, " ".join(noise(3000)) + " " + text + " high", "x"), (1, text, "x"), (7, "shared opening line", "x")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, (99, None, "s", None), (98, "short", "s", None)], "item_id long, text string, suite string, answer string")
    found = leaked_items(documents, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 5), (1, 5), (2, 5), (6, 5)]
    report = leak_report(found, items).first()
    assert report.documents == 3 and report.with_answer == 1
    assert leaked_items(documents.limit(0), items).count() == 0 and leaked_items(documents, items.limit(0)).count() == 0
