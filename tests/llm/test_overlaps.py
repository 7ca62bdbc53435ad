import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import overlaps
from riskloom.llm.overlaps import SEGMENTS, block_keys, bumps, cross_split_overlaps, fingerprints, folded, hash_overlaps, normal_words, overlap_report, overlap_rows, probe_keys, reverts, same_text, text_overlaps, word_edits

SCHEMA = "row_id long, hash string, commit_msg string, data_split string, source_repo string, risky int"
BASE = "Fix the login form so that wrong passwords are logged once per session and never shown again to anyone"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "repo", i % 2) for i, r in enumerate(rows)], SCHEMA)


def pairs(df):
    return {tuple(r) for r in df.collect()}


CHANGES = [
    (BASE, True), (BASE.upper(), True), ("[backport] " + BASE + " (#123)", True), (BASE.replace(" once per ", "\nonce  per ").replace("form", "form,"), True),
    (BASE + "\n\nSigned-off-by: A B <a@b.example>\n(cherry picked from commit 0123456789abcdef)", True),
    (BASE.replace("login", "logout").replace("wrong", "bad").replace("never", "not"), True),
    (BASE.replace(" the", "").replace(" wrong", ""), True),
    (BASE.replace("login", "logout").replace("wrong", "bad").replace("never", "not").replace("anyone", "all"), False),
    ('Revert "' + BASE + '"', False), ("Fix the login form", False), ("", False), (None, False),
]


def test_changes_that_leave_a_text_the_same(spark):
    df = table(spark, [(None, BASE, "train"), *[(None, other, "test") for other, _ in CHANGES]])
    assert pairs(cross_split_overlaps(df)) == {(0, i) for i, (_, found) in enumerate(CHANGES, 1) if found}


def test_automatic_messages_of_other_packages_or_versions_are_other_changes(spark):
    text = "Bump {0} from {1} to {2}\n\nBumps the pinned package {0} from {1} to {2} in the lock file. Opened by a bot, needs no review."
    df = table(spark, [(None, text.format("a-b", "1.2.3", "1.2.4"), "train"), (None, text.format("c-d", "1.2.3", "1.2.4"), "test"), (None, text.format("a-b", "1.2.3", "1.2.5"), "test"), (None, text.format("a-b", "1.2.3", "1.2.4").replace("pinned", "pnined"), "validation")])
    assert pairs(cross_split_overlaps(df)) == {(0, 3)}
    assert bumps(BASE) == [] and bumps(text.format("a", "1", "2")) == ["a 1 2"]


def test_hashes_in_any_writing(spark):
    h = "95fbebbabdcea6e222e6b9a21645377eb4ea1a8d"
    df = table(spark, [(h, "a", "train"), (h.upper(), "b", "test"), (h[:12], None, "validation"), (f" {h}\n", "", "train"), (h, "c", None), ("short", "d", "test"), ("short", "d", "train"), (None, None, "test")])
    assert pairs(cross_split_overlaps(df)) == {(0, 1), (0, 2), (1, 3), (2, 3)}
    assert pairs(hash_overlaps(df, "row_id", "hash", "data_split")) == {(0, 1), (0, 2), (1, 3), (2, 3)}


def test_copies_ties_long_texts_and_an_empty_table(spark):
    long = " ".join(f"word{i}" for i in range(5000))
    df = table(spark, [(None, BASE, "train")] * 3 + [(None, BASE, "test")] * 2 + [(None, long, "train"), (None, long.replace("word7 ", "other "), "test")])
    assert pairs(cross_split_overlaps(df)) == {(a, b) for a in range(3) for b in (3, 4)} | {(5, 6)}
    assert cross_split_overlaps(df.limit(0)).count() == 0


def brute_edits(a, b):
    """The edit distance of two lists of words, by the whole table."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
    return d[-1][-1]


def test_short_texts_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(60):  # 8 to 20 words after the sign-off line, which makes each message long enough, has gone
        text = [rng.choice(words) for _ in range(rng.randint(8, 20))]
        for _ in range(3):
            new = list(text)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(new))
                if rng.random() < 0.4:
                    del new[at]
                else:
                    new[at] = rng.choice(words)
            rows.append((None, " ".join(new) + "\n\nSigned-off-by: Some One Of Us Here <a@b.example>", rng.choice(["train", "test", "validation"])))
    normal = [r[1].split("\n")[0].split() for r in rows]
    enough = [len(r[1].split()) >= 12 for r in rows]
    got = pairs(text_overlaps(table(spark, rows), "row_id", "commit_msg", "data_split"))
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if enough[i] and enough[j] and (rows[i][2] == "train") != (rows[j][2] == "train") and brute_edits(normal[i], normal[j]) <= 3}
    assert got == want and len(want) > 40


def test_frequent_keys_are_lengthened_and_split(spark, monkeypatch):
    """A stock wording that all messages share, with few limits small enough to reach every depth: the links stay the same."""
    rng = random.Random(13)
    stock = [f"stock{i}" for i in range(30)]
    rows = []
    for i in range(120):
        new = list(stock)
        for at in rng.sample(range(30), rng.randint(0, 6)):
            new[at] = f"own{rng.randrange(10**6)}"
        rows.append((None, " ".join(new), "train" if i % 2 else "test"))
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 != j % 2 and brute_edits(rows[i][1].split(), rows[j][1].split()) <= 3}
    df = table(spark, rows)
    assert pairs(text_overlaps(df, "row_id", "commit_msg", "data_split")) == want and len(want) > 100
    for depth in (0, 1, 3):
        monkeypatch.setattr(overlaps, "FEW", 20)
        monkeypatch.setattr(overlaps, "CHUNK", 7)
        monkeypatch.setattr(overlaps, "DEPTH", depth)
        assert pairs(text_overlaps(df, "row_id", "commit_msg", "data_split")) == want


def test_two_texts_in_one_class_are_told_apart(spark, monkeypatch):
    real = overlaps.xxhash.xxh64_intdigest
    monkeypatch.setattr(overlaps.xxhash, "xxh64_intdigest", lambda x: 7 if isinstance(x, str) and x.startswith("0|") else real(x))
    made = pd.concat(overlaps.fingerprint_rows(iter([pd.DataFrame({"id": [0, 1], "text": [BASE, BASE + " one two three four five"], "side": [1, 2]})]), 12, 3))
    monkeypatch.undo()
    assert made["cls"].nunique() == 1 and made["proof"].nunique() == 2
    monkeypatch.setattr(overlaps, "fingerprint_rows", lambda batches, least, most: (made.iloc[: len(x)] for x in batches))
    df = table(spark, [(None, BASE, "train"), (None, BASE + " one two three four five", "test")]).coalesce(1)
    assert pairs(text_overlaps(df, "row_id", "commit_msg", "data_split")) == set()


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(12, 40))]
        rows.append((None, " ".join(text), "train"))
        for _ in range(3):
            new = list(text)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(new))
                if rng.random() < 0.3 and len(new) > 13:
                    del new[at]
                else:
                    new[at] = rng.choice(words)
            rows.append((None, " ".join(new), rng.choice(["test", "validation", "train"])))
    got = pairs(text_overlaps(table(spark, rows), "row_id", "commit_msg", "data_split"))
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and (a[2] == "train") != (b[2] == "train") and brute_edits(normal_words(a[1]), normal_words(b[1])) <= 3}
    assert got == want and len(want) > 50


def test_report(spark):
    df = table(spark, [(None, BASE, "train"), (None, BASE, "test"), (None, BASE, "test")])
    r = overlap_report(df).first()
    assert (r.data_split, r.source_repo, r.overlapping_rows, r.text_links, r.hash_links, r.label_conflicts) == ("test", "repo", 2, 2, 0, 1)


def test_rows_agree_with_the_pairs(spark, small):
    df = spark.read.parquet(f"{small}/commit_features.parquet")
    split = {r.row_id: r.data_split for r in df.select("row_id", "data_split").collect()}
    want = {}
    for a, b in pairs(cross_split_overlaps(df)):
        held = b if split[a] == "train" else a
        want[held] = want.get(held, 0) + 1
    got = {r.row_id: r for r in overlap_rows(df).collect()}
    assert set(got) == set(want) and all(max(r.text_twins, r.hash_twins) <= want[k] <= r.text_twins + r.hash_twins for k, r in got.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_word_edits_is_the_edit_distance(a, b):
    assert word_edits(a, b, 3) == min(brute_edits(a, b), 4)


def test_a_changed_word_touches_two_symbols_at_most():
    a = [f"w{i}" for i in range(30)]
    blocks, filled = fingerprints([a, [*a[:5], "x", *a[6:]]])
    code = folded(blocks)
    apart = sum(((int(code[0]) ^ int(code[1])) >> (4 * k)) & 15 > 0 for k in range(SEGMENTS))
    assert apart <= 2 and (blocks[0] == blocks[1]).sum() >= 5 and filled.shape == (2, 7)
    assert reverts('Revert "Revert "x""') == 2 and reverts("Reverting is bad") == 1 and reverts("Fix") == 0


def test_short_texts_within_three_words_are_all_found(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):  # three changed words of 12: segment pairs alone lose about 3 %
        text = [f"v{rng.randrange(10**6)}" for _ in range(12)]
        new = list(text)
        for at in rng.sample(range(12), 3):
            new[at] = f"v{rng.randrange(10**6)}"
        rows += [(None, " ".join(text), "train"), (None, " ".join(new), "test")]
    assert pairs(text_overlaps(table(spark, rows), "row_id", "commit_msg", "data_split")) == {(i, i + 1) for i in range(0, len(rows), 2)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=16), st.lists(st.tuples(st.sampled_from(["put", "drop", "change"]), st.integers(0, 16), st.sampled_from("abcdef")), max_size=3))
def test_three_edits_leave_a_block(text, edits):
    new = list(text)
    for how, at, word in edits:
        at = min(at, len(new) - (how != "put"))
        new[max(at, 0) : max(at, 0) + (how != "put")] = [] if how == "drop" else [word]
    for a, b in ((text, new), (new, text)):
        assert set(block_keys(a, 3)) & set(probe_keys(b, 3)) or word_edits(a, b, 3) >= max(len(a), len(b))


def test_three_words_may_change_where_sign_offs_leave_fewer_than_twelve(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta\n\nSigned-off-by: A B <a@b.example>"
    df = table(spark, [(None, text, "train"), (None, text.replace("beta", "x").replace("delta", "y").replace("theta", "z"), "test"), (None, "some quite other words stand in this one\n\nSigned-off-by: A B <a@b.example>", "test")])
    assert pairs(cross_split_overlaps(df)) == {(0, 1)}
    assert not same_text("a b", "c d", 3)
