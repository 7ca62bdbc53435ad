from datetime import datetime

import pytest

from riskloom.operators.history import KEYWORDS, derived_features, directories, features_of_commits, labelled, retouched, single_commit
from riskloom.schemas import COMMIT

T0 = datetime(2024, 1, 15, 10)
TOUCH = "touch_id long, hash string, source_repo string, new_path string, old_path string, date timestamp_ntz, seq long, ord int"


def touches(spark, rows):
    return spark.createDataFrame([(i, h, r, n, o, d, i, 0) for i, (h, r, n, o, d) in enumerate(rows)], TOUCH)


def commit(h, author="TestAuthor", msg="test commit", seq=0, when=datetime(2024, 1, 15, 10, 30), files=(("src/module.py", None),), n=2, repo="r", offset=0):
    return (h, repo, author, when, offset, seq, 10, 5, n, [{"new_path": a, "old_path": b} for a, b in files], msg)


@pytest.mark.parametrize("gap, hit", [(datetime(2024, 1, 22, 10), True), (datetime(2024, 1, 23, 9, 59, 59), True), (datetime(2024, 1, 23, 10), False), (T0, True)])
def test_window_bound(spark, gap, hit):
    got = retouched(touches(spark, [("a", "r", "p", None, T0), ("b", "r", "p", None, gap)]), 7).collect()
    assert [x.hash for x in got] == (["a"] if hit else [])


def test_renames_repositories_and_repeated_paths(spark):
    later = datetime(2024, 1, 16)
    t = touches(spark, [("a", "r", "", "old", T0), ("b", "r", "old", None, later), ("c", "q", "old", None, later), ("d", "r", "x", None, T0), ("d", "r", "x", None, T0), ("e", "r", None, None, T0)])
    assert {x.hash for x in retouched(t).collect()} == {"a", "d"}
    assert {x.hash for x in retouched(t, distinct_per_commit=True).collect()} == {"a"}
    assert retouched(t.limit(0)).count() == 0


def test_label_counts_reverts_and_commits_without_touches(spark):
    c = spark.createDataFrame([(1, "a", "x"), (2, "z", "Revert it"), (3, None, None), (4, "b", "")], "row_id int, hash string, commit_msg string")
    t = touches(spark, [("a", "r", "p", None, T0), ("b", "r", "p", None, T0)])
    assert {r.row_id: r.label for r in labelled(c, t).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_directories(spark):
    t = touches(spark, [("a", "r", p, None, T0) for p in ("src/x", "src/y", "src/a/z", "root", "docs/q")])
    assert [(r.hash, r.dirs) for r in directories(t).collect()] == [("a", 3)]


def test_features_of_nested_commits(spark):
    rows = [
        commit("1", "Alice", "Fix login issue", 1, files=[("src/a", None), ("src/b", None), ("tests/c", None), ("docs/d", None)], n=4),
        commit("2", "Alice", "debug prefix", 2, when=datetime(2024, 1, 17, 23, 45)), commit("3", "Bob", "Add feature", 3, files=[], n=0),
        commit("4", "Alice", None, 4, repo="q"), commit("5", "Bob", "añ😀", 5, when=datetime(2024, 1, 17, 18, 15), offset=19800),
    ]
    got = {r.hash: r for r in features_of_commits(spark.createDataFrame(rows, COMMIT)).collect()}
    assert (got["1"].dirs_touched, got["1"].files_touched, got["1"].is_fix_bug_revert, got["1"].author_prior_commits) == (3, 4, 1, 0)
    assert (got["2"].hour_of_day, got["2"].day_of_week, got["2"].is_fix_bug_revert, got["2"].author_prior_commits) == (23, 2, 1, 1)
    assert (got["3"].dirs_touched, got["3"].is_fix_bug_revert) == (0, 0)
    assert (got["4"].author_prior_commits, got["4"].commit_msg_length, got["4"].commit_msg) == (0, 0, "")
    assert (got["5"].hour_of_day, got["5"].day_of_week, got["5"].commit_msg_length) == (23, 2, 3)


def test_single_commit(spark):
    df = spark.createDataFrame([commit("deadbeef123")], COMMIT)
    assert "commit_msg" not in single_commit(df, "deadbeef123").columns
    with pytest.raises(ValueError):
        single_commit(df, "none")


def test_derived_features_keep_rows_without_author_or_touches(spark):
    c = spark.createDataFrame([(1, "a", "r", "A", 1, T0, "x"), (2, None, None, None, None, None, None), (3, "b", "r", "A", 2, T0, "bug")], "row_id int, hash string, source_repo string, author string, seq long, date timestamp_ntz, commit_msg string")
    got = {r.row_id: r for r in derived_features(c, touches(spark, [("a", "r", "d/p", None, T0)])).collect()}
    assert got[3].prior_commits == 1 and got[2].prior_commits is None and got[1].dirs == 1 and got[2].files == 0 and got[3].keyword == 1
    assert KEYWORDS[0] == "fix"
