import subprocess
from datetime import datetime, timedelta

import pytest

from riskloom.cli import main
from riskloom.plans.retrain import checked, ingest, predict, retrain
from riskloom.schemas import COMMIT, FEATURES, MODEL_VERSION
from riskloom.sources import gitlog


def make(spark, n=240):
    t0 = datetime(2024, 1, 1)
    rows = [(f"{i:040x}", f"r{i % 2}", f"a{i % 7}", t0 + timedelta(days=i), 3600, i, i % 90, i % 11, 1, [{"new_path": f"d/f{i % (3 if i % 2 else 40)}", "old_path": None}], "fix" if i % 4 else "revert x") for i in range(n)]
    return spark.createDataFrame(rows, COMMIT)


def test_ingest_labels_and_features(spark):
    df = ingest(make(spark))
    assert {*FEATURES, "hash", "risky", "source_repo"} <= set(df.columns) and "commit_msg" not in df.columns and df.count() == 240
    # odd commits touch one of three files of their repository every two days, so each comes again after six; even ones after forty or more
    want = {f"{i:040x}" for i in range(240) if i % 4 == 0 or (i % 2 and i + 6 < 240)}
    assert {r.hash for r in df.filter("risky = 1").collect()} == want


def test_checks_stop_the_run(spark):
    with pytest.raises(ValueError, match="min_rows"):
        checked(ingest(make(spark, 20)))


def test_retrain_and_predict(spark):
    versions = spark.createDataFrame([("9", "x", "Production", 0.0)], MODEL_VERSION)
    results, after, model = retrain(make(spark), versions, kinds=("logistic",))
    stages = {r.version: r.stage for r in after.collect()}
    assert results.count() == 1 and stages == {"9": "Archived", "10": "Production"}
    good = dict(zip(FEATURES, (42, 10, 3, 2, 5, 14, 1, 45, 0)))
    got = predict(spark, model, good | {"hash": "abc"})
    assert 0 <= got["risk_score"] <= 1 and got["commit_hash"] == "abc" and got["risk_label"] in ("low", "medium", "high")
    for bad in ({}, {"wrong": 1}, "text", good | {"hour_of_day": 24}, good | {"lines_added": None}):
        with pytest.raises(ValueError):
            predict(spark, model, bad)
    with pytest.raises(RuntimeError):
        predict(spark, None, good)


@pytest.fixture
def repository(tmp_path):
    at = tmp_path / "work"
    at.mkdir()
    run = lambda *a, **env: subprocess.run(["git", "-C", str(at), *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path), "GIT_AUTHOR_NAME": "Ann B", "GIT_AUTHOR_EMAIL": "a@b.example", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@d.example", **env})
    run("init", "-q")
    for i, (name, msg) in enumerate([("src/a.py", "add a"), ("src/b.py", "fix: two\n\nbody ü"), ("src/a.py", "touch a again")]):
        (at / "src").mkdir(exist_ok=True)
        (at / name).write_text("x\n" * (i + 1))
        run("add", "-A")
        run("commit", "-q", "-m", msg, GIT_AUTHOR_DATE=f"2024-01-0{i + 1}T23:30:00+05:30", GIT_COMMITTER_DATE=f"2024-01-0{i + 1}T23:30:00+05:30")
    run("mv", "src/b.py", "src/c.py")
    run("commit", "-q", "-m", "rename", GIT_AUTHOR_DATE="2024-03-01T00:00:00Z", GIT_COMMITTER_DATE="2024-03-01T00:00:00Z")
    return str(at)


def test_git_source_and_command_line(spark, repository, tmp_path):
    df = gitlog.commits(spark, repository, slice="2")
    rows = sorted(df.collect(), key=lambda r: r.seq)
    assert [r.msg.split("\n")[0] for r in rows] == ["add a", "fix: two", "touch a again", "rename"]
    assert rows[1].author == "Ann B" and rows[1].tz_offset_s == 19800 and rows[1].author_date.hour == 18 and rows[1].msg.endswith("body ü") and rows[2].insertions == 2
    assert tuple(rows[3].modified_files[0]) == ("src/c.py", "src/b.py") and gitlog.renamed("a => b") == ("b", "a")
    labels = {r.seq: r for r in ingest(df).join(df.select("hash", "seq"), "hash").collect()}
    assert labels[0].risky == 1 and labels[1].risky == 0 and labels[1].hour_of_day == 23
    assert gitlog.commits(spark, repository, since="2024-02-01").count() == 1
    assert main(["extract", "--repo-path", repository, "--output", str(tmp_path / "out")], spark) == 0
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 4
    clone = gitlog.open_repository(f"file://{repository}", str(tmp_path / "cache"))
    assert gitlog.open_repository(f"file://{repository}", str(tmp_path / "cache")) == clone and gitlog.open_repository(repository, "x") == repository
    with pytest.raises(RuntimeError):
        gitlog.git(str(tmp_path), "rev-list", "HEAD")
