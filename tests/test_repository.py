"""The life of a repository, and the operators behind it."""

import json

import pytest
from pyspark.sql import functions as F

from calcstrata import cli
from calcstrata.functions import scalars as S
from calcstrata.operators import commits, render, snapshots
from calcstrata.plans import texts
from calcstrata.schemas import BlobNotFoundError, RepositoryError, StagingError
from calcstrata.sources.repository import Repository


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    r = Repository(spark, str(root)).init()
    (root / "run").mkdir()
    (root / "run" / "INCAR").write_text(texts.PAIRS["run/INCAR"][0])
    (root / "run" / "notes.txt").write_text("first")
    (root / "x.tmp").write_text("ignored")
    r.first_add = {x["path"]: x["status"] for x in r.add().collect()}
    r.first = r.commit("first\nmore", author="a@b")
    (root / "run" / "INCAR").write_text(texts.PAIRS["run/INCAR"][1])
    (root / "run" / "KPOINTS").write_text(texts.PAIRS["run/KPOINTS"][0])
    r.before_second = [(x["path"], x["old_value"], x["new_value"]) for x in r.diff().orderBy("ord", "path").collect()]
    r.add(["run"])
    r.marks = {x["path"]: x["mark"] for x in r.status().collect()}
    r.second = r.commit("second", author="a@b")
    return r


def test_staging(repo):
    assert repo.first_add == {"run/INCAR": "added", "run/notes.txt": "added", "x.tmp": "ignored"}
    assert repo.marks == {"run/INCAR": "M", "run/KPOINTS": "A", "run/notes.txt": "="}
    with pytest.raises(StagingError):
        repo.add(["../elsewhere"])
    with pytest.raises(RepositoryError):
        repo.commit("nothing")


def test_overlay_and_history(repo):
    assert sorted(r["path"] for r in repo.snapshot().collect()) == ["run/INCAR", "run/KPOINTS", "run/notes.txt"]
    assert [r["commit_hash"] for r in repo.log().collect()] == [repo.second, repo.first]
    assert [r["commit_hash"] for r in repo.log(start=repo.first).collect()] == [repo.first]
    assert repo.resolve("HEAD~1") == repo.first and repo.resolve(repo.first[:12]) == repo.first
    for bad in ("HEAD~5", "zz", ""):
        with pytest.raises(RepositoryError):
            repo.resolve(bad)


def test_diffs(repo):
    want = [("ENCUT", "520", "600"), ("ISMEAR", "0", "1"), ("LWAVE", None, "false"), ("SIGMA", "0.05", "0.1")]
    assert repo.before_second == want
    assert [(r["path"], r["old_value"], r["new_value"]) for r in repo.diff("HEAD", "HEAD~1").orderBy("ord", "path").collect()] == want
    assert {r["path"]: r["change"] for r in repo.changed_files("HEAD", "HEAD~1").collect()} == {"run/INCAR": "modified", "run/KPOINTS": "added"}
    assert repo.diff().isEmpty()
    with pytest.raises(RepositoryError):
        repo.diff(path="nowhere")


def test_blobs_and_reproduce(repo, tmp_path):
    h = repo.snapshot().where("path = 'run/notes.txt'").first()["blob_hash"]
    assert repo.read_blob(h) == b"first" and repo.blob_exists(h) and not repo.blob_exists("zz")
    with pytest.raises(BlobNotFoundError):
        repo.read_blob("0" * 64)
    assert {r["status"] for r in repo.reproduce(repo.first, str(tmp_path / "out")).collect()} == {"ok"}
    assert (tmp_path / "out" / "run" / "INCAR").read_text() == texts.PAIRS["run/INCAR"][0]
    assert all(r["ok"] for r in commits.audit(repo.commits()).collect())
    assert all(r["matches"] for r in repo.environment("HEAD").collect())


def test_canonical_json_is_sorted(spark):
    df = spark.createDataFrame([(None, "t", "ä", "m", [("h", "X", False, "b", 1), ("g", None, False, "a", 2)])], "parent_hash string, timestamp string, author string, message string, files array<struct<blob_hash:string,file_type:string,is_reference:boolean,path:string,size_bytes:bigint>>")
    text = df.select(commits.canonical(df).alias("j")).first()["j"]
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False) and [f["path"] for f in json.loads(text)["files"]] == ["a", "b"]


def test_cli(repo, spark):
    root = ["-C", repo.root]
    assert cli.run(["version"]) == cli.VERSION
    assert cli.run([*root, "log", "--oneline"], spark).splitlines() == [f"{repo.second[:7]} second", f"{repo.first[:7]} first"]
    assert "ENCUT: 520 -> 600 [critical]" in cli.run([*root, "diff", "HEAD", "HEAD~1", "--format", "detailed"], spark)
    assert json.loads(cli.run([*root, "log", "--format", "json"], spark))[0]["commit_hash"] == repo.second
    assert "file-format on" in cli.run([*root, "plugin", "enable", "file-format"], spark)
    assert "settings: {'enabled': True}" in cli.run([*root, "plugin", "info", "file-format"], spark)
    assert "-ENCUT = 520" in cli.run([*root, "diff", "HEAD", "HEAD~1", "--format", "unified"], spark)
    assert "ok       hostname" in cli.run([*root, "reproduce", "HEAD", "-o", f"{repo.root}-out", "--verify-env"], spark)
    with pytest.raises(RepositoryError):
        cli.run([*root, "plugin", "info", "nothing"], spark)


def test_render_styles(spark):
    df = spark.createDataFrame([("f", 1, "a", "1", "2", "modified", "critical"), ("f", 2, "b", None, "3", "added", "minor")], "file string, ord int, path string, old_value string, new_value string, change_type string, significance string")
    assert render.diff_lines(df, "compact").first()["text"] == "~a, +b"
    assert render.diff_lines(df).first()["text"] == "~ !! a: 1 -> 2\n+ b: 3"


@pytest.mark.parametrize(
    ("path", "hit"),
    [("venv/x", True), ("venv2/x", False), ("a/venv/x", False), ("a/b.tmp", True), ("deep/er/c.log", True), ("c.txt", False), ("k1", True), ("kx", False)],
)
def test_ignore(spark, path, hit):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(S.ignored(F.col("path"), ["venv/", "*.tmp", "deep/*.log", "k[!a-z]"]).alias("i")).first()["i"] is hit


def test_page_and_prefix(spark):
    rows = [(c * 64, f"2026-01-01T10:0{i}:00Z") for i, c in enumerate("abcde")]
    df = spark.createDataFrame(rows, "commit_hash string, timestamp string")
    assert snapshots.page_from(df, "c" * 64).count() == 3 and snapshots.page_from(df, "f" * 64).count() == 0
    assert snapshots.page_from(df, "e" * 64, 2).count() == 2 and snapshots.history(df, 3).count() == 3 and snapshots.history(df, 0).count() == 5
    assert snapshots.latest(df).first()["commit_hash"] == "e" * 64
    with pytest.raises(ValueError):
        snapshots.by_prefix(df, "%")


def test_streaming_facts(spark, tmp_path):
    from calcstrata.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "INCAR").write_text("ENCUT = 520\n")
    watch.facts_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["path"]: r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"ENCUT": "520"}


def test_windowed_counts(spark):
    from calcstrata.streaming import watch

    df = spark.createDataFrame([("2026-01-01 00:01:00", "a", 1.0), ("2026-01-01 00:09:00", "a", 2.0), ("2026-01-01 00:11:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["total"]) for r in watch.windowed_counts(df).collect()) == [(1, 4.0), (2, 3.0)]


def test_tracked_untracked_and_hidden_files(spark, tmp_path):
    r = Repository(spark, str(tmp_path)).init()
    (tmp_path / "_tmp").mkdir()
    (tmp_path / ".hidden").write_text("a")
    (tmp_path / "_tmp" / "x.txt").write_text("b")
    (tmp_path / "run.out").write_text("Program Version 5.0.3\nSCF not converged\nFINAL SINGLE POINT ENERGY -1.5\nORCA TERMINATED NORMALLY\n")
    (tmp_path / "INCAR").write_text("ENCUT = 520\n")
    assert {x["path"] for x in r.add([".hidden", "_tmp", "run.out"]).collect()} == {".hidden", "_tmp/x.txt", "run.out"}
    name = r.commit("outputs")
    told = r.outputs().first()
    assert (told["commit_hash"], told["total_energy"], told["is_converged"]) == (name, -1.5, False)
    assert r.commit_exists(name) and not r.commit_exists(name[:10]) and not r.commit_exists("zz")
    assert r.schema_version() == 1 and Repository(spark, str(tmp_path / "_tmp")).schema_version() == 0 and r.stored_size() > 0
    assert [(x["path"], x["change_type"]) for x in r.diff(path="INCAR").collect()] == [("ENCUT", "added")]
    assert r.diff().isEmpty()
    (tmp_path / ".hidden").write_text("changed\n")
    assert r.unified().first()["text"].splitlines()[-2:] == ["-a", "+changed"]
    r.commit("all", all_tracked=True)
    assert {x["path"] for x in r.changed_files("HEAD", "HEAD~1").collect()} == {".hidden"}
    assert {x["status"] for x in r.reproduce("HEAD", str(tmp_path / "out"), verify=False).collect()} == {"written"}


def test_plugins(spark, tmp_path):
    from calcstrata.operators.validate import Rule
    from calcstrata.plugins import Manager, ValidatorPlugin

    class Own(ValidatorPlugin):
        name, seen = "own", []

        def applies(self):
            return F.array_contains("names", "INCAR")

        def rules(self):
            return [Rule("own", "error", F.col("INCAR").contains("bad"), "bad")]

        def activate(self):
            self.seen.append("on")

        def deactivate(self):
            self.seen.append("off")

    class Broken(Own):
        name, priority = "broken", 1

        def rules(self):
            return [Rule("x", "error", F.col("no_such_column") == 1, "x")]

    class Late(Own):
        name, priority = "late", 2

        def rules(self):
            return [Rule("x", "error", F.raise_error(F.lit("at run time")).isNull(), "x")]

    class Point:
        def __init__(self, name, load):
            self.name, self.load = name, load

    at = tmp_path / "plugins.json"
    at.write_text("{not json")
    m = Manager(str(at))
    assert m.settings == {}
    with pytest.warns(UserWarning, match="left out"):
        assert m.discover(lambda: [Point("bad", lambda: 1 / 0), Point("own", lambda: Own)]) == ["own"]
    for p in (Broken(), Late()):
        m.register(p)
    assert [v["name"] for v in m.list()] == ["broken", "late", "file-format", "poscar-potcar", "incar-poscar", "own"]
    table = spark.createDataFrame([("a/INCAR", "bad = 1"), ("b/INCAR", "ok = 1")], "path string, text string")
    got = {(r["rule"], r["dir"]): r["passed"] for r in m.run(table, isolate=True).collect()}
    assert got == {(n, d): n == "own" and d == "b" for n in ("broken", "late", "own") for d in "ab"}
    m.set_enabled("broken", False)
    m.set_config("own", limit=3)
    again = Manager(str(at))
    assert again.config("own") == {"limit": 3} and again.config("broken") == {"enabled": False} and again.get("file-format").version
    m.unregister("own")
    assert Own.seen[-1] == "off" and m.get("own") is None
    with pytest.raises(KeyError):
        m.set_enabled("nothing", True)
