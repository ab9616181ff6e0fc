"""The blob store, versions with several writers, and folders as source and sink."""

import os
import re

import pytest
from pyspark.sql import functions as F

from calcstrata.schemas import BlobCorruptedError, BlobNotFoundError, RepositoryError
from calcstrata.sources import repository, tree
from calcstrata.sources.blobstore import BlobStore
from calcstrata.sources.files import ConflictError, Files
from calcstrata.sources.manifest import Manifest
from calcstrata.sources.repository import Repository


def hashed(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return df.select(F.sha2("text", 256).alias("blob_hash"), F.col("text").cast("binary").alias("content"))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = BlobStore(spark, f"file://{tmp_path_factory.mktemp('blobs')}/b")
    s.blobs = hashed(spark, [f"text {i} " * (i % 50) for i in range(300)])
    s.first = s.write(s.blobs.where(F.length("content") < 200), compress_from=100)
    s.second = s.write(s.blobs, compress=False)
    return s


def test_tiers_and_round_trip(spark, store):
    assert store.first["tx"] != store.second["tx"] and store.write(store.blobs) is None  # nothing is stored twice
    rows = store.table().collect()
    assert len({r["blob_hash"] for r in rows}) == len(rows) == store.blobs.select("blob_hash").distinct().count()
    assert {r["codec"] for r in rows if r["tx"] == store.first["tx"] and r["size_bytes"] >= 100} == {"gzip"}
    assert all(r["stored_bytes"] == len(r["content"]) and (r["codec"] == "gzip") == bytes(r["content"]).startswith(b"\x1f\x8b") for r in rows)
    assert all(r["shard"] == r["blob_hash"][:2] for r in rows)
    got = {r["blob_hash"]: bytes(r["content"]) for r in store.find(store.blobs.select("blob_hash")).collect()}
    assert got == {r["blob_hash"]: bytes(r["content"]) for r in store.blobs.collect()}


def test_a_lookup_names_few_folders_and_moves_no_blob(spark, store):
    few = store.blobs.limit(3).select("blob_hash").unionByName(spark.createDataFrame([("nothex",), ("0" * 64,)], "blob_hash string"))
    found = store.rows_of(few)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(blob_hash" in plan and "Exchange" not in plan and int(re.search(r"InMemoryFileIndex\((\d+) path", plan)[1]) <= 2 * 4
    assert found.count() == few.where("length(blob_hash) = 64").distinct().count() - 1
    many = store.rows_of(store.blobs.select("blob_hash"))
    plan = many._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "content" in scan
    assert store.rows_of(spark.createDataFrame([], "blob_hash string")).count() == 0


def test_compaction_keeps_what_is_there(spark, store):
    assert store.compacted(least=16) is None
    merged = BlobStore(spark, store.path, store.compacted(least=2))
    assert len(merged.entries) == 1 and merged.table().drop("tx").exceptAll(store.table().drop("tx")).isEmpty() and merged.table().count() == store.table().count()


def test_a_version_is_taken_once(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}")
    m.create({"n": 0})
    version, state = m.read()
    assert m.publish(version, state | {"n": 1}) == version + 1
    with pytest.raises(RepositoryError, match="another writer"):
        m.publish(version, state | {"n": 2})
    assert m.read() == (version + 1, {"n": 1}) and m.read(version) == (version, {"n": 0})
    files = Files(spark, f"file://{tmp_path}")
    files.put("x", "a")
    with pytest.raises(ConflictError):
        files.put_new("x", "b")
    assert files.read("x") == "a" and sorted(files.names()) == ["versions", "x"]


def test_two_writers_and_one_that_dies(spark, tmp_path, monkeypatch):
    (tmp_path / "INCAR").write_text("ENCUT = 500\n")
    a = Repository(spark, str(tmp_path)).init()
    a.add()
    first = a.commit("one")
    (tmp_path / "INCAR").write_text("ENCUT = 600\n")
    a.add()
    b = Repository(spark, str(tmp_path))
    reads = a._read

    def overtaken():
        version, state = reads()
        if overtaken.once:
            overtaken.once = False
            overtaken.by = b.commit("two")
        return version, state

    overtaken.once = True
    monkeypatch.setattr(a, "_read", overtaken)
    with pytest.raises(RepositoryError, match="another writer"):
        a.commit("three")
    monkeypatch.undo()
    assert a.resolve("HEAD") == overtaken.by and [r["message"] for r in a.log().collect()] == ["two", "one"]
    assert a.diffs().select("commit_hash").distinct().count() == 1 and a.staged().isEmpty()
    before = a._read()
    a.add()

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(a._versions, "publish", dies)
    with pytest.raises(KeyboardInterrupt):
        a.commit("four", allow_empty=True)
    monkeypatch.undo()
    c = Repository(spark, str(tmp_path))
    assert c.resolve("HEAD") == overtaken.by and c.commits().count() == 2 and c.diffs().count() == a.diffs().count()
    assert c._read()[0] == before[0] + 1  # add's version, none of the dead commit
    left = c.vacuum()
    assert any(x.startswith("commits/") for x in left) and any(x.startswith("diffs/") for x in left) and c.vacuum() == []
    assert c.commit("four") and c.resolve("HEAD~2") == first and c.diff("HEAD", "HEAD~2").first()["new_value"] == "600"


def test_many_commits_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repository, "MERGED_FROM", 2)
    r = Repository(spark, str(tmp_path)).init()
    names = [r.commit(f"c{i}", allow_empty=True, timestamp=f"2026-01-01T00:00:0{i}+00:00") for i in range(4)]
    assert [x["commit_hash"] for x in r.log().collect()] == names[::-1] and len(r._state()["tables"]["commits"]) == 2
    assert r.compact() is False


def test_blob_sizes_and_damage(spark, tmp_path):
    r = Repository(spark, str(tmp_path)).init()
    (tmp_path / "a.txt").write_text("x" * 5000)
    r.add(["a.txt"], compress=True)
    r.commit("one")
    h = r.snapshot().first()["blob_hash"]
    size = r.blob_size(h)
    assert size["size_bytes"] == 5000 and size["codec"] == "gzip" and size["stored_bytes"] == r.stored_size() < 200
    assert r.read_blob(h) == b"x" * 5000 and r.blob_exists(h) and not r.blob_exists("f" * 64)
    with pytest.raises(BlobNotFoundError):
        r.blob_size("f" * 64)
    entry = r._state()["tables"]["blobs"][0]
    at = f"{r.store}/blobs/tx={entry['tx']}/shard={h[:2]}"
    spark.read.parquet(at).withColumn("content", F.lit(b"other")).withColumn("codec", F.lit("none")).write.mode("overwrite").parquet(f"{tmp_path}-other")
    for n in os.listdir(at):
        os.unlink(f"{at}/{n}")
    for n in os.listdir(f"{tmp_path}-other"):
        os.rename(f"{tmp_path}-other/{n}", f"{at}/{n}")
    spark.catalog.clearCache()
    with pytest.raises(BlobCorruptedError):
        r.read_blob(h)
    assert [x["status"] for x in r.reproduce("HEAD", f"{tmp_path}/out").collect()] == ["mismatch"]


def test_tree(spark, tmp_path, monkeypatch):
    names = ["a.txt", ".hidden", "x/b.txt", "x/_y/c.txt", "x/_y/z/w/d e+f%.txt", ".store/no", "q/.store/yes"]
    for n in names:
        (tmp_path / "in" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / n).write_bytes(n.encode())
    root = f"file://{tmp_path}/in"
    for listed in (1, 3, 256):  # wherever the driver's listing ends, tasks walk the rest
        monkeypatch.setattr(tree, "LISTED", listed)
        rows = tree.read(spark, root, skip=[".store"]).collect()
        assert sorted((r["path"], bytes(r["content"]), r["size_bytes"]) for r in rows) == sorted((n, n.encode(), len(n)) for n in names if n != ".store/no")
    monkeypatch.setattr(tree, "BATCH_BYTES", 10)
    assert tree.TreeReader({"path": root}).partitions() and sum(b.num_rows for p in tree.TreeReader({"path": root}).partitions() for b in tree.TreeReader({"path": root}).read(p)) == len(names)
    odd = [("ok/deep/file", b"1"), ("gone", None), ("../evil", b"x"), ("ok/deep/file/under", b"y"), ("", b"z")]
    df = spark.createDataFrame(odd, "path string, content binary").coalesce(1)
    told = {r["path"]: (r["status"], bool(r["error"])) for r in tree.write(df, f"file://{tmp_path}/out", f"file://{tmp_path}/report").collect()}
    assert told == {"ok/deep/file": ("written", False), "gone": ("missing", False), "../evil": ("failed", True), "ok/deep/file/under": ("failed", True), "": ("failed", True)}
    assert [r["path"] for r in tree.read(spark, f"{tmp_path}/out", contents=False).collect()] == ["ok/deep/file"] and not (tmp_path / "evil").exists()


def test_reproduce_tells_of_missing_blobs(spark, tmp_path):
    r = Repository(spark, f"file://{tmp_path}/w")
    (tmp_path / "w" / "d").mkdir(parents=True)
    (tmp_path / "w" / "d" / "a").write_text("a")
    (tmp_path / "w" / "b").write_text("b")
    r.init().add()
    r.commit("one")
    version, state = r._read()
    gone = r.snapshot().where("path = 'b'").first()["blob_hash"]
    entry = state["tables"]["blobs"][0]
    entry["shards"] = [s for s in entry["shards"] if s != gone[:2]]
    r._versions.publish(version, state)
    for verify in (True, False):
        got = {x["path"]: x["status"] for x in r.reproduce("HEAD", f"file://{tmp_path}/out{verify}", verify=verify).collect()}
        assert got["b"] == "missing" and got["d/a"] == ("ok" if verify else "written")
