"""Types and checks of packages, tables of prefixes, and segments of snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from calcstrata import plugins
from calcstrata.operators import files, snapshots
from calcstrata.operators.validate import Rule
from calcstrata.parsers import registry, rules
from calcstrata.plans import stores
from calcstrata.plugins import CheckPlugin, Manager, ValidatorPlugin
from calcstrata.schemas import RepositoryError
from calcstrata.sources.repository import Repository


class Point:
    def __init__(self, name, load):
        self.name, self.load = name, load


def test_a_package_adds_a_type_to_the_repository(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plugins, "entry_points", lambda group: [Point("props", lambda: stores.Props)] if group == plugins.GROUPS["parsers"] else [])
    (tmp_path / "a.props").write_text("energy: 1.0\nstate: old\nother: 1\n")
    r = Repository(spark, str(tmp_path)).init()
    try:
        r.add()
        r.commit("one")
        (tmp_path / "a.props").write_text("energy: 1.001\nstate: new\nother: 2\n")
        assert [(x["path"], x["old_value"], x["significance"]) for x in r.diff().collect()] == [("state", '"old"', "major")]
        (tmp_path / "a.props").write_text("state: old\nenergy: 1.002\n")
        r.add()
        r.commit("two")
        assert {x["path"]: x["change"] for x in r.changed_files("HEAD", "HEAD~1").collect()} == {"a.props": "cosmetic"}
        assert [p["name"] for p in r.manager().parsers()] == ["PROPS"]
    finally:
        r.manager().unregister("PROPS")
    assert "PROPS" not in registry.PARSERS and "PROPS" not in rules.ORDER and "PROPS" not in files.TYPE_RULES
    with pytest.raises(ValueError, match="built-in"):
        m, p = Manager(), stores.Props()
        p.name = "INCAR"
        m.register(p)


def test_only_directories_that_raise_fail(spark):
    class Column_(ValidatorPlugin):
        name = "column"

        def applies(self):
            return F.array_contains("names", "INCAR")

        def rules(self):
            return [Rule("x", "error", F.when(F.col("INCAR").contains("boom"), F.raise_error(F.lit("at run time")).cast("boolean")).otherwise(F.col("INCAR").contains("bad")), "bad")]

    class Python(CheckPlugin):
        name = "python"

        def applies(self):
            return F.array_contains("names", "INCAR")

        def check(self, texts):
            assert texts["POSCAR"] is None
            if "boom" in texts["INCAR"]:
                raise RuntimeError("of its own")
            return (["bad"] if "bad" in texts["INCAR"] else []), ["warned"]

    m = Manager()
    m.plugins = {}
    m.register(Column_())
    m.register(Python())
    rows = [(f"d{i}/INCAR", "boom" if i == 3 else "bad" if i == 5 else "ok") for i in range(12)]
    got = {(r["rule"], r["dir"]): (r["passed"], r["message"]) for r in m.run(spark.createDataFrame(rows, "path string, text string"), isolate=True).collect()}
    for name in ("column", "python"):
        assert {d for (n, d), (ok, _) in got.items() if n == name and not ok} == {"d3", "d5"} and sum(n == name for n, _ in got) == 12
        assert got[name, "d3"][1].startswith("the validator failed") and got[name, "d5"][1] == "1 problem(s)"


def test_staging_names_a_check_that_raises(spark, tmp_path, monkeypatch):
    class Raises(CheckPlugin):
        name = "raises"

        def applies(self):
            return F.array_contains("names", "INCAR")

        def check(self, texts):
            raise RuntimeError("not today")

    monkeypatch.setattr(plugins, "entry_points", lambda group: [Point("raises", lambda: Raises)] if group == plugins.GROUPS["validators"] else [])
    (tmp_path / "INCAR").write_text("ENCUT = 500\n")
    r = Repository(spark, str(tmp_path)).init()
    with pytest.raises(RepositoryError, match="raises: RuntimeError: not today"):
        r.add()
    assert r.staged().isEmpty()
    r.set_validator("raises", False)
    assert [x["status"] for x in r.add().collect()] == ["added"]


@pytest.mark.parametrize("few", [10, 0])
def test_prefixes(spark, monkeypatch, few):
    monkeypatch.setattr(snapshots, "BROADCAST_ROWS", few)
    hashes = [c * 63 + d for c in "ab" for d in "01"] + ["c" * 64, "c" * 64]
    commits = spark.createDataFrame([(h,) for h in hashes] + [(None,)], "commit_hash string")
    asked = ["a", "A" * 64, "a" * 63 + "0", "c", "CCC", "d", "", "xyz", "c" * 65, None, "c"]
    got = {r["prefix"]: (r["status"], r["commit_hash"]) for r in snapshots.resolve_prefixes(spark.createDataFrame([(p,) for p in asked], "prefix string"), commits).collect()}
    assert got == {
        "a": ("ambiguous", None), "A" * 64: ("unknown", None), "a" * 63 + "0": ("ok", "a" * 63 + "0"), "c": ("ok", "c" * 64), "CCC": ("ok", "c" * 64), "d": ("unknown", None),
        "": ("malformed", None), "xyz": ("malformed", None), "c" * 65: ("malformed", None), None: ("malformed", None),
    }
    assert {r["status"] for r in snapshots.resolve_prefixes(spark.createDataFrame([("?",)], "prefix string"), commits).collect()} == {"malformed"}


def test_index_is_sorted(spark, tmp_path):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("commit_hash"))
    snapshots.write_index(df, f"file://{tmp_path}/i")
    back = spark.read.parquet(f"file://{tmp_path}/i")
    ranges = sorted((r["a"], r["b"]) for r in back.groupBy(F.input_file_name()).agg(F.min("commit_hash").alias("a"), F.max("commit_hash").alias("b")).collect())
    assert len(ranges) > 1 and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:], strict=False)) and back.count() == 500


@pytest.mark.parametrize("every", [1, 4, 64])
def test_any_commit_from_its_segment(spark, every):
    rng = random.Random(every)
    lengths = {"long": 150, "one": 1, "short": 9}
    changes = [(c, i, f"p{rng.randrange(6)}", f"{rng.random()}") for c, n in lengths.items() for i in range(n) for _ in range(rng.randrange(0, 3))]
    commits = [(c, i) for c, n in lengths.items() for i in range(n)]
    want, stored_full = set(), 0
    for c, i in commits:
        state = {}
        for k, at, p, v in sorted(changes, key=lambda x: (x[1], x[3])):
            if k == c and at <= i:
                state[p] = v
        want |= {(c, i, p, v) for p, v in state.items()}
        stored_full += len(state)
    changes = spark.createDataFrame(changes, "repo string, at bigint, path string, blob string")
    commits = spark.createDataFrame(commits, "repo string, at bigint")
    table = snapshots.segments(changes, commits, "repo", "at", "path", every)
    got = snapshots.snapshot_at(table, commits, "repo", "at", every).select("repo", "at", "path", "blob").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert (table.count() == stored_full) if every == 1 else (table.count() < stored_full / 2)
    one = snapshots.snapshot_at(table.where("segment = 0"), commits.where("at = 0"), "repo", "at", every)
    assert {tuple(r) for r in one.select("repo", "at", "path", "blob").collect()} == {w for w in want if w[1] == 0}
