"""Logs line by line over many tasks against the fold of whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from calcstrata.parsers import logs, md


def random_log(rng, kind):
    out = [rng.choice(["LAMMPS (2 Aug 2023)", "  500 atoms", ""])]
    step = 0
    for _ in range(rng.randrange(0, 5)):
        names = ["Step", "Temp", "PotEng", "TotEng"][: rng.randrange(2, 5)]
        if kind == "yaml":
            out += ["---", "keywords: [" + ", ".join(f"'{n}'" for n in names) + ", ]", "data:"]
        else:
            out.append("   " + " ".join(names))
        for _ in range(rng.randrange(0, 12)):
            step += rng.randrange(1, 20)
            cells = [str(step)] + [f"{rng.uniform(-9, 9):.3f}" for _ in names[1:]]
            if rng.random() < 0.1:
                cells = cells[:-1]  # a row of another width ends the table
            if rng.random() < 0.1:
                out.append("")
            if rng.random() < 0.05:
                out.append("WARNING: something")
            out.append("  - [" + ", ".join(cells) + "]" if kind == "yaml" else " ".join(cells))
        if rng.random() < 0.8:
            out.append(rng.choice(["...", "Loop time of 1 on 1 procs"]))
    if rng.random() < 0.3:
        out += ["TotEng   -3.5", "Temp  12.5"]
    if rng.random() < 0.7:
        out.append("Total wall time: 0:00:01")
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return {f"log{i}": random_log(rng, rng.choice(["yaml", "columns"])) for i in range(40)}


def told(df):
    return sorted(map(str, df.select("blob_hash", "path", "kind", "num", "value").collect()))


@pytest.mark.parametrize(("stretch", "group"), [(1, 2), (3, 2), (7, 3), (10_000, 256)])
def test_lines_give_what_texts_give(spark, texts, stretch, group):
    whole = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "blob_hash string, text string")
    # blocks as a cut file has them: the lines of one log in several, each with a count of its own
    rows = [(k, 1000 * (i // 11), i % 11 + 7, x) for k, v in texts.items() for i, x in enumerate(v)]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, "blob_hash string, block bigint, local bigint, line string")
    assert told(logs.parse_lines(lines, stretch, group, block_bytes=700)) == told(md.parse_log(whole))


def test_one_file_over_many_tasks(spark, tmp_path):
    rng = random.Random(9)
    lines = [x for _ in range(60) for x in random_log(rng, "columns")]
    (tmp_path / "log.lammps").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        read = logs.read_lines(spark, f"file://{tmp_path}/log.lammps")
        assert read.select("block").distinct().count() > 5
        got = logs.parse_lines(read, stretch=20, group=4, block_bytes=2048).drop("blob_hash")
        whole = spark.createDataFrame([("x", "\n".join(lines))], "blob_hash string, text string")
        assert sorted(map(str, got.collect())) == sorted(map(str, md.parse_log(whole).drop("blob_hash").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_summaries_may_be_grouped_in_any_way(spark, texts):
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "k string, l array<string>")
    part = lambda a, b: logs.summarized(F.transform(F.slice("l", a, b), md.column_line))
    df = df.select("k", part(1, 9).alias("a"), part(10, 8).alias("b"), part(18, 1000).alias("c"))
    left = logs.combined(logs.combined(F.col("a"), F.col("b")), F.col("c"))
    right = logs.combined(F.col("a"), logs.combined(F.col("b"), F.col("c")))
    start = md.empty_state()
    told = df.select(logs.applied(start, left).alias("x"), logs.applied(start, right).alias("y"), logs.applied(logs.applied(logs.applied(start, F.col("a")), F.col("b")), F.col("c")).alias("z")).collect()
    assert all(r["x"] == r["y"] == r["z"] for r in told)
