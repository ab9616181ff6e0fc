"""The stages on planted documents, each against a brute-force version."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from calcstrata.llm import common, packing, tokens

RNG = np.random.default_rng(12)


def prose(words):
    syllables = ["ta", "ri", "mo", "ne", "lu", "ka", "so", "vi", "pe", "do", "an", "er", "is", "ul"]
    out = []
    for i in range(words):
        w = "".join(RNG.choice(syllables, int(RNG.integers(2, 5))))
        out.append(w.capitalize() if i % 11 == 0 else w + "." if i % 11 == 10 else w)
    return " ".join(out)


def junk(words):
    return " ".join(w.upper() + "!!" for w in prose(words).split())


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    texts = [prose(120) for _ in range(60)]
    bench = prose(30)
    passage = prose(25)
    texts += [texts[3], texts[4].replace(".", ".", 1) + " end", texts[5].rsplit(" ", 2)[0], prose(60) + " " + bench + " " + prose(60), prose(60) + " " + passage + " " + prose(60), prose(60) + " " + passage + " " + prose(60)]
    texts += [junk(100) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(len(texts), None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i < 66), 0) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), {r[0]: r[1] for r in rows}


def test_stages(spark, tables):
    sf, texts = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = corpus_pipeline.stored(spark, docs, "test")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = kept["quality classifier"]
    assert set(range(66)) <= set(good) and not set(range(66, 86)) & set(good)
    clear = {i: shingles(t or "") for i, t in good.items()}
    gone = {j for j in clear for i in clear if i < j and len(clear[i] & clear[j]) >= 0.8 * len(clear[i] | clear[j])}
    one = kept["SimHash near-dedup"]
    assert set(good) - set(one) == gone and {60, 61, 62} <= gone
    bare = kept["suffix-array dedup"]
    grams = lambda t: {t.encode()[k : k + 50] for k in range(len(t.encode()) - 49)}
    for i, t in one.items():
        before = set().union(*(grams(one[j] or "") for j in one if j < i))
        data = (t or "").encode()
        hit = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 49):
            if data[k : k + 50] in before:
                hit[k : k + 50] = True
        left = bytes(b for b, h in zip(data, hit, strict=False) if not h).decode("utf-8", "ignore")
        assert bare.get(i, "") == (left if left.strip() else "")
    assert set(bare) - set(kept["benchmark decontamination"]) == {63}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048
    counts = {}
    for r in rows:
        if r["length"] < 2048:
            counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert len(by) == sum(n for _, n in packing.plan_fills(counts, 2048)) + sum(r["length"] == 2048 for r in rows)


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).columns[-2:] == ["sequence_id", "offset"]


def test_batches_of_long_texts_are_small(spark):
    names = [common.BATCH_BYTES, common.READER_ROWS]
    before = [spark.conf.get(x) for x in names]
    try:
        corpus_pipeline.ready(spark)
        texts = spark.range(600, numPartitions=1).selectExpr("repeat('word ', 2000) as text")

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

        got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 6_000_000 and max(got) <= 1_500_000
    finally:
        for x, value in zip(names, before, strict=True):
            spark.conf.set(x, value)


def test_a_later_stage_drops_the_words_of_packing(monkeypatch):
    monkeypatch.setattr(tokens, "_CACHES", {"vocabulary": object()})
    held = lambda batches: iter([len(tokens._CACHES)])
    assert list(common.then_give_back(held, keep_words=True)(iter(()))) == [1]
    assert list(common.then_give_back(held)(iter(()))) == [0]
