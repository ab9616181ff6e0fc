"""Stages and operators on odd tables, measured accuracy, and recall of planted pairs."""

import math
import os
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from calcstrata.llm import decontaminate, langid, packing, quality, simhash, urls

SF = "/root/testdata/sf0.01"
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
MORE = KINDS + ", stats string, key string, row string, `group` string, text_hash string, component_id string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, "an item of the benchmark that nobody has copied so far at all"), (None, "x"), (1, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(0, "plain words that say very little about anything in particular"), (1, "other words that say nothing"), (1, "other words that say nothing"), (1, "the same id with another text of its own"), (2, None), (3, ""), (None, "a row without an id"), (None, None), (4, LONG), (5, " \t\n")]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, None, None, None, "a", "b", "c", "d", "e", "f") for i, t in rows], MORE)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_tables(spark, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd(spark)
    got = stage(spark, docs, tables)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert stage(spark, docs.limit(0), tables).count() == 0
    if name == "SimHash near-dedup":
        assert sorted(i for i in ids if i is not None) == [0, 1, 1, 2, 4] and ids.count(None) == 2
    elif name == "suffix-array dedup":
        assert sorted(i for i in ids if i is not None) == [0, 1, 1, 1, 2, 3, 4, 5] and ids.count(None) == 2
    elif name == "benchmark decontamination":
        assert len(ids) == len(ODD)


def test_packing_on_odd_tables(spark, tables):
    pytest.importorskip("public_tokenizers")
    stage = dict(corpus_pipeline.STAGES)["packing"]
    got = stage(spark, odd(spark), tables).collect()
    assert sum(r["start"] == 0 for r in got) == len(ODD) and stage(spark, odd(spark).limit(0), tables).count() == 0


def test_packing_fills_its_sequences(spark):
    """Within one per cent of the fewest sequences that the tokens need."""
    pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 5000, 300))], "doc_id bigint, text string")
    from calcstrata.llm.queries import vocabulary

    rows = packing.pack(spark, docs, vocabulary("word_bpe_49k.json")).collect()
    total, used = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert math.ceil(total / 2048) <= used <= 1.01 * math.ceil(total / 2048) + 1


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    words = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    rows = [(0, words[0]), (1, words[0]), (1, words[1]), (2, words[1]), (3, words[2]), (3, words[2])]
    kept = simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], words.index(r["text"])) for r in kept) == [(0, 0), (1, 1), (3, 2)]


def planted(rng, similarity, pairs):
    """Pairs of texts of 200 to 400 words whose five-word sets have about this Jaccard similarity."""
    out = []
    for _ in range(pairs):
        n = int(rng.integers(200, 400))
        a = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        b, edits = list(a), round((n - 4) * (1 - similarity) / (1 + similarity) / 5)
        for k in rng.choice(n // 12 - 1, edits, replace=False):
            b[12 * int(k) + 6] = f"z{rng.integers(10**9)}"
        out.append((" ".join(a), " ".join(b)))
    return out


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_planted_pairs(spark):
    """Every pair at 0.8 or more is one document, every pair below stays two, at 0.7, 0.8 and 0.9."""
    rng = np.random.default_rng(11)
    pairs = [p for s in (0.7, 0.78, 0.8, 0.82, 0.9) for p in planted(rng, s, 150)]
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    similar = [jaccard(*p) >= 0.8 for p in pairs]
    caught = [2 * i + 1 not in kept for i in range(len(pairs))]
    assert all(2 * i in kept for i in range(len(pairs)))
    assert sum(c for c, s in zip(caught, similar, strict=True) if s) >= 0.99 * sum(similar)
    assert not any(c for c, s in zip(caught, similar, strict=True) if not s)


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    """Buckets over the limit are dealt out again by pivot distances, and what stays crowded is one group."""
    own = simhash.proposed_links
    monkeypatch.setattr(simhash, "proposed_links", lambda *a: own(*a, bucket_rows=4))
    rng = np.random.default_rng(4)
    line = " ".join(f"c{i}" for i in range(150))
    texts = [line + " " + " ".join(f"q{x}" for x in rng.integers(0, 10**9, 60)) for _ in range(40)]
    texts += [t + " end" for t in texts[:20]]
    base = [f"w{x}" for x in rng.integers(0, 10**9, 300)]
    for _ in range(30):
        t = list(base)
        t[int(rng.integers(0, 300))] = "other"
        texts.append(" ".join(t))
    kept = {r["doc_id"] for r in simhash.keep_one(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert kept == {*range(40), 60}


UNITS = "|".join(sorted(decontaminate.UNITS, key=len, reverse=True))


N, U, M = decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME


def brute_templates(text):
    out = re.sub(r"[0-9]+(?:[.,][0-9]+)*", f" {N} ", text)
    out = re.sub(rf"(?<={N} )( ?)(?i:{UNITS})(?![a-zA-Z0-9])", f" {U} ", out)
    out = re.sub(r"[A-Z][a-z]+", f" {M} ", out)
    return [x for x in re.split(rf"[^a-z0-9{N}{U}{M}]+", out.lower()) if x]


def brute_leaks(items, docs, size=8, plain=5, windows=4):
    """Pairs by comparing every window with every window; names are checked by hand in other tests."""
    out = set()
    for j, item in enumerate(items):
        for i, doc in enumerate(docs):
            for how, least in ((brute_templates, plain), (lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if x], 0)):
                a, b = how(item), how(doc)
                k = min(size, len(a)) if not least else size
                own = {n: tuple(a[n : n + k]) for n in range(len(a) - k + 1)} if k else {}
                own = {n: w for n, w in own.items() if sum(x not in (N, U, M) for x in w) >= least}
                shifts = {}
                for m in range(len(b) - k + 1):
                    for n, w in own.items():
                        if tuple(b[m : m + k]) == w:
                            shifts.setdefault(m - n, set()).add(n)
                if own and any(len(x) >= min(windows, len(own)) for x in shifts.values()):
                    out.add((i, j))
    return out


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefg"), int(rng.integers(2, 6))))
    sentence = lambda n: " ".join(f"{rng.integers(1, 99)} kg" if rng.random() < 0.1 else word() for _ in range(n))
    items = [sentence(int(n)) for n in rng.integers(3, 40, 25)]
    docs = []
    for _ in range(120):
        j = int(rng.integers(0, len(items)))
        some = items[j].split()
        a = int(rng.integers(0, len(some)))
        cut = " ".join(some[a : a + int(rng.integers(1, 25))]) if rng.random() < 0.7 else items[j]
        cut = re.sub(r"[0-9]+", lambda m: str(rng.integers(1, 99)), cut) if rng.random() < 0.5 else cut
        docs.append(f"{sentence(10)} {cut}, {sentence(10)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(docs)], "doc_id bigint, text string, hash string, words string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark, table, bench).collect()}
    assert got == brute_leaks(items, docs) and len(got) > 20


def test_decontamination_of_very_long_texts(spark):
    item = "seven quiet farmers walk along the narrow river and count every tree until the sun goes down"
    rows = [(0, LONG + " " + item + " " + LONG), (1, LONG)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark, table, bench).collect()] == [(0, 0)]


def test_names_that_open_a_sentence(spark):
    item = "There is a shop. Anna sells twelve boxes of green apples. Anna buys seven baskets of ripe pears on the way home"
    rows = [(0, item.replace("Anna", "Maria"))]
    found = decontaminate.find_leaks(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(0, item)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["n_changed"] > 0) for r in found] == [(0, True)]


def test_trees_on_held_out_urls(spark):
    """Labels of rules that follow suffix and length; the urls no rule fits follow the same law."""
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    rows = []
    for i in range(4000):
        bad = rng.random() < 0.5
        host = f"{word(6)}.{'net' if bad else 'com'}"
        rows.append((i, f"https://{host}/{'es' if bad else 'en'}/{word(40 if bad else 5)}{rng.integers(10**9) if bad else ''}", 1, 1, 1, 1))
    other = [(10_000 + i, f"https://{word(6)}.org/{word(40 if i % 2 else 5)}{rng.integers(10**9) if i % 2 else ''}", 1, 1, 1, 1) for i in range(1000)]
    long = [(20_000, "https://a.org/" + "x" * 200_000 + "?" + "&".join("a=1" for _ in range(10_000)), 1, 1, 1, 1)]
    df = spark.createDataFrame(rows + other + long, "page_id bigint, url string, path int, rule int, verdict int, score int")
    got = {r["page_id"]: r for r in urls.judge(spark, df).collect()}
    assert len(got) == len(rows) + len(other) + 1
    right = [(got[i]["verdict"] == "block") == bool(i % 2) for i in range(10_000, 11_000)]
    assert np.mean(right) > 0.95 and got[20_000]["verdict"] == "block"


def test_tree_columns_equal_the_trees(spark):
    """The CASE expressions against a walk through the trees in Python."""
    rng = np.random.default_rng(9)
    names = list(urls.STEPS)
    cells = [(tuple(int(rng.integers(0, len(urls.STEPS[n]) + 1)) for n in names), 10.0, float(rng.integers(0, 11))) for _ in range(300)]
    base, trees = urls.boost(sorted(cells), names)
    df = spark.createDataFrame([tuple(s) for s, _, _ in cells], ", ".join(f"_{n} int" for n in names))
    total = sum((urls.tree_column(t) for t in trees[1:]), urls.tree_column(trees[0]))
    got = [r["v"] for r in df.select(total.alias("v")).collect()]
    want = [sum(urls._value(t, dict(zip(names, s, strict=True))) for t in trees) for s, _, _ in cells]
    assert got == pytest.approx(want) and len(trees) > 1 and math.isfinite(base)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r for r in docs.collect()}
    got = [r for r in langid.identify(spark, docs).collect() if r["held_out"] and truth[r["doc_id"]]["lang"] is not None and r["lang_pred"] != "und"]
    assert len(got) > 100 and np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in got]) > 0.98
    table = spark.read.parquet(f"{SF}/labels.parquet")
    labels = {r["doc_id"]: r["quality"] for r in table.where("quality is not null").collect()}
    rated = [(r["score"], labels[r["doc_id"]]) for r in quality.rate(spark, docs, table).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in rated if y == 1], [s for s, y in rated if y == 0]
    assert good and bad and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95


def test_samples_are_bounded_at_any_size(spark):
    """The rate is a share of 64-bit hashes, so it never rounds to nothing; copies of one row count once."""
    rows = spark.createDataFrame([(i % 3000, "a") for i in range(6000)], "key bigint, text string")
    from calcstrata.llm.common import sampled

    assert 150 < sampled(rows, 300, "key", "text").count() < 600 and sampled(rows, 5000, "key", "text").count() == 3000
    assert int(20_000 / 1e13 * 2.0**64) > 0


def test_ridge_against_a_direct_solution(spark):
    """Partition-summed normal equations against numpy on all rows at once."""
    rng = np.random.default_rng(1)
    k = len(quality.STATISTICS)
    x = rng.normal(size=(400, k))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in range(400)])
    df = spark.createDataFrame([(a.tolist(), float(b), bool(h)) for a, b, h in zip(x, y, held, strict=True)], "stats array<double>, y double, held boolean")
    model = quality.fit(df.repartition(5))
    z = model.features(x[~held])
    penalty = np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + penalty, z.T @ y[~held]), abs=1e-6)
    assert np.corrcoef(model.score(x), y)[0, 1] > 0.7 and (np.diff(model.levels) >= 0).all()


def test_no_text_is_lost_under_a_shared_id(spark):
    words = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    rows = [(1, words[0]), (1, words[1]), (5, words[0]), (6, words[1]), (7, words[2]), (None, words[0])]
    kept = simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), words.index(r["text"])) for r in kept) == [("1", 0), ("1", 1), ("7", 2), ("None", 0)]


def test_leaks_go_by_text_and_short_items_stand_alone(spark, tmp_path):
    item = "an item of the benchmark that somebody has copied into a text of their own"
    bench = spark.createDataFrame([(0, item), (1, "Paris"), (2, "42"), (3, "the capital is Paris")], "item_id bigint, text string")
    rows = [(1, f"we found {item} there"), (1, "a clean text under the same id"), (2, "we flew to Paris last year"), (3, "room 42 is upstairs"), (4, "42."), (5, "paris"), (6, "so the capital is Paris, they say")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = decontaminate.without_leaks(spark, docs, bench).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [rows[1], rows[2], rows[3]]
