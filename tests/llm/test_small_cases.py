"""Odd inputs and brute-force comparisons on small tables."""

import hashlib
import os
import zlib

import numpy as np
import pytest
import xxhash

from calcstrata.llm import dac, decontaminate, gif, hpylm, langid, packing, quality, simhash, suffixes, urls

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, stats string, key string, component string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    (0, "the quick brown fox jumps over the lazy dog " * 6, "en"),
    (1, "the quick brown fox jumps over the lazy dog " * 6, "en"),
    (2, "", "en"),
    (3, None, None),
    (4, LONG, "en"),
    (5, LONG + " tail", "en"),
    (6, "!!! ... 123", "fr"),
    (7, "le chat noir dort sur la chaise pendant que le chien mange " * 4, "fr"),
    (7, "le chat noir dort sur la chaise pendant que le chien mange " * 4, "fr"),
    (8, "é" * 30 + "abc" + "é" * 30, None),
    (9, "x" + "é" * 30 + "abd" + "é" * 30, "fr"),
    (None, "the quick brown fox jumps over the lazy dog " * 6, "en"),
    (11, "one", "en"),
    (12, "a\tb\nc  d 　 e", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "s", 1, "a", "b", "c") for i, t, g in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def path(name):
    P = pytest.importorskip("public_tokenizers")
    return str(P.path(name))


def words(text):
    return (text or "").encode().lower().split()


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(spark, docs).collect()
    assert len(got) == len(TEXTS)
    prints = {}
    for i, t, _ in TEXTS:
        w = words(t)
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert all(r["fingerprint"] == f"{prints[r['doc_id']]:016x}" for r in got)
    least = {}
    for i in (x for x in prints if x is not None):
        reach, grown = {i}, True
        while grown:
            more = {j for j in prints if j is not None and j not in reach and any(bin(prints[j] ^ prints[k]).count("1") <= 3 for k in reach)}
            reach, grown = reach | more, bool(more)
        least[i] = min(reach)
    assert all(r["component_id"] == least.get(r["doc_id"]) for r in got)
    assert simhash.near_duplicates(spark, empty).count() == 0


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
    df = spark.createDataFrame([(i, int(np.int64(p))) for i, p in enumerate(points.view(np.int64))], "rep bigint, f0 bigint")
    for rows in (4096, 3):  # crowded buckets are cut into chunks
        found = simhash.links(spark, df, 1, 3, simhash.block_masks(1, 5, 3), bucket_rows=rows).collect()
        i, j = np.where(np.triu(np.bitwise_count(points[:, None] ^ points[None]) <= 3, 1))
        want = simhash.forest(i, j)
        got = simhash.forest(np.array([r["u"] for r in found]), np.array([r["v"] for r in found]))
        assert dict(zip(*map(np.ndarray.tolist, want), strict=True)) == dict(zip(*map(np.ndarray.tolist, got), strict=True))


def test_keep_one(spark, docs):
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids.count(0) == 1 and 1 not in ids and 5 not in ids and ids.count(7) == 1 and None in ids and {4, 6, 11, 12} <= set(ids)


def edited(words, n, rng):
    """The words with n runs of five apart from each other changed, which changes five shingles each."""
    out = list(words)
    for k in rng.choice(len(words) // 12 - 1, n, replace=False):
        out[12 * int(k) + 6] = f"z{rng.integers(10**9)}"
    return out


@pytest.mark.parametrize("group_rows", [512, 8])
def test_keep_one_is_exact(spark, monkeypatch, group_rows):
    """Pairs just above and just below the similarity, chains, and a repeated line that outweighs the rest."""
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (group_rows,))
    rng = np.random.default_rng(5)
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 300)]
        texts += [" ".join(words), " ".join(edited(words, 6 if k % 2 else 9, rng))]
    words = [f"w{x}" for x in rng.integers(0, 10**9, 300)]
    for _ in range(40):
        words = edited(words, 5, rng)
        texts.append(" ".join(words))
    texts += ["one line that comes again " * 300 + " ".join(f"q{i}x{x}" for x in range(100)) for i in range(2)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    best = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if best[i] != best[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((best[i], best[j]))
                best = [a if x == b else x for x in best]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in simhash.keep_one(spark, table).collect()} == set(best)


def test_hpylm(spark, docs, empty):
    got = hpylm.score_documents(spark, docs).collect()
    assert len(got) == len(TEXTS) and all(r["score"] < 0 for r in got)
    counts, total = {}, 0
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    for i, t, _ in TEXTS:
        if not held(i):
            for w in [*words(t), b"\n"]:
                counts[w] = counts.get(w, 0) + 1
                total += 1
    for i, t, _ in TEXTS:
        r = next(r for r in got if r["doc_id"] == i)
        w = [*words(t), b"\n"]
        base = sum(np.log10((counts.get(x, 0) + 1) / (total + len(counts) + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), total) and r["base_score"] == pytest.approx(base)
        assert r["held_out"] == held(i)
    assert hpylm.score_documents(spark, empty).count() == 0


def test_predictions_sum_to_one():
    words_, contexts = np.array([0, 0, 1, 2, 2, 2]), np.array([1, 2, 1, 1, 2, 3])
    customers = np.array([3, 40, 1, 2, 7, 100])
    cell = hpylm.Cell(suffixes._squeeze(words_.astype(np.uint32), contexts.astype(np.uint16), customers.astype(np.uint32), np.arange(3, dtype=np.uint64)))
    totals = lambda: hpylm.Totals(np.bincount(cell.context, cell.tables, hpylm.CONTEXTS), np.bincount(cell.context, cell.customers, hpylm.CONTEXTS), float(cell.root_tables.sum()), 3.0, (0.6, 0.4))
    for k in range(3):
        cell.sweep(totals(), k)
        assert (cell.tables <= cell.customers).all() and (cell.tables >= 1).all()
        now = totals()
        root = now.root(cell.up, cell.root_tables)
        unknown = now.root(np.zeros(1), np.zeros(1))[0]
        assert root.sum() + unknown == pytest.approx(1)
        for c in (1, 2, 3, 9):
            own = {int(w): (int(n), int(t)) for w, x, n, t in zip(cell.word, cell.context, cell.customers, cell.tables, strict=True) if x == c}
            p = sum(now.predict(np.array([c]), np.array([own.get(w, (0, 0))[0]]), np.array([own.get(w, (0, 0))[1]]), root[[w]])[0] for w in range(3))
            assert p + now.predict(np.array([c]), np.zeros(1), np.zeros(1), np.array([unknown]))[0] == pytest.approx(1)


@pytest.mark.parametrize("n", [3, 40])
def test_tables_follow_the_exact_posterior(n):
    d = 0.5
    logs = hpylm.stirling(d, 64)
    assert np.exp(logs[3, 1:4]) == pytest.approx([(1 - d) * (2 - d), (1 - d) + (2 - 2 * d), 1])
    t = np.arange(1, n + 1)
    p = np.exp(logs[n, 1 : n + 1] + t * np.log(0.2) + np.cumsum(np.log([1 + d * (4 + j) for j in range(n)])))
    draws = hpylm.Draws(np.arange(50_000, dtype=np.uint64), 0)
    drawn = hpylm.resample(np.full(50_000, n), np.full(50_000, 4.0), np.full(50_000, 0.2), d, logs, draws)
    assert np.bincount(drawn, minlength=n + 1)[1:] / 50_000 == pytest.approx(p / p.sum(), abs=0.01)


def test_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 300) % 200) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n, k in (("2", 1), ("7", 5)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted((r["doc_id"], round(r["score"], 6)) for r in hpylm.score_documents(spark, df.repartition(k)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def brute_hpy(texts, held, sweeps):
    """A seat-by-seat Gibbs sampler of the same two restaurants, customer by customer; averaged log10 of each text."""
    import random

    rng = random.Random(5)
    pairs = lambda t: list(zip([None, *words(t)], [*words(t), b"\n"], strict=True))
    train = [x for i, t in texts for x in pairs(t) if not held(i)]
    counts = {}
    for x in train:
        counts[x] = counts.get(x, 0) + 1
    vocabulary = {w for _, w in train}
    d = hpylm._discount(sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values()))
    up = {w: sum(1 for x in counts if x[1] == w) for w in vocabulary}
    e = hpylm._discount(sum(v == 1 for v in up.values()), sum(v == 2 for v in up.values()))
    seats, root, where = {x: [] for x in counts}, {w: [] for w in vocabulary}, []

    def p_root(w):
        own = root.get(w, [])
        total, tables = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(own) - e * len(own) + (1 + e * tables) / (len(vocabulary) + 1)) / (1 + total)

    def p_context(x):
        own = seats.get(x, [])
        c = [v for k, v in seats.items() if k[0] == x[0]]
        return (sum(own) - d * len(own) + (1 + d * sum(map(len, c))) * p_root(x[1])) / (1 + sum(map(sum, c)))

    def sit(tables, discount, new):
        weights = [n - discount for n in tables] + [new]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return k == len(tables) - 1 and tables[k] == 1

    def add(x):
        tables = sum(len(v) for k, v in seats.items() if k[0] == x[0])
        if sit(seats[x], d, (1 + d * tables) * p_root(x[1])):
            every = sum(map(len, root.values()))
            sit(root[x[1]], e, (1 + e * every) / (len(vocabulary) + 1))

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    for x in train:
        add(x)
    sums = {}
    for n in range(sweeps):
        for x in train:
            if leave(seats[x]):
                leave(root[x[1]])
            add(x)
        if n >= sweeps // 4:
            for i, t in texts:
                for k, x in enumerate(pairs(t)):
                    sums[i, k] = sums.get((i, k), 0) + p_context(x)
    n = sweeps - sweeps // 4
    return {i: sum(np.log10(v / n) for (j, _), v in sums.items() if j == i) for i, _ in texts}


def test_hpylm_against_a_seat_by_seat_sampler(spark):
    rng = np.random.default_rng(2)
    texts = [(i, " ".join("abcdef"[int(x) % 6] for x in rng.zipf(1.6, 12))) for i in range(14)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = brute_hpy(texts, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, 120)
    got = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in hpylm.score_documents(spark, df, sweeps=12, burn_in=3).collect()}
    assert all(abs(got[i][0] - want[i]) / got[i][1] < 0.03 for i, _ in texts)
    assert np.mean([got[i][0] - want[i] for i, _ in texts]) == pytest.approx(0, abs=0.15)


def test_packing(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    file = path("word_bpe_49k.json")
    tk = tokenizers.Tokenizer.from_file(file)
    rows = packing.pack(spark, docs, file, keep_ids=True).collect()
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in TEXTS}
    seen, total = {}, 0
    for r in rows:
        want = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
        assert r["ids"] == want and r["ids_crc32"] == zlib.crc32(want) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(len(ids[i]) for i, _, _ in TEXTS)
    for pieces in seen.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark, empty, file).count() == 0


def test_closest_fill_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(50):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 30, 6), rng.integers(1, 4, 6), strict=True)}
        room = int(rng.integers(1, 80))
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        fill = packing.closest_fill(counts, room)
        assert sum(x * k for x, k in fill.items()) == max(s for s in sums if s <= room) and all(k <= counts[x] for x, k in fill.items())


def test_gif(spark, docs, empty):
    for data in (b"", b"a", b"ab" * 9000, os.urandom(30_000), bytes(range(256)) * 30):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    got = gif.store_texts(spark, docs).collect()
    assert len(got) == len(TEXTS)
    for i, t, _ in TEXTS:
        raw = (t or "").encode()
        pad = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = next(r for r in got if r["doc_id"] == i)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        n = len(pad) // 192
        assert len(r["frames"]) == -(-n // 192) and r["feature"].startswith(f"{len(r['frames'])}x192x{min(n, 192)}@{10 * len(r['frames'])}:")
        grey = np.bincount(np.frombuffer(pad, np.uint8) // 64, minlength=4)
        if n <= 192:
            assert r["feature"].endswith(":" + ",".join(map(str, grey)))
    assert gif.store_texts(spark, empty).count() == 0


def test_gif_damage(spark):
    """A code size beyond eight bits, a canvas and a frame of any size the header says, and cut streams are errors of their row."""
    data = bytearray(gif.encode_gif([np.zeros((4, 4), np.uint8)]))
    at = data.index(b"\x2c\0\0\0\0\x04\0") + 10
    wide, huge, frame = bytearray(data), bytearray(data), bytearray(data)
    wide[at] = 12
    huge[6:10] = b"\xff\xff\xff\xff"
    frame[at - 5 : at - 1] = b"\xff\xff\xff\xff"
    media = [data, wide, huge, frame, *(data[:k] for k in range(0, len(data), 97))]
    rows = gif.frame_table(spark.createDataFrame(list(enumerate(media)), "doc_id int, media binary")).collect()
    assert {r["doc_id"] for r in rows if r["error"] is None} == {0} and len(rows) == len(media)


def test_gif_rules(spark):
    a, b = np.zeros((4, 4), np.uint8), np.full((4, 4), 9, np.uint8)
    b[0] = 7
    frames = [gif.Frame(0, 0, a, gif.GREY, 5), gif.Frame(0, 0, b, gif.GREY, 5, 2, 7), gif.Frame(1, 1, a[:2, :2], gif.GREY, 5, 3)]
    shown = [p.copy() for _, p in gif.canvases(4, 4, frames)]
    assert (shown[1][0, :, 0] == 0).all() and (shown[1][1:, :, 0] == 9).all() and shown[2][3, 3, 3] == 0 and shown[2][1, 1, 3] == 255
    colours = np.random.default_rng(1).integers(0, 256, (7, 3), dtype=np.uint8)
    for f, p in gif.canvases(4, 4, [gif.Frame(0, 0, b, colours, 5), *frames]):
        assert (gif.shown_histogram(f, p) == gif.colour_histogram(p)).all()
    assert gif._interlaced(np.array([[0], [4], [2], [6], [1], [3], [5], [7]])).ravel().tolist() == [0, 1, 2, 3, 4, 5, 6, 7]
    data = gif.encode_gif([a, b], delay=7)
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:-40])), (3, None), (4, bytearray(b"GIF8"))], "doc_id bigint, media binary")
    rows = gif.frame_table(df).collect()
    assert sorted((r["doc_id"], r["frame"], r["start_cs"]) for r in rows if r["error"] is None) == [(1, 0, 0), (1, 1, 7)]
    assert {r["doc_id"] for r in rows if r["error"]} == {2, 3, 4}


def test_urls(spark):
    rows = ["http://Example.COM/en/x", "http://www.example.com/en/", "https://a.b.net/fr/q?x=/es/", "http://net/es/", "http://com", "nothing", None, "", "http://notexample.com/en/", "ftp://x.net/en/1#://y", "http://a.com/", "http://a.com/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)], "page_id bigint, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(spark, df).collect()}
    assert len(got) == len(rows)
    want = {0: "example.com/en/", 1: "www.example.com/en/", 2: "net/fr/", 3: "net/es/", 4: None, 5: None, 6: None, 7: None, 8: "com/", 9: None, 10: "com/"}
    assert {i: got[i]["rule"] for i in want} == want
    assert (got[0]["host"], got[0]["path"], got[0]["verdict"]) == ("example.com", "/en/x", "block") and got[1]["verdict"] == "allow"
    assert (got[6]["host"], got[6]["path"]) == ("", "") and got[2]["path"] == "/fr/q" and got[9]["path"] == "/en/1"
    assert urls.judge(spark, df.limit(0)).count() == 0


def test_boosting_learns():
    cells = [((i, j), 10.0, 10.0 if i > 2 and j < 2 else 0.0) for i in range(5) for j in range(4)]
    base, trees = urls.boost(cells, ["length", "depth"])
    score = lambda i, j: base + sum(urls._value(t, {"length": i, "depth": j}) for t in trees)
    assert all((score(*s) > 0) == (y > 0) for s, _, y in cells)


def test_decontaminate(spark):
    question = "A farmer named Anna sells 12 kg of apples to the shop near Berlin and then Anna buys 7 pears for her mother at home today"
    other = "A farmer named Maria sells 55 kg of apples to the shop near Madrid and then Maria buys 90 pears for her mother at home today"
    mixed = "A farmer named Maria sells 55 kg of apples to the shop near Madrid and then Paul buys 90 pears for her mother at home today"
    bench = spark.createDataFrame([(1, question), (2, "short one"), (3, None), (1, question)], "item_id bigint, text string")
    fill = "some quite ordinary words without any meaning that go on for a while and never stop before the end of it "
    rows = [(0, fill + question + fill), (1, fill + other), (2, fill + mixed), (3, fill), (4, None), (5, ""), (None, question), (0, fill + question + fill)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontaminate.find_leaks(spark, docs, bench).collect()}
    assert got.keys() == {(0, 1), (1, 1)} and got[0, 1] == 0 and got[1, 1] > 0
    assert decontaminate.find_leaks(spark, docs.limit(0), bench).count() == 0 and decontaminate.find_leaks(spark, docs, bench.limit(0)).count() == 0
    kept = decontaminate.without_leaks(spark, docs, bench)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 3, 4, 5, None]
    again = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontaminate.find_leaks(spark, docs, bench, broadcast_rows=0).collect()}
    assert again == got


def leaks(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark, table, bench).collect()}


def test_short_and_slot_heavy_items(spark):
    items = ["What is the capital of France?", "Add 12 kg, 7 kg, 5 kg and 9 kg of salt", "東京は日本の首都ですか", "...", "twenty one"]
    docs = [f"we ask them {x} and that was all" for x in items[:3]] + ["What is the capital of Spain?", "Add 12 kg, 7 kg, 5 kg and 8 kg of pepper", "東京は大阪の首都です", "twenty. Two one", "so twenty-one it is", "Twenty-one!"]
    assert leaks(spark, items, docs) == {(0, 0), (1, 1), (2, 2), (8, 4)}  # an item of under four words is a leak only by itself


def test_numbers_may_become_equal_or_different(spark):
    plain = "of them the old baker who lives beside the river takes some more before noon and then he sells"
    items = [f"He buys 5 pieces {plain} again 5 loaves to those who come late", f"They have 12 kg of flour and 7 pears {plain} what remains", f"There are 2 apples and 2 pears {plain} what remains"]
    docs = [items[0].replace("again 5", "again 6"), items[1].replace("12", "5").replace("7 pears", "5 pears"), items[2].replace("2 apples", "3 apples").replace("2 pears", "5 pears"), plain.replace("old", "young").replace("river", "lake")]
    assert leaks(spark, items, docs) >= {(0, 0), (1, 1), (2, 2)} and not any(d == 3 for d, _ in leaks(spark, items, docs))
    question = "On 3 days the small shop sells 4 loaves to 5 people and on 6 days it sells 7 rolls to 8 people"
    other = "On 9 days the small shop sells 9 loaves to 2 people and on 9 days it sells 1 rolls to 1 people"
    assert leaks(spark, [question], [other]) == {(0, 0)}


def brute_removal(rows, length=50):
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        before = {o[k : k + length] for j, s in rows if j is not None and i is not None and j < i for o in [(s or "").encode()] for k in range(len(o) - length + 1)}
        for k in range(len(data) - length + 1):
            if data[k : k + length] in before:
                gone[k : k + length] = True
        out[i] = bytes(b for b, g in zip(data, gone, strict=False) if not g)
    return out


def test_suffixes(spark, docs, empty):
    rng = np.random.default_rng(4)
    common = "".join(rng.choice(list("abcde "), 300))
    rows = [(i, "".join(rng.choice(list("abcde "), int(rng.integers(0, 200)))) + common[int(rng.integers(0, 150)) :][: int(rng.integers(0, 200))] + "".join(rng.choice(list("ab"), 60))) for i in range(60)]
    rows += [(60, "a" * 500), (61, "a" * 120 + "b"), (62, None), (63, ""), (64, "é" * 40), (65, "x" + "é" * 40), (None, common)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, home string")
    want = brute_removal(rows)
    got = suffixes.remove_repeats(spark, df).collect()
    assert len(got) == len(rows)
    assert all(bytes(r["kept"]) == want[r["doc_id"]] and r["n_removed"] == r["n_bytes"] - len(r["kept"]) for r in got)
    assert suffixes.remove_repeats(spark, empty).count() == 0
    clean = suffixes.without_repeats(spark, docs)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} >= {0, 4, 7, None}


def test_merge_keeps_order_and_prefixes():
    rng = np.random.default_rng(3)
    runs = [sorted(bytes(rng.integers(97, 100, int(rng.integers(1, 12))).astype(np.uint8)) for _ in range(int(n))) for n in (5, 0, 17, 1, 9)]
    order, lengths = suffixes.merge_runs([suffixes.Run(*suffixes.front_code(r)) for r in runs])
    place, out = [0] * len(runs), []
    for r in order:
        out.append(runs[r][place[r]])
        place[r] += 1
    assert out == sorted(x for r in runs for x in r)
    assert lengths == [len(os.path.commonprefix([a, b])) for a, b in zip([b"", *out], out, strict=False)]


def test_dac(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    file = path("byte_bpe_50k.json")
    tk = tokenizers.Tokenizer.from_file(file)
    files = dac.write_tokens(spark, docs, file, 0, file_tokens=5000)
    got = sorted(dac.read_tokens(files).collect(), key=lambda r: r["start"])
    ordered = sorted(((i, t or "") for i, t, _ in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (i, t) in zip(got, ordered, strict=True):
        ids = tk.encode(t, add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert dac.read_tokens(dac.write_tokens(spark, empty, file, 0)).count() == 0


def test_dac_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate((rng.integers(0, 300, 3000), rng.integers(0, 2**32, 50), rng.integers(0, 70_000, 3000))).astype(np.uint32)
    f = dac.DacFile(dac.encode_file([5, 6], [100, len(ids) - 100], ids))
    assert (f.tokens(0, len(ids)) == ids).all() and all(f.token(int(i)) == ids[i] for i in rng.integers(0, len(ids), 300))
    assert all((f.tokens(int(a), int(a) + 37) == ids[a : a + 37]).all() for a in rng.integers(0, len(ids) - 37, 100))


def test_langid(spark, docs, empty):
    got = {r["doc_id"]: r for r in langid.identify(spark, docs).collect()}
    assert got[2]["lang_pred"] == "und" and got[3]["lang_pred"] == "und" and got[6]["lang_pred"] == "und" and got[6]["score"] == 0
    assert got[0]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(spark, docs).count() == len(TEXTS) and langid.identify(spark, empty).count() == 0


def test_langid_pieces(monkeypatch):
    model = langid.Model({"a": np.arange(64), "b": np.arange(64)[::-1].copy()}, {"a": 1, "b": 1}, 64)
    text = "some letters and more of them" * 30
    whole = model.predict([text, None, "x"])
    monkeypatch.setattr(langid, "_CHUNK", 50)
    cut = model.predict([text, None, "x"])
    assert whole[0] == cut[0] and whole[1] == pytest.approx(cut[1])


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (4, 1, 0), (6, 0, 0), (6, None, 0), (99, 1, 1), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.rate(spark, docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.rate(spark, empty, labels).count() == 0
    assert {r["score"] for r in quality.rate(spark, docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.ones(6))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == pytest.approx(2.5 / 3)
