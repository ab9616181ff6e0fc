"""Features and scores of the trained operators, worked out again character by character."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from calcstrata.llm import langid, quality, urls
from calcstrata.llm.common import importable

URLS = ["http://Example.COM/en/x", "https://a.b.net/fr/q?x=/es/&y=2&z#f?g", "http://net/es/", "nothing", "", None, "ftp://x-y-z.net/en//1/2#://y", "http://a.org/" + "p/" * 5000 + "?" + "k=v&" * 300, "http://1.2.3.4/5?6", "://", "http://éé.com/ü?"]


def test_url_features(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    host, path = urls.split_url(F.col("url"))
    got = df.withColumn("host", host).withColumn("path", path)
    got = got.select("page_id", "host", "path", *(c.alias(n) for n, c in urls.lexical_features(F.col("url"), F.col("host"), F.col("path")).items())).collect()
    for r in got:
        u = URLS[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        query = re.search(r"\?([^#]*)", u)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (r["host"], r["path"]) == (host, path)
        assert r["length"] == len(u) and r["depth"] == sum(p != "" for p in path.split("/")) and r["hyphens"] == host.count("-")
        assert math.isclose(r["digit_ratio"], sum(c in "0123456789" for c in u) / len(u) if u else 0.0)
        assert math.isclose(r["entropy"], -sum(n / len(host) * math.log2(n / len(host)) for n in Counter(host).values()) if host else 0.0, abs_tol=1e-9)
        assert r["params"] == (len(query[1].split("&")) if query and query[1] else 0)


def test_suffix_rates_leave_the_own_label_out(spark):
    rows = [(0, "a.com", "block"), (1, "b.com", "allow"), (2, "c.com", None), (3, "only.xyz", "block"), (4, "d.com", "block")]
    df = spark.createDataFrame(rows, "page_id bigint, host string, told string")
    bucket = {r["s"]: r["b"] for r in df.select(F.substring_index("host", ".", -1).alias("s"), urls.suffix_bucket(F.col("host")).alias("b")).collect()}
    counts = [(0, 0)] * urls.SUFFIX_BUCKETS
    counts[bucket["com"]], counts[bucket["xyz"]] = (3, 2), (1, 1)
    got = {r["page_id"]: r["x"] for r in df.select("page_id", urls.suffix_rate(counts, F.col("host"), F.col("told")).alias("x")).collect()}
    assert got == {0: pytest.approx(2 / 4), 1: pytest.approx(3 / 4), 2: pytest.approx(3 / 5), 3: pytest.approx(1 / 2), 4: pytest.approx(2 / 4)}


def test_accuracy_on_hosts_not_seen(spark):
    """Verdicts follow the shape of the path, whatever the host: no rule fits the hosts of another suffix."""
    rng = np.random.default_rng(2)
    rules = (("block", "known", "/deep/"), ("allow", "known", "/flat"))
    rows = [f"http://h{i}.known/deep/" + "/".join("abc") + f"/{rng.integers(100)}" if i % 2 else f"http://h{i}.known/flat{rng.integers(100)}" for i in range(400)]
    rows += [f"http://h{i}.other{i % 7}"[:-1] + ("/deep/a/b/c/" if i % 2 else "/flat") + str(rng.integers(100)) for i in range(100)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark, df, rules).collect()}
    assert np.mean([got[400 + i] == ("block" if i % 2 else "allow") for i in range(100)]) > 0.95


def hashed(c, k, bins):
    """The bin of the k + 1 characters from the start of ``c``."""
    mask = 2**32 - 1
    h = (c[0] * 2654435761 + 1) & mask
    for x in c[1 : k + 1]:
        h = ((h ^ (h >> 15)) * 2246822519 + x * 3266489917) & mask
    return (h ^ (h >> 13)) % bins


def grams(text, bins):
    c = [ord(x) if x.isalpha() else 32 for x in text.lower()]
    return Counter(hashed(c[i : i + k + 1], k, bins) for k in range(3) for i in range(len(c) - k))


def test_languages_by_hand(spark, monkeypatch):
    importable(spark)
    monkeypatch.setattr(langid, "_CHUNK", 37)
    rows = [(i, f"{w} {w}er sie {i}! " * (i % 4 + 1), g) for i, (w, g) in enumerate([("haus", "de"), ("house", "en"), ("maison", "fr"), ("baum", "de"), ("tree", "en"), ("arbre", "fr")] * 4)]
    table = spark.createDataFrame(rows, "key bigint, text string, lang string")
    bins = 1 << 10
    model = langid.fit(table, bins=bins)
    assert model.langs == ["de", "en", "fr"] and model.bins == bins
    logs = {}
    for g in model.langs:
        counts = np.full(bins, 0.5)
        for _, t, lang in rows:
            if lang == g:
                for b, n in grams(t, bins).items():
                    counts[b] += n
        logs[g] = np.log(counts / counts.sum())
    texts = ["ein haus und ein baum", "x", "", None, "123 ..", "the house " * 30]
    langs, score = model.predict(texts)
    for t, g, s in zip(texts, langs, score, strict=True):
        if not any(c.isalpha() for c in t or ""):
            assert (g, s) == ("und", 0.0)
            continue
        own = np.array([math.log(1 / 3) + sum(n * logs[x][b] for b, n in grams(t, bins).items()) for x in model.langs])
        assert g == model.langs[int(own.argmax())] and s == pytest.approx(1 / np.exp(own - own.max()).sum(), rel=1e-3)


def test_every_language_is_learned(spark):
    importable(spark)
    rows = [(i, chr(0x4E00 + i) * 5, f"l{i:04}") for i in range(900)]
    table = spark.createDataFrame(rows, "key bigint, text string, lang string")
    model = langid.fit(table, most_cells=1 << 20)
    assert len(model.langs) == 900 and model.weights.size <= (1 << 20) + 900 and model.bins == 1 << 10
    langs, _ = model.predict([t for _, t, _ in rows])
    assert np.mean([a == g for a, (_, _, g) in zip(langs, rows, strict=True)]) > 0.9


def test_statistics_by_hand():
    text = "THE cat, the CAT | sat!\n\nsame line\nsame line\n# 12 & - ok. ok. ok."
    words = text.split()
    n, chars = len(words), len(text)
    lines = ["THE cat, the CAT | sat!", "same line", "same line", "# 12 & - ok. ok. ok."]
    marks = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
    want = (
        math.log1p(n), chars / n, sum("A" <= c <= "Z" for c in text) / chars, sum(c.isdigit() for c in text) / chars, marks / chars, sum(c in "#$%&*@^~_=+<>{}[]\\" for c in text) / n, 1 / n, len(set(words)) / n,
        1 - 3 / len(lines), 3 / n, 2 / n, sum(not any(c.isalnum() for c in w) for w in words) / n, 1 - len({(a, b) for a, b in zip(words, words[1:], strict=False)}) / (n - 1), math.log1p(n / (1 + sum(c in ".!?" for c in text))),
    )
    assert quality.statistics(text) == pytest.approx(want)
    assert all(math.isfinite(x) for x in quality.statistics("")) and len(want) == len(quality.STATISTICS)


def test_scores_by_hand(spark):
    """A score is the calibrated level of a cosine expansion's ridge value."""
    model = quality.Model(16, 2.0)
    rng = np.random.default_rng(0)
    k = len(quality.STATISTICS)
    model.mean, model.scale = rng.normal(size=k), rng.uniform(0.5, 2, k)
    model.weights = rng.normal(size=17)
    stats = rng.normal(size=(5, k))
    want = []
    for x in stats:
        z = np.clip((x - model.mean) / model.scale, -8, 8)
        value = model.weights[16]
        for j in range(16):
            value += model.weights[j] * math.sqrt(2 / 16) * math.cos(sum(z[i] * model.directions[i, j] for i in range(k)) + model.phases[j])
        want.append(value)
    assert model.features(stats) @ model.weights == pytest.approx(want)
