"""Operators against plain versions that share no code with them, and stages on odd tables."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sightlines.llm import jaccard, mixing, quality, simhash, textkit, urls

M = (1 << 64) - 1
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row1 string, mix_copies int, quality_score string"


def mix(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * by) & M
    return x ^ (x >> 31)


def stream(n, seed):
    return [mix((i * 0x9E3779B97F4A7C15 + seed) & M) for i in range(1, n + 1)]


def plain_fingerprint(text):
    values, mult = stream(256, 11), [x | 1 for x in stream(3, 77)]
    hashes = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        h = power = 0
        for i, c in enumerate(w):
            power = 1 if i == 0 else power * 0x9E3779B97F4A7C55 & M
            h = (h + values[c + 32 if 65 <= c <= 90 else c] * power) & M
        hashes.append(mix(h))
    terms = [mix(sum(h * m for h, m in zip(hashes[i : i + 3], mult)) & M) for i in range(len(hashes) - 2)]
    if 0 < len(hashes) < 3:
        terms = [mix((sum(h * m for h, m in zip(hashes, mult)) + len(hashes)) & M)]
    return sum(1 << b for b in range(64) if sum(1 if t >> b & 1 else -1 for t in terms) > 0)


def test_op1_fingerprints_equal_the_plain_vote():
    r = random.Random(4)
    texts = ["", None, " \n", "one", "One two", "a b c", *[" ".join(r.choice(["Aé", "b", "cc", "Dd", "e-e", "日本"]) for _ in range(r.randrange(1, 400))) for _ in range(20)]]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]
    assert textkit.stream(5, 3).tolist() == stream(5, 3)


def plain_mix(rows, draws, most=3, power=0.25):
    """{key: words taken} by targets, certain copies and one walk through each source's order."""
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, _ in rows}
    by = {}
    for k, _, s in rows:
        by.setdefault(s, []).append(k)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[k] for k in by[s]) for s in order}
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, free, target = sum(own.values()), set(order), {}
    while True:
        level = (total - sum(most * own[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * own[s]}
        if not over:
            break
        free -= over
        if not free:
            break
    target = {s: level * weight[s] if s in free else most * own[s] for s in order}
    out = {}
    for s in order:
        ks = [k for k in by[s] if size[k]]
        lo, hi = 0.0, most * max([size[k] ** -power for k in ks], default=1.0)
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(most, c * size[k] ** power) * size[k] for k in ks) < target[s] else (lo, c)
        m = {k: min(most, hi * size[k] ** power) for k in ks}
        rest = target[s] - sum(math.floor(m[k] + 1e-9) * size[k] for k in ks)
        place = {}
        for k in ks:
            p = m[k] - math.floor(m[k] + 1e-9)
            if p > 1e-9:
                place[k] = math.log(draws[k] / (1 - draws[k])) - math.log(p / (1 - p))
        for k in by[s]:
            out[k] = math.floor(m.get(k, 0) + 1e-9) * size[k]
        for k in sorted(place, key=lambda k: (place[k], k)):
            if size[k] <= rest:
                out[k] += size[k]
                rest -= size[k]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_op2_equals_one_walk_through_the_order(spark, seed):
    r = random.Random(seed)
    rows = [(i, "w " * r.choice([0, 1, 2, 5, 30, 30, 200]), r.choice(["a", "b", None, "ü"])) for i in range(120)] + [(200, None, "a"), (201, "w " * 9, "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    draws = {x.doc_id: x.u for x in df.select("doc_id", ((F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)).alias("u")).collect()}
    got = {x.doc_id: x.taken for x in mixing.mix(df).collect()}
    assert got == plain_mix(rows, draws)


def test_op7_statistics_trees_and_splits():
    r = random.Random(6)
    texts = ["", None, "A.", *["".join(r.choice("abAB 1.\n!#é") for _ in range(r.randrange(1, 300))) for _ in range(40)]]
    x = quality.statistics(pa.array(texts))
    for row, t in zip(x, texts):
        data, words = (t or "").encode(), re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
        f = dict(zip(quality.FEATURES, row))
        n = max(1, len(data))
        assert f["upper"] == pytest.approx(sum(65 <= c <= 90 for c in data) / n) and f["other_byte"] == pytest.approx(sum(c >= 128 for c in data) / n) and f["log_words"] == pytest.approx(math.log1p(len(words)))
        assert f["distinct_words"] == pytest.approx(len(set(low)) / max(1, len(words))) and f["top_word"] == pytest.approx(max([low.count(w) for w in low], default=0) / max(1, len(words)))
        assert f["distinct_pairs"] == pytest.approx(len(set(zip(low, low[1:]))) / max(1, len(words) - 1))
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 4)).round(2)
    y = ((data[:, 2] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    model = quality.fit(data, y, trees=6, depth=2)
    # walking node by node gives the same scores
    for row, p in zip(data, model.predict(data)):
        total = model.base
        for t in range(6):
            node = 0
            while node < 3:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - 3]
        assert p == pytest.approx(1 / (1 + math.exp(-total)))
    # no other split of the first tree's root gains more
    p0 = y.mean()
    g, h = p0 - y, np.full(300, p0 * (1 - p0))

    def gain(j, at):
        left = data[:, j] <= at
        if min(left.sum(), (~left).sum()) < 5:
            return -1
        return sum(g[s].sum() ** 2 / (h[s].sum() + 2) for s in (left, ~left))

    cuts = [(j, c) for j in range(4) for c in np.unique(np.quantile(data[:, j], np.linspace(0, 1, 65)[1:-1]))]
    assert gain(model.feature[0, 0], model.threshold[0, 0]) == pytest.approx(max(gain(*c) for c in cuts))
    assert ((model.predict(data) > 0.5) == (data[:, 2] > 0.3)).mean() > 0.95


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None), (3, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "some words of a test item that nobody has written anywhere"), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def odd_rows():
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    one = say(60)
    rows = [(1, one, "en", "a", 5, "k", "x", 1, "q"), (1, one, "en", "a", 5, "k", "x", 1, "q"), (1, one, None, "b", None, None, None, None, None), (None, one, "en", "a", 5, "k", "x", 1, "q"), (None, say(50), "en", None, 5, "k", "x", 1, "q"), (1, say(50), "en", "a", 5, "k", "x", 1, "q")]
    return rows + [(7, None, None, None, None, None, None, None, None), (8, "", "", "", 0, "", "", 0, ""), (8, "   ", "", "", 3, "", "", 0, ""), (9, say(40_000), "en", "long", 9, "k", "x", 1, "q"), (10, "call +1 (443) 555-5793 " + say(30), "en", "b", 9, "k", "x", 1, "q")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = odd_rows()
    docs = spark.createDataFrame(rows, DOCS)
    out = stage(spark, docs, folder)
    names = docs.columns if name != "mixing sources to target weights" else [*[c for c in docs.columns if c != "mix_copies"], "mix_copies"]
    got = out.collect()
    assert out.columns == names
    if name == "n-gram Jaccard join":  # the three rows of one text leave one; all texts stay
        assert sorted(str(x.text) for x in got) == sorted({str(t) for _, t, *_ in rows})
        assert [x.doc_id for x in got if x.text == rows[0][1]] == [1]
    elif name == "PII":
        assert len(got) == len(rows) and sum("<PHONE>" in (x.text or "") for x in got) == 1
    elif name == "benchmark decontamination":
        assert len(got) == len(rows)
    elif name == "mixing sources to target weights":
        assert all(1 <= x.mix_copies <= 3 and x.text.strip() for x in got)
    assert stage(spark, docs.limit(0), folder).count() == 0


# ----------------------------------------------------- url rules, buckets of shingles


def test_rules_are_held_against_all_their_parts(spark):
    """Parts that fall short of the confidence must not hide the better ones below them; long rules cost a row a token."""
    r = random.Random(3)
    names, all_ = "abcdefg", []
    for n in range(1, 8):
        all_ += list(itertools.combinations(names, n))
    conf = {c: r.choice([0.5, 0.7, 0.8, 0.85, 0.9, 1.0]) for c in all_}
    rows = spark.createDataFrame([(list(c), lab, v if lab == "block" else 1 - v, 0.1) for c, v in conf.items() for lab in ("block", "allow")], "tokens array<string>, label string, confidence double, support double")
    rules = rows.select(F.xxhash64("tokens", "label").alias("rule_id"), "*")
    got = {tuple(x.tokens) for x in urls.unbeaten(rules, 0.8).collect() if x.label == "block"}
    want = {c for c, v in conf.items() if v >= 0.8 and not any(set(d) < set(c) and w >= v for d, w in conf.items())}
    assert got == want and max(map(len, got)) > 1
    assert urls.unbeaten(rules.filter("label = 'allow'"), 0.8).count() == urls.unbeaten(rules.limit(0), 0.8).count() == 0


def test_rules_of_urls_with_many_query_keys(spark):
    """Fourteen keys that come and go freely, one of which decides: its rule alone is left of all combinations with it."""
    r = random.Random(8)
    rows = []
    for i in range(400):
        keys = [f"k{j}" for j in range(14) if r.random() < 0.9]
        rows.append((f"http://a.example/{i}?" + "&".join(f"{k}=1" for k in keys), "block" if "k3" in keys else "allow"))
    got = {(tuple(x.tokens), x.label, x.confidence) for x in urls.learn(spark.createDataFrame(rows, "url string, label string"), 0.25, 1.0).collect()}
    assert got == {(("k=k3",), "block", 1.0)}


def test_buckets_grow_with_the_shingles():
    sizes = [jaccard.n_buckets(8, n) for n in (0, 10**9, 10**11, 16 * 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 64 and all(n // b <= jaccard.BUCKET_SHINGLES for n, b in zip((0, 10**9, 10**11, 16 * 10**12), sizes))
    assert jaccard.n_buckets(1000, 0) == 1024


def test_links_do_not_depend_on_the_buckets(spark, monkeypatch):
    r = random.Random(4)
    base = [[r.choice("abcdefghij") * r.randint(1, 3) for _ in range(60)] for _ in range(12)]
    texts = [(i, " ".join(b[:-1] + [str(i)] if i % 3 else b)) for i, b in enumerate(base * 6)]
    docs = spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id long, text string")
    want = sorted(tuple(x) for x in jaccard.link(docs, 4, 85).collect())
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert sorted(tuple(x) for x in jaccard.link(docs, 4, 85).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({c for _, _, c in want}) < len(want)
