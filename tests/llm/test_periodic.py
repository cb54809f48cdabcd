"""Periodic runs against a search of all periods, and the defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sightlines.llm import periodic, queries


def plain_runs(w):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda x: (x[0], x[2]))


def sample(r):
    n, kind, letters = r.choice([0, 1, 11, 12, 13, 30, 60, 150, 300]), r.randrange(6), r.choice([1, 2, 3, 5, 60])
    w = [r.randrange(letters) for _ in range(n)]
    if kind == 1 and n:
        p = r.randrange(1, n + 1)
        w = [w[i % p] for i in range(n)]
    if kind == 2 and n > 10:
        p = r.randrange(1, 8)
        w = w[: n // 3] + (w[:p] * n)[: n // 2] + w[: n // 3] + (w[:p] * n)[: n // 2]
    if kind == 3:  # two stretches of one small period out of step: a run for every odd length
        w = [0, 1] * (n // 4) + [1, 0] * (n // 4) + [0, 1] * (n // 5)
    if kind == 4:
        w = [bin(i).count("1") % 2 for i in range(n)] * 2
    if kind == 5:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n]
    return w


def test_runs_equal_the_search_of_all_periods():
    r = random.Random(2)
    for _ in range(500):
        docs = [sample(r) for _ in range(r.randrange(1, 4))]
        off = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        found = periodic.word_runs(np.array([x for d in docs for x in d], np.int64), off)
        want = sorted(((s + o, n, q) for d, o in zip(docs, off.tolist()) for s, n, q in plain_runs(d)), key=lambda x: (x[0], x[2]))
        assert list(zip(*(x.tolist() for x in found))) == want


def test_successor_in_ranges():
    r = np.random.default_rng(3)
    values = r.permutation(777)
    lo, hi, x = r.integers(0, 778, 500), r.integers(0, 778, 500), r.integers(0, 790, 500)
    lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
    want = [min((v for v in values[a:b] if v >= c), default=777) for a, b, c in zip(lo, hi, x)]
    assert periodic.WaveletTree(values).successor(lo, hi, x).tolist() == want


def test_separators_and_words_are_those_of_the_contract():
    texts = [None, "", " \t\n\x0b\x0c\r", "a", " a\tb\nc\x0bd\x0ce\rf ", "x\x1cy z w\x85v", "é  日本"]
    words, off = periodic.split_words(pa.array(texts))
    for i, t in enumerate(texts):
        assert words.slice(off[i], off[i + 1] - off[i]).to_pylist() == re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sliced = pa.array(["drop me", *texts]).slice(1)
    assert periodic.split_words(sliced)[0].to_pylist() == words.to_pylist()


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if w and h is not None and h % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(((-n, s, q) for s, n, q in runs), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    r = random.Random(5)
    texts = [None, "", "  ", "one", "la " * 40, "Na na " * 9, "a b c d e f " * 3 + "x", "ü\x0bü " * 20, *[" ".join(f"w{x}" for x in sample(r)) for _ in range(120)]]
    rows = [(i, t, "clash", 1, "t") for i, t in enumerate(texts)] + [(7, texts[7], "clash", 2, "t"), (None, "so so " * 8, None, None, None), (5, None, "clash", 3, "t")]
    at = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int, collapsed string").write.parquet(f"{at}/documents.parquet")
    return str(at), rows


def test_op11_equals_the_plain_version_on_odd_rows(spark, odd):
    got = queries.op11_periodic_runs(spark, odd[0]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(x[0], x[1])) for x in odd[1])


def test_find_keeps_clashing_columns_and_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    found = periodic.find(docs)
    assert found.columns == ["doc_id", "runs", "n_words", "collapsed", "n_words_", "runs_", "collapsed_"]
    assert found.filter("doc_id = 4").select("runs", "n_words_", "collapsed_").first()[:] == ("clash", 40, "la")
    assert found.filter("doc_id = 4").first()["runs_"][0].asDict() == {"start": 0, "length": 40, "period": 1}
    assert periodic.find(docs.limit(0)).count() == 0


def test_one_very_long_text():
    n = 400_000
    w = np.arange(n) % 90_001
    start, length, period = periodic.word_runs(w, np.array([0, n]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [n], [90_001])
    assert [x.tolist() for x in periodic.word_runs(np.zeros(n, np.int64), np.array([0, n]))] == [[0], [n], [1]]
