"""Spelling variants against all pairs, and the defined cases."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sightlines.llm import queries, spelling


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(counts):
    out, form = [], {}
    for w, n in counts.items():
        near = sorted((-counts[o], o) for o in counts if len(w) >= 5 and len(o) >= 5 and one_apart(w, o))
        has = near and -near[0][0] >= 2 * n
        form[w] = near[0][1] if has else None
        out.append([w, form[w], None, n, len(near), -near[0][0] if has else None])
    for row in out:
        root = row[0]
        while form[root]:
            root = form[root]
        row[2] = root
    return sorted(map(repr, map(tuple, out)))


def vocabulary(r):
    """Words and their edits: few letters make frequent grams, and ends and starts that many share."""
    base = ["".join(r.choice("abé") for _ in range(r.randrange(4, 9))) for _ in range(120)] + ["a" * n for n in range(4, 12)] + ["station", "nation", "stations", "ÿéabcdef", "naïve$word", "new\0mark", "\U0001f600\U0001f601abc\U0001f602", "x" * 64, "x" * 65]
    words = Counter(base)
    for w in base * 3:
        i, c = r.randrange(len(w) + 1), r.choice("abéx")
        words[r.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])] += r.randrange(1, 40)
    return {w: n for w, n in words.items() if w}


def test_groups_equal_all_pairs(spark, monkeypatch):
    for seed, often in ((1, 50), (2, 3)):
        monkeypatch.setattr(spelling, "FREQUENT", often)
        counts = vocabulary(random.Random(seed))
        got = spelling.group(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(repr(tuple(x)) for x in got.collect()) == plain(counts)


def test_affected_grams_bound_what_edits_change(spark, monkeypatch):
    """A word shares all grams but its affected ones with any near word, place for place."""
    monkeypatch.setattr(spelling, "FREQUENT", 4)
    counts = {w: n for w, n in vocabulary(random.Random(4)).items() if len(w) < 64}
    words = spark.createDataFrame([x for x in counts.items() if len(x[0]) >= 5], "word string, n bigint")
    rows = spelling.decomposed(words).withColumn("most", spelling.affected(F.col("reach"), F.col("size"))).collect()
    grams, most = {x.key: {(g.at, g.gram) for g in x.grams} for x in rows}, {x.key: x.most for x in rows}
    assert set(grams) == {w for w in counts if len(w) >= 5} and all(len(grams[w]) == len(w) > most[w] for w in grams)
    assert {len(g.gram) for x in rows for g in x.grams} == {2, 3, 4}
    pairs = [(a, b) for a in grams for b in grams if one_apart(a, b)]
    for a, b in pairs:
        move = len(b) - len(a)
        same = sum((at, g) in grams[b] or (at + move, g) in grams[b] for at, g in grams[a])
        assert same >= len(grams[a]) - most[a]
    assert len(pairs) > 200


def test_roots_follow_long_chains_and_hot_forms(spark):
    chain = {"abcdefgh"[: 8 - i] + "z" * i: 3 * 2**i for i in range(9)}  # each replaces one more letter
    hot = {f"hotwor{chr(0x100 + i)}": 3 for i in range(400)} | {"hotword": 1000}
    got = {x.word: x for x in spelling.group(spark.createDataFrame([*chain.items(), *hot.items()], "word string, n bigint")).collect()}
    assert {got[w].root for w in chain} == {"z" * 8} and {got[w].root for w in hot} == {"hotword"}
    assert got["hotword"].n_near == 400 and got[f"hotwor{chr(0x100)}"].n_near == 400


def test_odd_vocabularies(spark):
    long = "abcdefghij" * 3000
    rows = [(long, 3), (long + "x", 9), (None, 5), ("", 4), ("abc", 7), ("abd", 70), ("short", 2), ("short", 2), ("sport", 8)]
    got = {x.word: tuple(x) for x in spelling.group(spark.createDataFrame(rows, "word string, n bigint")).collect()}
    assert got[long][1:] == (long + "x", long + "x", 3, 1, 9) and got["short"] == ("short", "sport", "sport", 4, 1, 8)
    assert got["abc"] == ("abc", None, "abc", 7, 0, None) and got[""][4] == 0 and len(got) == 7
    assert spelling.group(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_op12_equals_the_plain_version(spark, tmp_path):
    r = random.Random(6)
    words = [w for w in vocabulary(r) if re.fullmatch(r"[A-Za-zÀ-ÿ]+", w)]
    texts = [" ".join(r.choice(words).capitalize() if r.random() < 0.2 else r.choice(words) for _ in range(60)) + "-É1Abcde×x" for _ in range(80)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[0], "c"), (None, texts[1], None), (91, None, "c"), (92, "", "c"), (93, "12 !", "c")]
    spark.createDataFrame(rows, "doc_id bigint, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t, _ in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = 1 if i is None else zlib.crc32(f"{i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    got = queries.op12_spelling_variants(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(x)) for x in got) == plain({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
