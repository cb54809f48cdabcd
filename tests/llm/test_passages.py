"""Seed-and-extend removal against a plain search of windows, and the defined cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sightlines.llm import passages, queries

N = passages.LENGTH


def plain(rows):
    """doc_id, words, removed stretches, kept text of every row."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    low = lambda i: -(1 << 63) if i is None else i
    least = {}
    for i, w in words:
        for a in range(len(w) - N + 1):
            k = tuple(w[a : a + N])
            least[k] = min(least.get(k, low(i)), low(i))
    out = []
    for i, w in words:
        gone = {x for a in range(len(w) - N + 1) if least[tuple(w[a : a + N])] < low(i) for x in range(a, a + N)}
        edges = [(x, x in gone) for x in range(len(w) + 1)]
        starts = [x for x, g in edges if g and x - 1 not in gone]
        ends = [x for x, g in edges if not g and x - 1 in gone]
        out.append((i, len(w), list(zip(starts, ends)), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(map(repr, out))


def corpus(r):
    """Texts with copies, shared passages at every offset, periodic stretches, and near copies."""
    made = lambda n, letters: [f"w{r.randrange(letters)}" for _ in range(n)]
    shared, rows = [made(r.randrange(20, 130), 1000) for _ in range(6)], []
    for i in range(160):
        kind = r.randrange(7)
        if kind == 0:
            w = made(r.randrange(0, 200), 1000)
        elif kind == 1 and rows:
            w = re.findall(r"\S+", rows[r.randrange(len(rows))][1] or "")
        elif kind == 2 and rows:
            w = re.findall(r"\S+", rows[r.randrange(len(rows))][1] or "")
            for _ in range(r.randrange(1, 4)):
                if w:
                    w[r.randrange(len(w))] = "edit"
        elif kind == 3:
            w = ["la", "le"][: r.randrange(1, 3)] * r.randrange(1, 80)
        elif kind == 4:
            w = made(40, 2) + r.choice(shared) + made(40, 2)
        else:
            w = made(r.randrange(60), 1000)
            for _ in range(r.randrange(1, 4)):
                p = r.choice(shared)
                w += p[r.randrange(3) :][: r.randrange(20, 130)] + made(r.randrange(20), 1000)
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    rows += [(None, rows[3][1]), (-5, rows[4][1]), (7, rows[5][1]), rows[6], rows[6], (900, None), (901, ""), (902, "\t\x0b "), (903, rows[8][1].replace(" ", "\n"))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, rid string, marks int")


@pytest.mark.parametrize("most", [passages.MOST, 3, 0])
def test_equals_the_plain_version(spark, most):
    rows = corpus(random.Random(11 + most % 7))
    got = passages.remove(frame(spark, rows), most).collect()
    assert sorted(repr((x.doc_id, x.n_words, [tuple(s) for s in x.removed], x.kept)) for x in got) == plain(rows)


def test_an_anchor_amid_ever_different_words(spark):
    """One stretch under 50 words in 3,000 surroundings repeats no window; with 50 words it repeats one."""
    r = random.Random(1)
    core = [f"c{i}" for i in range(N)]
    rows = [(i, " ".join([f"x{r.random()}" for _ in range(60)] + core[: N - 1 + i % 2] + [f"y{r.random()}" for _ in range(60)])) for i in range(3000)]
    for most in (passages.MOST, 100):
        got = {x.doc_id: [tuple(s) for s in x.removed] for x in passages.remove(frame(spark, rows), most).collect()}
        assert got == {i: [(60, 60 + N)] if i % 2 and i > 1 else [] for i in range(3000)}


def test_anchors_are_extended_whole_when_a_task_holds_more(spark):
    """Rows of one seed that arrive in several batches and beyond `together` still meet."""
    r = random.Random(3)
    core = [f"c{i}" for i in range(N)]
    rows = [(i, " ".join([f"x{r.random()}" for _ in range(9)] + core + [f"y{r.random()}" for _ in range(9)])) for i in range(700)]
    marks = passages._marks(passages._pieces(passages._identified(frame(spark, rows))), passages.MOST)
    texts = passages._identified(frame(spark, rows)).join(marks, ["id", "rid"]).select("id", "rid", "text", "marks")
    pieces = passages._contested(texts, 1)
    whole, cut = (sorted(map(tuple, passages._by_words(pieces, n).collect())) for n in (passages.TOGETHER, 10))
    assert whole == cut and len(whole) == 699


def test_pieces_hold_every_window_once():
    r = random.Random(2)
    docs = [[r.randrange(3) for _ in range(r.choice([0, 49, 50, 51, 200]))] for _ in range(40)]
    off = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    h = passages.hashed(pa.array([str(x) for d in docs for x in d]))
    at, size, place, _ = passages.anchors(h, off)
    got = sorted(x for a, n in zip(at.tolist(), size.tolist()) for x in range(a, a + n))
    assert got == [o + i for d, o in zip(docs, off.tolist()) for i in range(len(d) - N + 1)]
    assert (size <= passages.REACH).all() and (place - size + 1 >= 0).all() and (place + passages.SEED <= N).all()


def test_empty_table_and_long_text(spark):
    assert passages.remove(frame(spark, [(1, "a")]).limit(0)).count() == 0
    long = " ".join(f"v{i % 70_001}" for i in range(200_000))
    got = passages.remove(frame(spark, [(1, long), (2, "start " + long)])).collect()
    assert {x.doc_id: (x.n_words, [tuple(s) for s in x.removed], x.kept == long) for x in got} == {1: (200_000, [], True), 2: (200_001, [(1, 200_001)], False)}


def test_op13_digests(spark, tmp_path):
    rows = corpus(random.Random(13))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_repeated_passages(spark, str(tmp_path)).collect()
    want = [eval(x) for x in plain(rows)]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, n, sum(b - a for a, b in s), hashlib.sha256(t.encode()).hexdigest())) for i, n, s, t in want)
