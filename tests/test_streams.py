"""Streams over files that arrive one after the other: state, expiry, late rows, replays."""

import random
import tempfile
from datetime import datetime, timedelta

import pandas as pd
import pytest

from sightlines.streaming import jobs, states


@pytest.fixture
def fed(spark):
    """Runs a job over files of rows, a file a batch, and returns the rows of every batch."""

    def run(schema, files, job, mode="update"):
        states.use_rocksdb(spark)
        at, seen = tempfile.mkdtemp(prefix="spark-"), []
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in/{i}")
            q = job(source).writeStream.outputMode(mode).foreachBatch(lambda b, e: seen.append([tuple(r) for r in b.collect()])).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        return [x for x in seen if x]

    return run


D = datetime
PULL_COLUMNS = ["pulled_at", "sessions", "rage_clicks", "scroll"]
CHECKS = "site_id string, keyword string, check_id long, checked_at timestamp, position long, error string"


def test_ranks_are_kept_forgotten_and_never_go_back(fed):
    files = [
        [("s", "a", 1, D(2024, 1, 2), 9, None), ("s", "a", 2, D(2024, 1, 3), None, "timeout")], [("s", "a", 3, D(2024, 1, 5), 4, None)], [("s", "a", 4, D(2024, 1, 4), 1, None)],  # the third is older than the state
        [("s", "b", 5, D(2024, 9, 1), 7, None)],  # half a year on: a's timer is due
        [("s", "a", 6, D(2024, 9, 2), 30, None)], [("s", "a", 7, D(2024, 1, 6), 2, None)],  # starts anew; behind the watermark
    ]
    out = fed(CHECKS, files, lambda s: states.stream_rank_state(s, "10 days", ttl_days=90))
    got = [(k, last, prev, best) for batch in out for _, k, last, prev, best, _ in batch]
    assert got == [("a", 9, None, 9), ("a", 4, 9, 4), ("a", 4, 9, 4), ("b", 7, None, 7), ("a", 30, None, 30)]


def test_verdicts_outlive_errors_and_expire(fed):
    schema = "question string, engine string, check_id long, checked_at timestamp, verdict string, error string"
    files = [
        [("q", "e", 1, D(2024, 1, 1), "cited", None), ("q", "e", 2, D(2024, 1, 2), "absent", "timeout")], [("q", "e", 3, D(2024, 1, 3), None, "timeout")], [("q", "e", 4, D(2023, 12, 31), "absent", None)],
        [("p", "e", 5, D(2025, 1, 1), "mentioned", None)], [("q", "e", 6, D(2025, 1, 2), None, "timeout")],
    ]
    out = fed(schema, files, lambda s: states.stream_verdict_state(s, "10 days", ttl_days=90))
    assert [x for batch in out for x in batch] == [("q", "e", "cited", 1), ("q", "e", "cited", 2), ("q", "e", "cited", 2), ("p", "e", "mentioned", 0), ("q", "e", None, 1)]


def test_behavior_slides_with_one_pull_a_day(fed):
    schema = "key string, pulled_at timestamp, sessions long, rage_clicks long, scroll long"
    files = [[("k", D(2024, 1, 1, 5), 10, 1, 50), ("k", D(2024, 1, 1, 9), 20, 2, 40)], [("k", D(2024, 1, 1, 7), 99, 9, 99)], [("k", D(2024, 1, 2), 5, 0, 60)], [("k", D(2024, 1, 4), 7, 1, 10)]]
    out = [x for b in fed(schema, files, lambda s: states.stream_behavior_window(s, 3, "30 days")) for x in b]
    assert [(str(day), days, n, rage, scroll) for _, day, days, n, rage, scroll in out] == [("2024-01-01", 1, 20, 2, 40), ("2024-01-01", 1, 20, 2, 40), ("2024-01-02", 2, 25, 2, 60), ("2024-01-04", 2, 12, 1, 60)]


class Told(dict):
    """State variables that count how often they are written."""

    calls = 0

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def test_behavior_state_is_written_once_a_day_whatever_the_pulls(monkeypatch):
    rng = random.Random(3)
    pulls = pd.DataFrame([("k", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=rng.randrange(20 * 1440)), rng.randrange(3), rng.randrange(3), i % 100) for i in range(5000)], columns=["key", *PULL_COLUMNS])
    pulls = pulls.sort_values("pulled_at", ignore_index=True)  # each pull replaces the one before
    best = {}
    for _, *pull in pulls.itertuples(index=False):
        best[pull[0].date()] = max(best.get(pull[0].date(), pull), pull)
    window = [best[d] for d in best if d > max(best) - timedelta(days=14)]
    want = (len(window), sum(p[1] for p in window), sum(p[2] for p in window), max(p[3] for p in window))
    for rows in ([pulls], [pulls[i : i + 700] for i in range(0, 5000, 700)], [pulls.sample(frac=1, random_state=1)]):
        w = states.BehaviorWindow(14, 400)
        w.pulls, w.renew = Told(), lambda newest: None
        (out,) = w.handleInputRows(("k",), iter(rows), None)
        assert tuple(out.iloc[0, 2:]) == want and w.pulls.calls == 14

    both = pd.concat([pulls, pulls.assign(key="l")])
    for most, pieces in ((20_000, 7), (30, 7), (1, 3)):
        monkeypatch.setattr(states, "PULLS_AT_ONCE", most)
        kept = pd.concat(states.latest_pulls(both[i::pieces] for i in range(pieces)))
        assert len(kept) <= len(best) * 2 * (1 if most == 20_000 else pieces)
        got = {k: max(map(tuple, g[PULL_COLUMNS].itertuples(index=False))) for k, g in kept.groupby(["key", kept["pulled_at"].dt.date])}
        assert got == {(k, d): tuple(p) for k in "kl" for d, p in best.items()}


def test_replayed_and_late_alerts_fire_once(fed):
    rows = [[("k1", D(2024, 1, 1)), ("k1", D(2024, 1, 1)), ("k2", D(2024, 1, 2))], [("k1", D(2024, 1, 3)), ("k3", D(2024, 1, 3))], [("k4", D(2024, 3, 1))], [("k5", D(2024, 1, 1)), ("k4", D(2024, 3, 2))]]
    out = fed("dedupe_key string, ts timestamp", rows, jobs.stream_once, "append")
    assert [sorted(k for k, _ in b) for b in out] == [["k1", "k2"], ["k3"], ["k4"]]  # k5 comes behind the watermark
