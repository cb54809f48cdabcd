"""Queries over small tables where a part of the rows was once left out."""

import itertools
import re
import unicodedata
from datetime import datetime

import duckdb
import pytest

from sightlines.operators import keywords
from sightlines.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_related_domains_of_any_group_size(spark, tmp_path):
    spark.createDataFrame([(300 * i, 1) for i in range(1, 13)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.a, r.b): r["values"].split("|") for r in QUERIES["j22_related_domains"](spark, str(tmp_path)).collect()}
    assert {("d1200", f"d{300 * i}") for i in range(1, 13) if i != 4} == {k for k in got if k[0] == "d1200"}
    assert all({"ip:ip0", "ns:ns1"} <= set(v) for k, v in got.items() if k[0] == "d1200")


def test_related_domains_leave_common_providers_out(spark):
    rows = [(d, "ns", "X.NS.Cloudflare.com", "weak", None) for d in "abc"] + [(d, "ip", "1.2.3.4", "weak", True) for d in "abc"] + [(d, "ip", "5.6.7.8", "weak", False) for d in "bc"]
    prints = spark.createDataFrame(rows, "domain string, kind string, value string, strength string, behind_cdn boolean")
    assert [tuple(r) for r in keywords.related_domains(prints).collect()] == [("b", "c", "weak", 1, "ip:5.6.7.8")]


def test_related_domains_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    want = con.sql(ORACLES["j22_related_domains"])
    got = QUERIES["j22_related_domains"](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def _events(spark, path, rows):
    """events of (user_id, k, day)."""
    rows = [(i, datetime(2024, 1, day), user, "click", 1.0, f'{{"k": {k}}}') for i, (user, k, day) in enumerate(rows)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")


def test_related_pairs_read_every_day(spark, tmp_path):
    """Two queries that share a word and, on far days, their only page."""
    _events(spark, tmp_path, [(0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 15, 20), (0, 15, 25), (5, 15, 29), (0, 15, 30)])
    got = [(r.site_id, r.a, r.b, r.shared_tokens) for r in QUERIES["a5_related_pairs"](spark, str(tmp_path)).collect()]
    assert got == [("site0", "how to buy crm tools", "how to buy running shoes tools", "buy|how|tools")]


def test_related_pairs_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.sql(ORACLES["a5_related_pairs"])
    got = QUERIES["a5_related_pairs"](spark, SF).select(*want.columns).collect()
    assert len(got) and sorted(map(tuple, got)) == sorted(want.fetchall())


def test_clean_text_of_every_language(spark):
    def brute(text):
        bare = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.category(c).startswith("M"))
        return re.sub(r"[\W_]+", " ", bare).strip()

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert {r.lang for r in docs} > {"en"}
    got = QUERIES["f1_clean_text"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, brute(r.text)) for r in docs)


def test_clean_text_without_a_language(spark, tmp_path):
    spark.createDataFrame([(1, "Été_à", "fr"), (2, "Straße", None)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["f1_clean_text"](spark, str(tmp_path)).collect())) == [(1, "ete a"), (2, "straße")]


@pytest.fixture(scope="module")
def wordy(spark, tmp_path_factory):
    """Ten labelled documents, two of them held out, that share 7,000 words; the good ones lack 2,500 of them."""
    at = tmp_path_factory.mktemp("wordy")
    words = ["".join(x) for x in itertools.islice(itertools.product("abcdefghij", repeat=4), 7000)]
    rows = [(i, " ".join(words[: 4500 if i % 2 else 7000]), i % 2) for i in range(10)]
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_marker_model_has_its_full_vocabulary(spark, wordy):
    assert QUERIES["m1_train_marker_model"](spark, wordy).count() == 6000
    assert QUERIES["m4_model_stats"](spark, wordy).first().vocabulary == 6000
    scored = {r.doc_id: r.markers for r in QUERIES["m2_score_documents"](spark, wordy).collect()}
    assert scored[0] == 6000 and scored[1] == 3500
    assert QUERIES["m3_ban_candidates"](spark, wordy).count() == 60


def test_word_counts_are_no_top_list(spark, wordy):
    counts = QUERIES["m1_word_counts"](spark, wordy)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert counts.count() == 7000 and "Limit" not in plan and "Sort" not in plan
