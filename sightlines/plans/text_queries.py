"""Registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlines.functions import drift as D
from sightlines.functions.batches import text_batches
from sightlines.operators import text as T

from . import facts
from .registry import query
from .search_queries import R


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def tagged(spark, d):
    """Documents as paragraphs of a page."""
    return docs(spark, d).withColumn("text", F.concat(F.lit('<p class="a b">'), "text", F.lit("<br/>end</p>")))


def keep(df):
    """Cuts lineage between rounds: a checkpoint where the session has a shared folder, else a cached table."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


_W = "regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '<[^>]+>', ' ', 'g'), '[\\p{L}\\p{N}]+')"
# Documents as paragraphs of a page.
_TAGGED = "(SELECT * REPLACE ('<p class=\"a b\">' || text || '<br/>end</p>' AS text) FROM documents)"
_SH = "CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) ELSE [] END"


@query("f7_word_count", f"SELECT doc_id, CAST(len({_W}) AS INTEGER) AS words FROM {_TAGGED}")
def f7_word_count(spark, d):
    return tagged(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(
    "f6_uniqueness",
    f"""WITH s AS (SELECT doc_id, lang, {_SH} AS s FROM (SELECT doc_id, lang, {_W} AS w FROM {_TAGGED})), f AS (SELECT lang, first(s ORDER BY doc_id) AS o FROM s GROUP BY lang)
    SELECT doc_id, CASE WHEN len(s) = 0 OR len(o) = 0 THEN 100.0 ELSE {R("(1 - CAST(len(list_intersect(s, o)) AS DOUBLE) / greatest(len(list_distinct(list_concat(s, o))), 1)) * 100", 0)} END AS uniqueness FROM s JOIN f USING (lang)""",
)
def f6_uniqueness(spark, d):
    """Every document against the first one of its language; those few texts are sent to all tasks, so that no task gets a whole language."""
    x = tagged(spark, d)
    first = x.groupBy("lang").agg(F.min_by("text", "doc_id").alias("other"))
    return x.join(F.broadcast(first), "lang").select("doc_id", T.uniqueness_pct(F.col("text"), F.col("other")).alias("uniqueness"))


@query(
    "f8_keyword_coverage",
    f"""WITH p AS (SELECT doc_id, ' ' || array_to_string({_W}, '  ') || ' ' AS b, ' ' || array_to_string({_W.replace("(text,", "(left(text, length(text) // 2),")}, '  ') || ' ' AS a FROM (SELECT doc_id, coalesce(text, '') AS text FROM {_TAGGED})),
    k AS (SELECT doc_id, kw, CAST((length(b) - length(replace(b, kp, ''))) // length(kp) AS INTEGER) AS before, CAST((length(a) - length(replace(a, kp, ''))) // length(kp) AS INTEGER) AS after FROM p, (VALUES ('the', ' the '), ('And the', ' and  the ')) v(kw, kp)) SELECT doc_id, kw AS keyword, before, after, before > 0 AND after = 0 AS lost FROM k""",
)
def f8_keyword_coverage(spark, d):
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    x = tagged(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.explode(T.keyword_coverage(F.col("text"), half, F.array(F.lit("the"), F.lit("And the")))).alias("k"))
    return x.select("doc_id", "k.*")


# Texts that write one fact in several forms; {i} is the document's number.
_SAID = [
    "Costs $5{i}.00 or 5{i} USD", "Kosten: 1.234,5{i} €", "EUR 1,234.5{i} and 1234.5{i} евро", "5 000 zł, 5,000 PLN", "**{i}%** of [AB{i}C](http://x.example/9)", "Ab{i}c, iPhone {i}, McDonald and SSL", "<b>0:00</b> is 00:00 for {i} гривень",
    "`RTP` ```SKIPPED 77``` | €4{i} | 20-25 |", "no facts here", "5 USDT against 6 usd and 007 KM", "96.0 = 96; 96% != 96", "Über ÄÖ12 and ABÉ: 1,2,3 or 1.2.3 kr", "£{i} 000 000,50 £1000000.5",
]
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SIGN = "[%€$£₽₴]"
_NUMBER = rf"(?:\d{{1,3}}(?:{_SPACE}\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)*)"
_BARE_TEXT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '(?s)```.*?```', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_~`|#>]+', ' ', 'g')".format
_UNIT_SQL = "CASE u " + " ".join(f"WHEN '{x}' THEN '{form}'" for form, spelt in D.UNIT_FORMS.items() for x in spelt) + " ELSE u END"
_UNITS = "[" + ", ".join(f"'{x}'" for x in [*D.SIGNS, *D.UNIT_WORDS]) + "]"
_FACTS = rf"""seen AS (SELECT doc_id, side, {_BARE_TEXT('text')} AS t FROM pairs, LATERAL (SELECT 0 AS side, before AS text UNION ALL SELECT 1, after)),
 hit AS (SELECT doc_id, side, unnest(regexp_extract_all(t, '(?:{_SIGN}{_SPACE}*)?{_NUMBER}[ \x{{00A0}}]?(?:{_SIGN}|\pL+)?')) AS m FROM seen),
 cut AS (SELECT doc_id, side, regexp_replace(regexp_extract(m, '{_NUMBER}'), '{_SPACE}', '', 'g') AS x, lower(regexp_extract(m, '({_SIGN}|\pL+)$', 1)) AS after_, regexp_extract(m, '^{_SIGN}') AS before_ FROM hit),
 num AS (SELECT doc_id, side, CASE WHEN regexp_matches(x, '^\d{{1,3}}(,\d{{3}})+(\.\d+)?$') THEN replace(x, ',', '') WHEN regexp_matches(x, '^\d{{1,3}}(\.\d{{3}})+(,\d+)?$') THEN regexp_replace(replace(x, '.', ''), '^([^,]*),', '\1.') ELSE regexp_replace(x, '^([^,]*),', '\1.') END AS x, CASE WHEN list_contains({_UNITS}, after_) THEN after_ ELSE before_ END AS u FROM cut),
 fact AS (SELECT doc_id, side, 'numbers' AS kind, regexp_replace(CASE WHEN contains(x, '.') THEN coalesce(nullif(regexp_replace(x, '\.?0+$', ''), ''), '0') ELSE x END, '^0+(\d)', '\1') || CASE WHEN u = '' THEN '' ELSE ' ' || {_UNIT_SQL} END AS value FROM num
  UNION ALL SELECT doc_id, side, 'identifiers', w FROM (SELECT doc_id, side, unnest(regexp_extract_all(t, '\b[\pL\pN]*\p{{Lu}}[\pL\pN]*\b')) AS w FROM seen) WHERE length(w) >= 2 AND upper(w) NOT IN ({", ".join(f"'{c}'" for c in D.CODES)})
   AND (regexp_matches(w, '\p{{Ll}}\p{{Lu}}') OR (length(regexp_replace(w, '[^\p{{Lu}}]', '', 'g')) >= 2 AND length(regexp_replace(w, '[^\p{{Lu}}]', '', 'g')) = length(regexp_replace(w, '\pN', '', 'g'))))),
 cnt AS (SELECT doc_id, kind, value, count_if(side = 0) AS a, count_if(side = 1) AS b FROM fact GROUP BY ALL)"""
_JOINED = "coalesce(string_agg(value, '|' ORDER BY value) FILTER (kind = '{0}' AND {1} = 0), '')".format
_KEPT = "CAST(coalesce(sum(least(a, b)) FILTER (kind = '{0}'), 0) AS BIGINT)".format
_HALVES = f"""pairs AS (SELECT doc_id, left(t, length(t) // 2) || ' ' || replace([{", ".join(f"'{x}'" for x in _SAID)}][1 + doc_id % {len(_SAID)}], '{{i}}', CAST(doc_id % 90 + 10 AS VARCHAR)) AS before, substr(t, length(t) // 2 + 1) || ' ' || replace([{", ".join(f"'{x}'" for x in _SAID)}][1 + (doc_id // 3) % {len(_SAID)}], '{{i}}', CAST(doc_id % 90 + 10 AS VARCHAR)) AS after FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


@query(
    "f9_fact_drift",
    f"""WITH {_HALVES}, {_FACTS}, d AS (SELECT doc_id, {_JOINED('numbers', 'b')} AS lost_numbers, {_JOINED('numbers', 'a')} AS added_numbers, {_JOINED('identifiers', 'b')} AS lost_identifiers, {_JOINED('identifiers', 'a')} AS added_identifiers, {_KEPT('numbers')} AS kept_numbers, {_KEPT('identifiers')} AS kept_identifiers FROM pairs LEFT JOIN cnt USING (doc_id) GROUP BY doc_id)
    SELECT *, CASE WHEN added_numbers || added_identifiers <> '' THEN 'danger' WHEN lost_numbers || lost_identifiers <> '' THEN 'warn' ELSE 'clean' END AS severity FROM d""",
)
def f9_fact_drift(spark, d):
    """Facts that the second half of a document, and a phrase, lose or add against the first half and another phrase."""
    t, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    said = lambda n: F.replace(F.element_at(F.array(*map(F.lit, _SAID)), (n % len(_SAID) + 1).cast("int")), F.lit("{i}"), (F.col("doc_id") % 90 + 10).cast("string"))
    pairs = docs(spark, d).select("doc_id", F.concat_ws(" ", F.substring(t, F.lit(1), half), said(F.col("doc_id"))).alias("before"), F.concat_ws(" ", F.substring(t, half + 1, F.length(t)), said(F.floor(F.col("doc_id") / 3))).alias("after"))
    x = D.fact_drift(pairs, "doc_id")
    return x.withColumns({c: F.array_join(c, "|") for c in x.columns if c.startswith(("lost", "added"))})


_CLEAN = "trim(regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))".format
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_PROFILE = f"""iq AS (SELECT *, {_CLEAN('query')} AS norm FROM intent_query), ac AS (SELECT site_id, norm, min(query) AS query, CAST(sum(impressions) AS BIGINT) AS i, list_sort(list(DISTINCT url)) AS urls, list_filter(list_distinct(string_split(norm, ' ')), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)) AS tokens FROM iq WHERE NOT contains(norm, site_id) GROUP BY site_id, norm HAVING sum(impressions) >= 3),
 nn AS (SELECT site_id, count(*) AS n FROM ac GROUP BY 1), tk AS (SELECT site_id, norm, unnest(tokens) AS t FROM ac), df AS (SELECT site_id, t, count(*) AS df FROM tk GROUP BY ALL), wt AS (SELECT site_id, t, df, CAST(round((ln(CAST(n + 1 AS DOUBLE) / (df + 1)) + 1) * 1000000) AS BIGINT) AS w FROM df JOIN nn USING (site_id)),
 ur AS (SELECT site_id, norm, unnest(urls) AS t FROM ac), uf AS (SELECT site_id, t, count(*) AS df FROM ur GROUP BY ALL), ky AS (SELECT site_id, 't:' || t AS k, norm FROM tk JOIN wt USING (site_id, t) WHERE df BETWEEN 2 AND 200 UNION ALL SELECT site_id, 'u:' || t, norm FROM ur JOIN uf USING (site_id, t) WHERE df BETWEEN 2 AND 200),
 pr AS (SELECT DISTINCT x.site_id, x.norm AS a, y.norm AS b FROM ky x JOIN ky y ON x.site_id = y.site_id AND x.k = y.k AND x.norm < y.norm), pj AS (SELECT p.site_id, a, b, x.tokens AS ta, y.tokens AS tb, x.urls AS ua, y.urls AS ub FROM pr p JOIN ac x ON x.site_id = p.site_id AND x.norm = a JOIN ac y ON y.site_id = p.site_id AND y.norm = b),
 lx AS (SELECT p.site_id, a, b, sum(w) FILTER (list_contains(ta, t) AND list_contains(tb, t)) AS i, sum(w) AS u FROM pj p JOIN wt ON wt.site_id = p.site_id AND (list_contains(ta, t) OR list_contains(tb, t)) GROUP BY ALL),
 ed AS (SELECT site_id, a, b, coalesce(CAST(i AS DOUBLE) / u, 0.0) AS lexical, CAST(len(list_intersect(ua, ub)) AS DOUBLE) / len(list_distinct(list_concat(ua, ub))) AS url_overlap, list_sort(list_intersect(ta, tb)) AS shared FROM pj JOIN lx USING (site_id, a, b))"""


def _sites(spark, d):
    """Every site's brand is its name."""
    return facts.intent_query(spark, d).select("site_id").distinct().withColumn("terms", F.array("site_id"))


@query("a5_related_pairs", f"WITH {_PROFILE} SELECT site_id, a, b, lexical, url_overlap, array_to_string(shared, '|') AS shared_tokens FROM ed WHERE lexical >= 0.45 OR (lexical >= 0.2 AND url_overlap >= 0.25) OR (len(shared) > 0 AND url_overlap >= 0.66)", "intent_query")
def a5_related_pairs(spark, d):
    return T.related_pairs(facts.intent_query(spark, d), _sites(spark, d), keep=keep).withColumn("shared_tokens", F.array_join("shared_tokens", "|"))


@query("a5_cannibalization_related")
def a5_cannibalization_related(spark, d):
    """Over components of the pairs: beyond SQL that stays readable; the tests hold it against a brute-force version."""
    return T.cannibalization_related(facts.intent_query(spark, d), keep, _sites(spark, d))


@query(
    "a5_flip_flops",
    f"""WITH {_PROFILE}, dy AS (SELECT site_id, norm, date, url, sum(impressions) AS i, CAST(sum(CAST(position AS DECIMAL(18,6)) * greatest(1, impressions)) AS DOUBLE) / sum(greatest(1, impressions)) AS p FROM iq WHERE NOT contains(norm, site_id) GROUP BY ALL), wn AS (SELECT * FROM dy QUALIFY row_number() OVER (PARTITION BY site_id, norm, date ORDER BY i DESC, p, url) = 1),
    lg AS (SELECT *, lag(url) OVER (PARTITION BY site_id, norm ORDER BY date) AS before FROM wn) SELECT site_id, norm, CAST(coalesce(count_if(before <> url), 0) AS BIGINT) AS flips FROM lg GROUP BY ALL""",
    "intent_query",
)
def a5_flip_flops(spark, d):
    return T.flip_flops(T._profiles(facts.intent_query(spark, d), _sites(spark, d)))


_INTENTS = {k: "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(ws)) + "]" for k, ws in T.INTENT_WORDS.items()}


@query(
    "f3_infer_intent",
    f"""WITH q AS (SELECT DISTINCT query, list_distinct(string_split({_CLEAN('query')}, ' ')) AS w FROM intent_query), h AS (SELECT query, {", ".join(f"len(list_intersect(w, {ws})) AS {k}" for k, ws in _INTENTS.items())} FROM q)
    SELECT query, CASE WHEN greatest({", ".join(_INTENTS)}) = 0 THEN 'mixed' {" ".join(f"WHEN {k} = greatest({', '.join(_INTENTS)}) THEN '{k}'" for k in _INTENTS)} END AS intent FROM h""",
    "intent_query",
)
def f3_infer_intent(spark, d):
    from sightlines.functions.unicode import clean_text

    return facts.intent_query(spark, d).select("query").distinct().select("query", T.infer_intent(F.array_distinct(F.split(clean_text("query"), " "))).alias("intent"))


_SPOTS = ["/", "/blog/x", "/products/y", "/tag/z", "/services", "/about", "/how-to/a", "/store"]


@query(
    "f4_page_role",
    f"""WITH u AS (SELECT DISTINCT query, n % {len(_SPOTS)} AS k FROM intent_query) SELECT query, CAST(k AS BIGINT) AS k, CASE WHEN k = 0 THEN 'homepage' WHEN k IN (1, 6) OR regexp_matches(lower(query), 'how-to|tutorial|руковод') THEN 'guide' WHEN k IN (2, 7) OR regexp_matches(lower(query), 'купить|цена') THEN 'product' WHEN k = 3 THEN 'category' WHEN k = 4 THEN 'landing' ELSE 'other' END AS role FROM u""",
    "intent_query",
)
def f4_page_role(spark, d):
    u = facts.intent_query(spark, d).select("query", (F.col("n") % len(_SPOTS)).alias("k")).distinct()
    url = F.concat(F.lit("https://s.example"), F.element_at(F.array(*[F.lit(x) for x in _SPOTS]), (F.col("k") + 1).cast("int")), F.lit("?q=1"))
    return u.select("query", "k", T.page_role(url, F.array("query")).alias("role"))


def _labelled(spark, d):
    """Good documents, poor ones, and the held-out fifth of each, by the quality label."""
    text_batches(spark)
    lab = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    x = docs(spark, d).join(lab, "doc_id").select("doc_id", "text", "quality")
    part = lambda q, held: x.filter((F.col("quality") == q) & ((F.col("doc_id") % 5 == 4) == held))
    return part(1, False), part(0, False), part(1, True), part(0, True)


def _words(spark, d):
    """The model alone, of bounded size."""
    h, m, _, _ = _labelled(spark, d)
    return keep(T.train_marker_model(h, m))


def _model(spark, d):
    """(model, calibration), both of bounded size."""
    model = _words(spark, d)
    _, _, hh, mh = _labelled(spark, d)
    return model, keep(T.calibrate(hh, mh, model))


def _tok(x: str) -> str:
    out = f"coalesce({x}, '')"
    for pattern, by in T.MARKUP:
        flags = "g" + "".join(c for c in "im" if pattern.startswith("(?") and c in pattern[: pattern.index(")")])
        bare = pattern[pattern.index(")") + 1 :] if pattern.startswith("(?") and flags != "g" else pattern
        q = "'" + bare.replace("'", "''") + "'"
        by = "'" + by.replace("$1", "\\1") + "'"
        out = f"regexp_replace({out}, {q}, {by}, '{flags}')"
    return f"regexp_extract_all(lower({out}), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''’-]*')"


_COUNTS = f"""lb AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1), dk AS MATERIALIZED (SELECT doc_id, {_tok('text')} AS t FROM documents), dx AS (SELECT doc_id, quality, t, len(t) AS n FROM dk JOIN lb USING (doc_id)), tw AS (SELECT doc_id, quality, unnest(t) AS w FROM dx WHERE doc_id % 5 <> 4 AND n >= 120),
 ct AS MATERIALIZED (SELECT w, CAST(count_if(quality = 1) AS BIGINT) AS human_n, count(DISTINCT CASE WHEN quality = 1 THEN doc_id END) AS human_docs, CAST(count_if(quality = 0) AS BIGINT) AS machine_n, count(DISTINCT CASE WHEN quality = 0 THEN doc_id END) AS machine_docs FROM tw WHERE quality IN (0, 1) GROUP BY w)"""
_MODEL = f"""{_COUNTS}, kn AS (SELECT * FROM ct WHERE human_docs >= 3 OR machine_docs >= 3), oo AS (SELECT (SELECT sum(human_n) FROM ct) AS hn, (SELECT sum(machine_n) FROM ct) AS mn, (SELECT count(*) FROM kn) AS v, (SELECT count(*) FROM dx WHERE doc_id % 5 <> 4 AND n >= 120 AND quality = 1) AS hd),
 rw AS (SELECT kn.*, hd, ln((machine_n + 0.5::DOUBLE) / (mn + 0.5::DOUBLE * v)) - ln((human_n + 0.5::DOUBLE) / (hn + 0.5::DOUBLE * v)) AS raw FROM kn, oo), md AS MATERIALIZED (SELECT w, {R('raw', 4)} AS weight, human_docs + machine_docs AS docs, human_docs, {R('CAST(human_docs AS DOUBLE) / hd', 2)} AS human_share FROM rw ORDER BY {R('abs(raw) * sqrt(human_docs + machine_docs)', 6)} DESC, w LIMIT 6000)"""
_WINDOWS = f"""wi AS (SELECT doc_id, len(t) AS n, unnest(range(0, greatest(1, (len(t) + 299) // 300))) AS win, t FROM dk), wk AS (SELECT doc_id, win, t[win * 300 + 1 : win * 300 + 300] AS t FROM wi WHERE win = 0 OR least(n - win * 300, 300) >= 120), wu AS (SELECT doc_id, win, unnest(t) AS w FROM wk),
 wl AS (SELECT doc_id, win, CAST(sum(CAST(round(weight * 10000) AS BIGINT)) AS DOUBLE) / (10000.0::DOUBLE * count(*)) AS llr FROM wu JOIN md USING (w) GROUP BY ALL), ws AS MATERIALIZED (SELECT wk.doc_id, wk.win, coalesce(llr, 0.0) AS llr FROM wk LEFT JOIN wl ON wl.doc_id = wk.doc_id AND wl.win = wk.win),
 hs AS (SELECT quality, CAST(llr AS DECIMAL(24,12)) AS x FROM ws JOIN lb USING (doc_id) WHERE doc_id % 5 = 4), mm AS (SELECT CAST(sum(x) FILTER (quality = 1) AS DOUBLE) / count(*) FILTER (quality = 1) AS h, CAST(sum(x) FILTER (quality = 0) AS DOUBLE) / count(*) FILTER (quality = 0) AS m, stddev_samp(CAST(x AS DOUBLE)) FILTER (quality = 1) AS sh, stddev_samp(CAST(x AS DOUBLE)) FILTER (quality = 0) AS sm FROM hs),
 ca AS (SELECT {R('h', 6)} AS cal_human, {R('m', 6)} AS cal_machine, {R('least(1.0::DOUBLE, abs(m - h) / greatest(sqrt((sh * sh + sm * sm) / 2), 0.000001::DOUBLE) / 4)', 3)} AS separation FROM mm)"""


@query("m1_train_marker_model", f"WITH {_MODEL} SELECT * FROM md")
def m1_train_marker_model(spark, d):
    h, m, _, _ = _labelled(spark, d)
    return T.train_marker_model(h, m)


@query("m1_word_counts", f"WITH {_COUNTS} SELECT * FROM ct")
def m1_word_counts(spark, d):
    h, m, _, _ = _labelled(spark, d)
    return T.marker_counts(h, m)


@query(
    "m2_score_documents",
    f"""WITH {_MODEL}, {_WINDOWS}, sc AS (SELECT doc_id, CAST(greatest(0.0, least(100.0, {R('(llr - cal_human) / (cal_machine - cal_human) * 100', 0)})) AS BIGINT) AS s FROM ws, ca), pd AS (SELECT doc_id, CAST({R('CAST(sum(s) AS DOUBLE) / count(*)', 0)} AS INTEGER) AS score, count(*) AS windows FROM sc GROUP BY 1),
    mk AS (SELECT doc_id, count(*) AS markers FROM (SELECT doc_id, unnest(t) AS w FROM dk) JOIN md USING (w) GROUP BY 1) SELECT doc_id, score, windows, CAST(len(t) AS BIGINT) AS words, coalesce(markers, 0) AS markers, CASE WHEN score < 15 THEN 'human' WHEN score < 40 THEN 'mixed' ELSE 'ai' END AS verdict FROM pd JOIN dk USING (doc_id) LEFT JOIN mk USING (doc_id)""",
)
def m2_score_documents(spark, d):
    return T.score_documents(docs(spark, d), *_model(spark, d))


@query(
    "m2_document_markers",
    f"WITH {_MODEL}, c AS (SELECT doc_id, w, count(*) AS count FROM (SELECT doc_id, unnest(t) AS w FROM dk) GROUP BY ALL), x AS (SELECT doc_id, w, weight, count, {R('weight * count', 4)} AS contribution FROM c JOIN md USING (w)) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY contribution DESC, w) AS INTEGER) AS place FROM x WHERE contribution > 0 QUALIFY place <= 40",
)
def m2_document_markers(spark, d):
    return T.document_markers(docs(spark, d), _words(spark, d))


@query(
    "m2_missing_words",
    f"WITH {_MODEL}, ne AS (SELECT list(w ORDER BY weight, w) AS ws FROM md WHERE weight < 0 AND length(w) > 2) SELECT doc_id, array_to_string(list_filter(ws, lambda x: NOT list_contains(t, x))[1:40], '|') AS words FROM dk, ne",
)
def m2_missing_words(spark, d):
    return T.missing_words(docs(spark, d), _words(spark, d)).withColumn("words", F.array_join("words", "|"))


@query("m3_ban_candidates", f"WITH {_MODEL} SELECT * FROM md WHERE weight > 0 AND length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]') AND human_share < 0.4 ORDER BY weight DESC, w LIMIT 60")
def m3_ban_candidates(spark, d):
    return T.ban_candidates(_words(spark, d))


@query("m4_model_stats", f"WITH {_MODEL}, {_WINDOWS} SELECT (SELECT count(*) FROM md) AS vocabulary, ca.*, CASE WHEN separation >= 0.6 THEN 'good' WHEN separation >= 0.35 THEN 'fair' ELSE 'weak' END AS quality FROM ca")
def m4_model_stats(spark, d):
    return T.model_stats(*_model(spark, d))


@query("f1_clean_text", "SELECT doc_id, trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS clean FROM documents")
def f1_clean_text(spark, d):
    from sightlines.functions.unicode import clean_text

    return docs(spark, d).select("doc_id", clean_text("text").alias("clean"))


@query("f2_intent_tokens", f"SELECT DISTINCT query, array_to_string(list_sort(list_filter(list_distinct(string_split({_CLEAN('query')}, ' ')), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))), '|') AS tokens FROM intent_query", "intent_query")
def f2_intent_tokens(spark, d):
    return facts.intent_query(spark, d).select("query").distinct().select("query", F.array_join(F.array_sort(T.intent_tokens("query")), "|").alias("tokens"))
