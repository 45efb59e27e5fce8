"""Queries over usage, vectors, text, routing, prefixes, streams, conversations and registries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import conversations as T
from corvane.operators import overview as O
from corvane.operators import prefix as P
from corvane.operators import registry_ops as N
from corvane.operators import routing as G
from corvane.operators import usage as U
from corvane.operators import vectors as V
from corvane.plans.book import Book
from corvane.sources.views import CALLS_SQL, USAGE_SQL, calls, table, usage
from corvane.streaming import windows as S

_book = Book()
query = _book.add
QUERIES, ORACLE_SQL = _book.queries, _book.sql
AS_OF = "2024-01-20 00:00:00"
_SUMS = "CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS requests"

# --- usage -------------------------------------------------------------------------------------------------------


@query(f"WITH {USAGE_SQL} SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:00') AS bucket, model, {_SUMS} FROM usage WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY GROUP BY 1, 2")
def usage_hour(spark, d):
    return U.buckets(usage(spark, d), "day", AS_OF)


@query(f"WITH {USAGE_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS bucket, model, user_id, {_SUMS} FROM usage WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1, 2, 3")
def usage_day(spark, d):
    return U.buckets(usage(spark, d), "week", AS_OF, by_user=True)


@query(f"WITH {USAGE_SQL} SELECT strftime(created_at, '%Y-%m') AS bucket, model, {_SUMS} FROM usage GROUP BY 1, 2")
def usage_month(spark, d):
    return U.buckets(usage(spark, d), "all")


@query(f"WITH {USAGE_SQL} SELECT source, {_SUMS} FROM usage GROUP BY 1")
def usage_by_source(spark, d):
    return U.by_source(usage(spark, d))


@query(f"""WITH {USAGE_SQL}, k AS (SELECT api_key_id, {_SUMS}, max(created_at) AS last_used FROM usage WHERE api_key_id IS NOT NULL GROUP BY 1)
    SELECT *, (SELECT count(*) FROM k) > 200 AS truncated FROM k ORDER BY total_tokens DESC, api_key_id LIMIT 200""")
def usage_by_key_top(spark, d):
    return U.top_keys(usage(spark, d))


@query(f"WITH {USAGE_SQL} SELECT coalesce(source, 'all') AS source, {_SUMS} FROM usage GROUP BY ROLLUP (source)")
def usage_grand_total(spark, d):
    return U.grand_total(usage(spark, d))


_RULES_SQL = """rules AS (SELECT u.user_id || '/' || m.model AS rule_id, u.user_id, m.model, 50 AS max_requests, 2000 AS max_total_tokens, 172800 AS window_seconds
    FROM (SELECT DISTINCT user_id FROM usage) u, (VALUES (''), ('click')) AS m(model))"""


def _rules(spark, d):
    kinds = F.explode(F.array(F.lit(""), F.lit("click"))).alias("model")
    return usage(spark, d).select("user_id").distinct().select("user_id", kinds).select(
        F.concat_ws("/", "user_id", "model").alias("rule_id"), "user_id", "model", F.lit(50).alias("max_requests"), F.lit(2000).alias("max_total_tokens"), F.lit(172800).alias("window_seconds"))


_STATUS_SQL = f"""{_RULES_SQL}, status AS (
    SELECT r.*, count(u.user_id) AS requests, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens FROM rules r LEFT JOIN usage u
    ON u.user_id = r.user_id AND (r.model = '' OR r.model = u.model) AND created_at <= TIMESTAMP '{AS_OF}' AND epoch(TIMESTAMP '{AS_OF}') - floor(epoch(created_at)) < window_seconds
    GROUP BY ALL)"""


@query(f"WITH {USAGE_SQL}, {_STATUS_SQL} SELECT *, requests >= max_requests OR tokens >= max_total_tokens AS exceeded FROM status")
def quota_status(spark, d):
    return U.quota_status(usage(spark, d), _rules(spark, d), AS_OF)


_DAILY_SQL = "daily AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', created_at)) AS idx, CAST(sum(total_tokens) AS BIGINT) AS value FROM usage GROUP BY 1)"


@query(f"""WITH {USAGE_SQL}, {_DAILY_SQL}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(idx) AS DOUBLE) AS sx, CAST(sum(value) AS DOUBLE) AS sy, CAST(sum(idx * value) AS DOUBLE) AS sxy, CAST(sum(idx * idx) AS DOUBLE) AS sxx FROM daily),
    f AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM s)
    SELECT CAST(n + i AS BIGINT) AS idx, CAST(greatest(0, floor(slope * (n + i) + (sy - slope * sx) / n + 0.5)) AS BIGINT) AS projected FROM f, range(0, 7) AS t(i)""")
def usage_forecast(spark, d):
    day = F.date_diff(F.to_date("created_at"), F.lit("2024-01-01").cast("date")).cast("long")
    return U.forecast(usage(spark, d).groupBy(day.alias("idx")).agg(F.sum("total_tokens").alias("value")), 7)


@query(f"""WITH {USAGE_SQL}, {_STATUS_SQL}, rate AS (SELECT user_id, sum(total_tokens) / 720.0 AS rate FROM usage GROUP BY 1), e AS (
    SELECT status.*, requests >= max_requests OR tokens >= max_total_tokens AS exceeded, rate, CASE WHEN rate > 0 THEN round(greatest(0, max_total_tokens - tokens) / rate, 4) END AS hours_left FROM status LEFT JOIN rate USING (user_id))
    SELECT *, coalesce(hours_left < 24, false) AS before_reset FROM e""")
def quota_eta(spark, d):
    rate = usage(spark, d).groupBy("user_id").agg((F.sum("total_tokens") / F.lit(720.0)).alias("rate"))
    return U.quota_eta(U.quota_status(usage(spark, d), _rules(spark, d), AS_OF), rate, 24)


# --- vectors -----------------------------------------------------------------------------------------------------

_PROBE = [((i * 7) % 13 - 6) / 8 for i in range(64)]
_PROBE_SQL = f"[{', '.join(map(str, _PROBE))}]::DOUBLE[]"
_COS = "list_sum(list_transform(list_zip(embedding, p), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(p, lambda x: x * x))))"
_SIM_SQL = f"sims AS (SELECT vec_id, label, round({_COS}, 9) AS similarity FROM (SELECT vec_id, label, embedding, {_PROBE_SQL} AS p FROM embeddings))"


def _store(spark, d):
    return table(spark, d, "embeddings").select(F.col("embedding").alias("key"), F.col("vec_id").alias("value"), "label")


_UNIT_SQL = f"u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS e FROM embeddings)"
#: Every vector whose id is divisible by 50 asks, all are searched.
_PAIR_SQL = f"""{_UNIT_SQL}, pairs AS (SELECT q.vec_id AS query, q.label AS query_label, s.vec_id AS value, round(list_sum(list_transform(list_zip(q.e, s.e), lambda x: x[1] * x[2])), 9) AS similarity
    FROM u q, u s WHERE q.vec_id % 50 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, value) AS place FROM pairs),
    best AS (SELECT query, any_value(query_label) AS query_label, max(similarity) AS similarity FROM pairs WHERE query <> value GROUP BY 1)"""


def _asking(spark, d):
    return _store(spark, d).where("value % 50 = 0")


@query(f"WITH {_SIM_SQL} SELECT vec_id AS value, similarity FROM sims ORDER BY similarity DESC, vec_id LIMIT 10")
def vector_topk_nonunit(spark, d):
    """A single probe's top k."""
    return V.top_k(_store(spark, d), _PROBE, 10).select("value", F.round("similarity", 9).alias("similarity"))


@query(f"WITH {_PAIR_SQL} SELECT query, value, similarity, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 10")
def vector_topk(spark, d):
    return V.search(_store(spark, d), _asking(spark, d), 10)


@query("SELECT vec_id AS value, label FROM embeddings WHERE vec_id IN (3, 5, 8)")
def vector_get(spark, d):
    return V.get(_store(spark, d), _store(spark, d).where("value IN (3, 5, 8)")).select("value", "label")


@query("SELECT label, count(*) AS total FROM embeddings WHERE label <> 4 GROUP BY 1")
def vector_delete(spark, d):
    return V.delete(_store(spark, d), _store(spark, d).where("label = 4")).groupBy("label").agg(F.count("*").alias("total"))


@query("SELECT vec_id AS value, CASE WHEN label = 2 THEN 99 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, d):
    old = _store(spark, d).withColumn("seq", F.lit(0))
    return V.upsert(old, old.where("label = 2").withColumns({"label": F.lit(99), "seq": F.lit(1)})).select("value", "label")


@query(f"""WITH {_PAIR_SQL} SELECT query, value, round(1 - similarity, 9) AS distance, 1 - similarity <= 0.8 AS matched, round(least(100.0, greatest(0.0, (1 - (1 - similarity) / 0.8) * 100)), 4) AS confidence
    FROM ranked WHERE place <= 5""")
def vector_identify(spark, d):
    found = V.identify(_store(spark, d), _asking(spark, d), threshold=0.8)
    return found.select("query", "value", F.round("distance", 9).alias("distance"), "matched", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_PAIR_SQL} SELECT CAST(least(9, greatest(0, floor(similarity * 10))) AS INTEGER) AS bin, count(*) AS total FROM best GROUP BY 1")
def cache_hit_histogram(spark, d):
    return V.similarity_histogram(V.search(_store(spark, d), _asking(spark, d), 1, not_self=True))


def _lookups(spark, d):
    return V.cache_lookup(_store(spark, d), _asking(spark, d).withColumn("confidence", F.col("label") / 10), 0.4, 0.3, 0.6, not_self=True)


@query(f"""WITH {_PAIR_SQL} SELECT query, similarity, CASE WHEN similarity >= 0.4 THEN 'hit' WHEN similarity >= 0.3 THEN 'near_miss' ELSE 'miss' END AS outcome,
    similarity < 0.4 AND query_label / 10 >= 0.6 AS to_store FROM best""")
def cache_lookup(spark, d):
    return _lookups(spark, d).select("query", "similarity", "outcome", "to_store")


@query(f"""WITH {_PAIR_SQL} SELECT count(*) FILTER (WHERE similarity >= 0.4) AS hits, count(*) FILTER (WHERE similarity < 0.4 AND similarity >= 0.3) AS near_misses, count(*) FILTER (WHERE similarity < 0.4) AS misses,
    count(*) FILTER (WHERE similarity < 0.4 AND query_label < 6) AS low_confidence FROM best""")
def cache_counters(spark, d):
    asked = _asking(spark, d).select(F.col("value").alias("query"), (F.col("label") / 10).alias("confidence"))
    return V.cache_counters(V.search(_store(spark, d), _asking(spark, d), 1, not_self=True).join(asked, "query"), 0.4, 0.3, 0.6)


# --- text --------------------------------------------------------------------------------------------------------

_EMAIL_SQL = X.EMAIL.replace("'", "''")


@query(f"""SELECT lang, CAST(sum(len(regexp_extract_all(text, '{_EMAIL_SQL}'))) AS BIGINT) AS emails, CAST(sum(len(regexp_extract_all(text, '{X.IPV4}'))) AS BIGINT) AS ips, CAST(sum(len(regexp_extract_all(text, '{X.SECRET_PATTERNS["aws_access_key"]}'))) AS BIGINT) AS aws_keys
    FROM documents GROUP BY 1""")
def pii_match_counts(spark, d):
    n = lambda p: F.sum(F.size(X.find_all(F.col("text"), p)).cast("long"))
    return table(spark, d, "documents").groupBy("lang").agg(n(X.EMAIL).alias("emails"), n(X.IPV4).alias("ips"), n(X.SECRET_PATTERNS["aws_access_key"]).alias("aws_keys"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL_SQL}', '[REDACTED:pattern:EMAIL]', 'g')) AS digest FROM documents")
def pii_redact_email(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.redact(F.col("text"), {"EMAIL": X.EMAIL})).alias("digest"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{X.IPV4}', '[REDACTED:pattern:IP]', 'g')) AS digest FROM documents")
def pii_redact_ip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.redact(F.col("text"), {"IP": X.IPV4})).alias("digest"))


@query(f"SELECT doc_id, left(sha256(m), 8) AS prefix FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL_SQL}')) AS m FROM documents)")
def pii_hash_prefix(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(X.find_all(F.col("text"), X.EMAIL)).alias("m"))
    return found.select("doc_id", X.hash_prefix(F.col("m")).alias("prefix"))


@query("""SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN c_name WHEN length(regexp_replace(c_name, '[^0-9]', '', 'g')) >= 8 THEN left(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) || repeat('*', length(regexp_replace(c_name, '[^0-9]', '', 'g')) - 6) || right(regexp_replace(c_name, '[^0-9]', '', 'g'), 2)
    ELSE left(c_name, 2) || '***' || right(c_name, 2) END AS masked FROM customer""")
def mask_target(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.mask_target(F.col("c_name")).alias("masked"))


@query("""WITH s AS (SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'license', ''))) / 7 + (length(lower(text)) - length(replace(lower(text), 'public', ''))) / 6 AS INTEGER) AS score FROM documents)
    SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def lexical_topk(spark, d):
    scored = table(spark, d, "documents").select("doc_id", X.lexical_score(F.col("text"), "about the public license").alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def name_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normalise_name(F.col("p_type")).alias("name"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'r.*g.*t') OR regexp_matches(lower(p_brand), 'r.*g.*t')")
def fuzzy_search(spark, d):
    return N.search(table(spark, d, "part"), "rgt", ["p_name", "p_brand"]).select("p_partkey", "p_name")


def _matches_sql(pattern: str, action: str, grp: str, weight: int) -> str:
    return f"SELECT doc_id, '{action}' AS action, '{grp}' AS grp, {weight} AS w, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM documents"


@query(f"""WITH m AS ({_matches_sql(_EMAIL_SQL, "mask", "EMAIL", 2)} UNION ALL {_matches_sql(r"[0-9]+\.[0-9.]+", "allow", "NUMBER", 1)} UNION ALL {_matches_sql(X.IPV4, "block", "IP", 3)}),
    s AS (SELECT doc_id, action, grp, w, 1 + list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a, length(ms[i]) AS n
        FROM m, unnest(range(1, len(ms) + 1)) AS t(i)),
    o AS (SELECT *, CASE WHEN a < max(a + n) OVER (PARTITION BY doc_id ORDER BY a, w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM s),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY a, w DESC ROWS UNBOUNDED PRECEDING) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY a, w DESC) AS r FROM o),
    x AS (SELECT doc_id, k, CAST(min(a) AS BIGINT) AS a, CAST(max(a + n) AS BIGINT) AS b, arg_max(action, (w, -r)) AS action, arg_max(grp, (w, -r)) AS grp FROM g GROUP BY 1, 2)
    SELECT doc_id, CAST(to_json(list({{'start': a, 'end': b, 'action': action, 'grp': grp}} ORDER BY a)) AS VARCHAR) AS spans FROM x GROUP BY 1""")
def span_overlap_merge(spark, d):
    """Pattern hits of each document as spans, merged where they overlap."""
    docs = table(spark, d, "documents")
    hits = lambda p, action, grp: F.transform(X.find_places(F.col("text"), p), lambda m: F.struct(m["start"], m["end"], F.lit(action).alias("action"), F.lit(grp).alias("grp")))
    spans = F.concat(hits(X.EMAIL, "mask", "EMAIL"), hits(r"[0-9]+\.[0-9.]+", "allow", "NUMBER"), hits(X.IPV4, "block", "IP"))
    return docs.select("doc_id", F.to_json(X.merged_spans(spans)).alias("spans")).where("spans <> '[]'")


# --- routing and prefixes ----------------------------------------------------------------------------------------


def _scores(spark, d):
    """The first four numbers of an embedding as the scores of four labels."""
    return table(spark, d, "embeddings").select("vec_id", F.array(*map(F.lit, "abcd")).alias("labels"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 10).alias("scores"))


_SOFT_SQL = """e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * 10) AS s FROM embeddings), p AS (SELECT vec_id, list_transform(s, lambda x: exp(x - list_max(s))) AS q FROM e),
    soft AS (SELECT vec_id, list_transform(q, lambda x: x / list_sum(q)) AS shares FROM p)"""


@query(f"WITH {_SOFT_SQL} SELECT vec_id, round(shares[1], 6) AS a, round(shares[2], 6) AS b, round(shares[3], 6) AS c, round(shares[4], 6) AS d FROM soft")
def softmax_labels(spark, d):
    s = _scores(spark, d).select("vec_id", G.softmax(F.col("scores")).alias("s"))
    return s.select("vec_id", *[F.round(F.col("s")[i], 6).alias(n) for i, n in enumerate("abcd")])


_ACTIVE_SQL = f"""{_SOFT_SQL}, act AS (SELECT vec_id, CASE WHEN list_max(shares) >= 0.3 THEN list_transform(list_filter(list_zip(['a', 'b', 'c', 'd'], shares), lambda x: x[2] >= 0.3), lambda x: x[1])
    ELSE [['a', 'b', 'c', 'd'][list_position(shares, list_max(shares))]] END AS active FROM soft)"""


def _active(spark, d):
    return _scores(spark, d).select(F.col("vec_id").alias("id"), G.active_labels(F.col("labels"), G.softmax(F.col("scores")), 0.3).alias("active"))


@query(f"WITH {_ACTIVE_SQL} SELECT vec_id AS id, array_to_string(active, '+') AS active FROM act")
def activate_threshold(spark, d):
    return _active(spark, d).select("id", F.array_join("active", "+").alias("active"))


@query(f"""WITH {_ACTIVE_SQL}, c AS (SELECT * FROM (VALUES ('small', 1, ['a', 'b']), ('mid', 2, ['a', 'b', 'c']), ('large', 3, ['a', 'b', 'c', 'd'])) AS t(model, ordinal, labels))
    SELECT vec_id AS id, array_to_string(list_sort(active), '+') AS active, (SELECT arg_min(model, ordinal) FROM c WHERE list_has_all(labels, active)) AS model FROM act""")
def set_cover_candidate(spark, d):
    candidates = spark.createDataFrame([("small", 1, ["a", "b"]), ("mid", 2, ["a", "b", "c"]), ("large", 3, list("abcd"))], "model string, ordinal int, labels array<string>")
    return G.covering_candidate(_active(spark, d), candidates).withColumn("active", F.array_join("active", "+"))


@query(f"WITH {_SOFT_SQL} SELECT ['a', 'b', 'c', 'd'][list_position(shares, list_max(shares))] AS label, count(*) AS total FROM soft GROUP BY 1")
def score_top1(spark, d):
    s = _scores(spark, d)
    return s.groupBy(F.element_at("labels", F.array_position("scores", F.array_max("scores")).cast("int")).alias("label")).agg(F.count("*").alias("total"))


_CHAIN_SQL = """WITH RECURSIVE b AS (SELECT doc_id, lang, hex(encode(coalesce(text, ''))) AS x FROM documents), chain AS (
    SELECT doc_id, lang, x, (length(x) + 511) // 512 AS n, 0 AS depth, md5(lang) AS hash FROM b
    UNION ALL SELECT doc_id, lang, x, n, depth + 1, md5(hash || substr(x, depth * 512 + 1, 512)) FROM chain WHERE depth < n)"""


@query(f"""{_CHAIN_SQL}, hit AS (SELECT q.doc_id, q.depth, max(s.doc_id) AS replica FROM chain q JOIN chain s ON s.lang = q.lang AND s.hash = q.hash AND s.depth > 0 AND s.doc_id <> q.doc_id
        WHERE q.depth > 0 AND q.doc_id % 50 = 0 GROUP BY 1, 2)
    SELECT b.doc_id AS id, CAST(arg_max(replica, depth) AS BIGINT) AS replica, CAST(coalesce(max(depth), 0) AS INTEGER) AS depth FROM b LEFT JOIN hit USING (doc_id) WHERE b.doc_id % 50 = 0 GROUP BY 1""")
def prefix_longest_match(spark, d):
    """Every document whose id is divisible by 50 asks, over its whole text; all are stored, itself left out."""
    chains = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("model"), P.block_chain(F.col("text"), F.col("lang"), most=None).alias("chain"))
    stored = chains.select("model", "chain", F.col("id").alias("replica"), F.col("id").alias("last_seen"))
    return P.longest_match(chains.where("id % 50 = 0"), stored, not_self=True)


@query("""SELECT replica, round(sum(pow(0.5, age / 43200.0)), 6) AS weight, count(*) AS entries FROM (SELECT event_type AS replica, CAST(epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) AS BIGINT) AS age FROM events)
    WHERE age >= 0 AND age <= 172800 GROUP BY 1""")
def decayed_weight(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("replica"), F.col("ts").alias("last_seen"))
    return P.decayed_weight(e, AS_OF, 43200.0, 172800.0).withColumn("weight", F.round("weight", 6))


@query("""WITH t AS (SELECT user_id AS key, arg_max(event_type, (ts, event_type)) AS replica, max(ts) AS last_seen FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT * FROM t WHERE epoch(TIMESTAMP '2024-01-20') - floor(epoch(last_seen)) <= 7200""")
def ttl_live_entries(spark, d):
    e = table(spark, d, "events").where("ts <= timestamp_ntz'2024-01-20'").select(F.col("user_id").alias("key"), F.col("event_type").alias("replica"), F.col("ts").alias("last_seen"))
    return P.live_entries(e, AS_OF, 7200)


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS pressure FROM events""")
def rolling_pressure(spark, d):
    return P.rolling_pressure(table(spark, d, "events"), "user_id", "ts", 86400)


@query("""WITH n AS (SELECT s_nationkey AS grp, s_suppkey AS node_id, s_suppkey % 7 AS in_flight, (s_suppkey % 10) / 10.0 AS match_ratio, s_acctbal AS weight FROM supplier),
    g AS (SELECT *, min(in_flight) OVER (PARTITION BY grp) AS low FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN in_flight <= low + 2 AND in_flight <= low * 1.5 + 1 THEN 0 ELSE 1 END, CASE WHEN match_ratio >= 0.3 THEN 0 ELSE 1 END,
        CASE WHEN match_ratio >= 0.3 THEN -match_ratio ELSE weight END, in_flight, node_id) AS k, max(in_flight) OVER (PARTITION BY grp) AS most_in_flight FROM g)
    SELECT grp, node_id, most_in_flight FROM r WHERE k = 1""")
def load_guard_select(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 7).alias("in_flight"), ((F.col("s_suppkey") % 10) / F.lit(10.0)).alias("match_ratio"), F.col("s_acctbal").alias("weight"))
    return G.least_loaded(n, "grp")


# --- streams (run as batches) ------------------------------------------------------------------------------------


@query(f"WITH {USAGE_SQL} SELECT date_trunc('hour', created_at) AS bucket, model, {_SUMS} FROM usage GROUP BY 1, 2")
def tumbling_usage(spark, d):
    return S.tumbling_usage(usage(spark, d))


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * i) AS window_start, event_type, count(*) AS total FROM events, range(0, 2) AS t(i) GROUP BY 1, 2""")
def hopping_counts(spark, d):
    return S.hopping_counts(table(spark, d, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, k""")
def session_gap(spark, d):
    return S.sessions(table(spark, d, "events"))


@query("SELECT user_id AS key, arg_max(CASE WHEN event_type <> 'error' THEN event_type END, event_id) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def replicated_map(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), F.col("event_type").alias("value"), "event_id")
    return S.latest_state(e, "key", "event_id")


# --- conversations -----------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, turn, role, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens FROM conversations), u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM t) SELECT conv_id, turn, role, tokens FROM u WHERE used <= 200 OR age = 1""")
def turn_trim(spark, d):
    return T.trimmed_turns(table(spark, d, "conversations"), 200)


@query("""WITH g AS (SELECT conv_id AS rec_id, role AS speaker, min(turn) AS first, count(*) AS segments, round(sum(length(text) / 10.0), 3) AS seconds FROM conversations GROUP BY 1, 2)
    SELECT rec_id, speaker, segments, seconds, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY first) AS INTEGER) AS number FROM g""")
def speaker_rollup(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("role").alias("speaker"), F.col("turn").alias("seq"), F.lit(0.0).alias("start"), (F.char_length("text") / F.lit(10.0)).alias("stop"))
    return T.speaker_totals(c)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, round(avg(value), 4) AS mean, max(value) FILTER (WHERE k = floor(0.5 * (n - 1) + 0.5)) AS p50, max(value) FILTER (WHERE k = floor(0.95 * (n - 1) + 0.5)) AS p95, count(*) AS n FROM r GROUP BY 1""")
def latency_summary(spark, d):
    return T.latency_summary(table(spark, d, "events"), "value", ["event_type"])


# --- registries and catalogues -----------------------------------------------------------------------------------

_NODES_SQL = """nodes AS (SELECT s_suppkey AS node_id, s_acctbal AS free_memory, s_acctbal > 0 AS healthy, CAST(s_suppkey % 5 + 600 AS BIGINT) AS max_replicas, s_nationkey FROM supplier),
    replicas AS (SELECT l_suppkey AS node_id, l_orderkey * 8 + l_linenumber AS replica_id, CAST(l_quantity AS BIGINT) % 3 AS in_flight, l_shipdate AS last_used FROM lineitem)"""


def _nodes(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("free_memory"), (F.col("s_acctbal") > 0).alias("healthy"), (F.col("s_suppkey") % 5 + 600).alias("max_replicas"), "s_nationkey")


def _replicas(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_suppkey").alias("node_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("replica_id"), (F.col("l_quantity").cast("long") % 3).alias("in_flight"), F.col("l_shipdate").alias("last_used"))


@query(f"""WITH {_NODES_SQL} SELECT node_id, CAST(coalesce(l, 0) AS BIGINT) AS load FROM nodes LEFT JOIN (SELECT node_id, sum(in_flight) AS l FROM replicas GROUP BY 1) USING (node_id) ORDER BY load, free_memory DESC, node_id LIMIT 5""")
def node_least_loaded(spark, d):
    return N.least_in_flight(_nodes(spark, d), _replicas(spark, d), 5).select("node_id", "load")


@query("SELECT c_custkey AS node_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority < '3')")
def idle_antijoin(spark, d):
    """Customers as nodes, their pressing open orders as replicas: those without any."""
    busy = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority < '3'")
    return N.idle_nodes(table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), busy.select(F.col("o_custkey").alias("node_id")))


@query("SELECT o_orderpriority AS backend, count(*) AS pending, count(DISTINCT o_custkey) AS nodes FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def pending_by_backend(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return N.pending_by_backend(rows.select(F.col("o_orderpriority").alias("backend"), F.col("o_custkey").alias("node_id")))


@query("SELECT s_suppkey AS node_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1 AND s_acctbal > 0")
def selector_all(spark, d):
    nodes = _nodes(spark, d).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))  # 25 rows
    labels = nodes.select("node_id", F.explode(F.array(F.struct(F.lit("region").alias("label"), F.col("n_regionkey").cast("string").alias("label_value")), F.struct(F.lit("healthy").alias("label"), F.col("healthy").cast("string").alias("label_value")))).alias("x")).select("node_id", "x.*")
    return N.nodes_with_labels(_nodes(spark, d), labels, {"region": "1", "healthy": "true"}).select("node_id")


@query(f"""WITH {_NODES_SQL}, c AS (SELECT node_id, count(*) AS loaded FROM replicas GROUP BY 1) SELECT CAST(sum(greatest(0, max_replicas - coalesce(loaded, 0))) AS BIGINT) AS free_replicas,
    count(*) FILTER (WHERE coalesce(loaded, 0) < max_replicas) AS nodes_with_room FROM nodes LEFT JOIN c USING (node_id)""")
def capacity_sum(spark, d):
    return N.free_capacity(_nodes(spark, d), _replicas(spark, d))


@query(f"WITH {_NODES_SQL} SELECT node_id, replica_id, last_used FROM replicas JOIN nodes USING (node_id) WHERE in_flight = 0 AND healthy ORDER BY last_used, node_id, replica_id LIMIT 1")
def lru_top1(spark, d):
    return N.least_recently_used(_nodes(spark, d), _replicas(spark, d)).select("node_id", "replica_id", "last_used")


@query(f"WITH {_NODES_SQL} SELECT node_id, replica_id, last_used FROM replicas WHERE in_flight = 0 AND last_used < TIMESTAMP '1999-01-01' ORDER BY replica_id DESC, last_used, node_id LIMIT 20")
def scale_down_victims(spark, d):
    return N.scale_down_victims(_replicas(spark, d), "1999-01-01", 20).select("node_id", "replica_id", "last_used")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_size & 3 = 3 ORDER BY p_brand, p_partkey LIMIT 25 OFFSET 25")
def catalogue_page(spark, d):
    items = N.with_usecases(table(spark, d, "part"), "p_size", 3)
    return N.page(items, ["p_brand", "p_partkey"], 2, 25).select("p_partkey", "p_name", "p_brand")


@query("SELECT DISTINCT unnest(string_split(p_type, ' ')) AS facet FROM part")
def facet_values(spark, d):
    return N.facets(table(spark, d, "part").withColumn("tags", F.split("p_type", " ")), "tags")


@query(f"WITH {CALLS_SQL} SELECT event_id, call_type, call_start_ts FROM calls WHERE call_type = 'ERROR' ORDER BY event_id DESC LIMIT 50")
def newest_log(spark, d):
    return N.newest(calls(spark, d), "event_id", 50, call_type="ERROR", direction="").select("event_id", "call_type", "call_start_ts")


# --- overviews ---------------------------------------------------------------------------------------------------


@query("SELECT json_keys[1] AS field, count(*) AS rows, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS numbers FROM (SELECT props, json_keys(props) AS json_keys FROM events) GROUP BY 1")
def schema_profile(spark, d):
    return O.schema_profile(table(spark, d, "events"), "props")


@query(f"WITH {USAGE_SQL} SELECT strftime(DATE '1970-01-01' + CAST((date_diff('day', DATE '1970-01-01', CAST(created_at AS DATE)) + 719162) // 30 * 30 - 719162 AS INTEGER), '%Y-%m') AS bucket, model, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS requests FROM usage GROUP BY 1, 2")
def usage_fixed_blocks(spark, d):
    return O.fixed_blocks(usage(spark, d))


@query(f"WITH {USAGE_SQL} SELECT model, {_SUMS} FROM usage GROUP BY 1")
def usage_rolled_by_model(spark, d):
    return O.rolled_buckets(U.buckets(usage(spark, d), "all"), "model")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), 8) AS rms FROM embeddings")
def signal_rms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(O.rms(F.col("embedding")), 8).alias("rms"))


@query(f"""WITH {_NODES_SQL} SELECT node_id, replica_id, in_flight FROM replicas JOIN nodes USING (node_id) ORDER BY CASE WHEN node_id = 3 AND replica_id = (SELECT max(replica_id) FROM replicas WHERE node_id = 3) THEN 0 ELSE 1 END, in_flight, last_used, free_memory DESC, node_id, replica_id LIMIT 1""")
def preferred_replica(spark, d):
    """The replica asked for, which is there: the last one of node 3, that no other order would pick."""
    both = _replicas(spark, d).join(_nodes(spark, d).select("node_id", "free_memory"), "node_id")
    wanted = both.where("node_id = 3").agg(F.max("replica_id")).first()[0]
    return O.preferred_replica(both, 3, wanted).select("node_id", "replica_id", "in_flight")


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY 2")
def citation_per_source(spark, d):
    return O.first_of_each(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""SELECT d.doc_id AS evidence_id, lang, quality, item_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def evidence_list(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), "lang")
    jobs = table(spark, d, "labels").select(F.col("doc_id").alias("evidence_id"), "quality")
    return O.evidence_list(items, jobs, table(spark, d, "benchmark").select(F.col("item_id").alias("evidence_id"), "item_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND (text ILIKE '%license%' OR source ILIKE '%license%')")
def evidence_search(spark, d):
    return O.evidence_search(table(spark, d, "documents"), "license", ("text", "source"), lang="en", source="").select("doc_id")


@query("SELECT doc_id, coalesce(quality, 1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def enriched_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(None).cast("int").alias("quality"))
    return O.enriched(docs, table(spark, d, "labels"), ["doc_id"], ["quality"]).withColumn("quality", F.coalesce("quality", F.lit(1)))


# --- what Spark adds (not part of the record templates) ----------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS total, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extension_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("total"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""SELECT event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts) AS last_purchase FROM events e WHERE event_type = 'error'""")
def extension_asof(spark, d):
    """The last purchase before each error of a user: an as-of join as one window over both."""
    e = table(spark, d, "events").where("event_type IN ('error', 'purchase')").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    return e.withColumn("last_purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)).where("event_type = 'error'").select("event_id", "last_purchase")
