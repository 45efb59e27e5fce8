"""Queries over readers' and ingest's own work: times, identifiers, payloads, retention, logs and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import calls as C
from corvane.operators import ingest as I
from corvane.operators import overview as O
from corvane.operators import prefix as P
from corvane.operators import registry_ops as N
from corvane.operators import usage as U
from corvane.plans.book import Book
from corvane.sources import readers as R
from corvane.sources.buckets import BucketTable
from corvane.sources.views import CALLS_SQL, ENTITIES_SQL, USAGE_SQL, calls, entities, table, usage
from corvane.sources.work import work_path
from corvane.streaming import windows as S
from corvane.streaming.prefixes import PrefixIndex
from corvane.streaming.replay import EventLog
from corvane.streaming.stores import call_stores, hashed_calls

_book = Book()
query = _book.add
QUERIES, ORACLE_SQL = _book.queries, _book.sql
_SUMS = "CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS requests"


@query(f"WITH {USAGE_SQL} SELECT user_id, source, {_SUMS} FROM usage GROUP BY 1, 2")
def usage_by_user_source(spark, d):
    return U.by_user_source(usage(spark, d))


def _dates(spark, d, layout: str, order: str):
    text = F.date_format("o_orderdate", layout)
    return table(spark, d, "orders").select("o_orderkey", I.parse_time(text, order).cast("timestamp_ntz").alias("parsed"))


@query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS parsed FROM orders")
def times_day_first(spark, d):
    return _dates(spark, d, "dd/MM/yyyy", "day")


@query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS parsed FROM orders")
def times_month_first(spark, d):
    return _dates(spark, d, "MM/dd/yyyy HH:mm", "month")


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS cleaned FROM lineitem")
def identifier_clean(spark, d):
    spoilt = F.concat(F.lit(" "), F.col("l_quantity").cast("long").cast("string"), F.lit(".0 "))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.clean_identifier(spoilt).alias("cleaned"))


def _raw_calls(spark, d):
    """Calls as a file would have them: text, some without a start, some with a bad number."""
    c = calls(spark, d)
    start = F.when(F.col("event_id") % 11 != 0, F.date_format("call_start_ts", "dd/MM/yyyy HH:mm:ss"))
    return c.select(
        "row_number", F.concat("msisdn", F.lit(".0")).alias("a"), "call_dialed_num", start.alias("s"), F.date_format(F.col("call_start_ts").cast("timestamp") + F.expr("INTERVAL 90 SECONDS"), "yyyy-MM-dd HH:mm:ss").alias("e"),
        F.lower("direction").alias("dir"), F.lower("call_type").alias("t"), F.when(F.col("event_id") % 13 == 0, "north").otherwise("1.5").alias("lat"))


_ALIASES = {"msisdn": "a", "call_dialed_num": "call_dialed_num", "call_start_ts": "s", "call_end_ts": "e", "direction": "dir", "call_type": "t", "latitude": "lat"}


@query(f"""WITH {CALLS_SQL} SELECT row_number, msisdn, date_trunc('second', call_start_ts) AS call_start_ts, CAST(90 AS BIGINT) AS duration_seconds, direction, call_type, 1.5::DOUBLE AS latitude
    FROM calls WHERE event_id % 11 <> 0 AND event_id % 13 <> 0""")
def calls_normalised(spark, d):
    good, _ = I.quarantine(I.normalise_calls(_raw_calls(spark, d), _ALIASES))
    return good.select("row_number", "msisdn", F.col("call_start_ts").cast("timestamp_ntz").alias("call_start_ts"), "duration_seconds", "direction", "call_type", "latitude")


@query("SELECT CASE WHEN event_id % 11 = 0 THEN 'missing_start' ELSE 'bad_number' END AS error, count(*) AS total FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 GROUP BY 1")
def calls_rejected(spark, d):
    _, bad = I.quarantine(I.normalise_calls(_raw_calls(spark, d), _ALIASES))
    return bad.groupBy(F.col("_error").alias("error")).agg(F.count("*").alias("total"))


@query(f"WITH {CALLS_SQL} SELECT record_type, row_number, primary_entity, secondary_entity FROM (SELECT 'cdr' AS record_type, row_number, msisdn AS primary_entity, call_dialed_num AS secondary_entity FROM calls)")
def calls_canonical(spark, d):
    c = calls(spark, d).withColumn("call_org_num", F.lit(None).cast("string"))
    return I.canonicalise_calls(c, F.lit("2024-01-01").cast("timestamp_ntz")).select("record_type", "row_number", "primary_entity", "secondary_entity")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, '1' AS seen, CAST(event_id % 2 AS VARCHAR) AS odd FROM events")
def payload_merge(spark, d):
    more = F.to_json(F.struct(F.lit(1).alias("seen"), (F.col("event_id") % 2).alias("odd")))
    merged = I.merged_json(F.col("props"), more)
    return table(spark, d, "events").select("event_id", *[F.get_json_object(merged, f"$.{k}").alias(k) for k in ("k", "seen", "odd")])


@query("SELECT conv_id, turn, CAST(json_array_length(l) AS INTEGER) AS entries, json_extract_string(l, '$[1].m') AS last FROM (SELECT *, json_array(role, json_object('m', coalesce(text, ''))) AS l FROM conversations)")
def log_append(spark, d):
    log = I.appended_json(F.to_json(F.array("role")), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("m"))))
    return table(spark, d, "conversations").select("conv_id", "turn", F.json_array_length(log).alias("entries"), F.get_json_object(log, "$[1].m").alias("last"))


@query("""SELECT o_custkey AS custkey, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS seq, arg_min(o_orderdate, o_orderkey) AS first_date,
    (SELECT string_agg(p || '=' || k, ',' ORDER BY p) FROM (SELECT o_orderpriority AS p, max(o_orderkey) AS k FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY 1)) AS report FROM orders o GROUP BY 1""")
def upsert_bucketed(spark, d):
    """Orders put into a table of customers in three upserts, as they came: the latest status, the first date, all members of the reports."""
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("first_date"), F.to_json(F.create_map("o_orderpriority", "o_orderkey")).alias("report"))
    third = max(1, (rows.agg(F.max("seq")).first()[0] or 0) // 3)
    stored = BucketTable(spark, work_path(spark, "upsert"), ["custkey"], "seq", ("first_date",), ("report",), buckets=16)
    for part in range(3):
        stored.upsert(rows.where(F.least(F.floor(F.col("seq") / third), F.lit(2)) == part))
    report = F.array_join(F.array_sort(F.transform(F.map_entries(F.from_json("report", "map<string,string>")), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return stored.read().withColumn("report", report)


@query(f"""WITH {CALLS_SQL}, good AS (SELECT * FROM calls WHERE event_id % 11 <> 0) SELECT 'typed' AS store, call_type AS kind, count(*) AS total FROM good GROUP BY 2
    UNION ALL SELECT 'records', 'cdr', count(*) FROM good UNION ALL SELECT 'entities', 'phone', count(*) FROM good WHERE msisdn <> '' UNION ALL SELECT 'entities', 'dialed', count(*) FROM good WHERE call_dialed_num <> ''
    UNION ALL SELECT 'rejected', 'missing_start', count(*) FROM calls WHERE event_id % 11 = 0""")
def ingest_three_stores(spark, d):
    """Calls in two batches that overlap, the first sent twice, into typed, canonical and entity stores."""
    rows = hashed_calls(calls(spark, d).withColumns({"call_org_num": F.lit(None).cast("string"), "_error": F.when(F.col("event_id") % 11 == 0, "missing_start")}))
    stores = call_stores(spark, work_path(spark, "stores"), {"phone": "msisdn", "dialed": "call_dialed_num"}, buckets=16)
    even = rows.where("event_id % 2 = 0")
    stores.write(even, 0)
    stores.write(even, 0)
    stores.write(rows.where("event_id % 2 = 1 OR event_id % 20 = 0"), 1)
    counted = lambda store, kind, total=F.count("*"): stores.read(store).groupBy(F.lit(store).alias("store"), kind.alias("kind")).agg(total.alias("total"))
    rejected = counted("rejected", F.col("_error"), F.count_distinct("row_number"))
    return counted("typed", F.col("call_type")).unionAll(counted("records", F.col("record_type"))).unionAll(counted("entities", F.col("entity_type"))).unionAll(rejected)


@query("""WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
    b AS (SELECT a.event_id, a.user_id, a.t, greatest(a.t - 86400, coalesce(max(r.t), -1)) AS since FROM e a LEFT JOIN e r ON r.user_id = a.user_id AND r.event_type = 'purchase' AND r.t <= a.t WHERE a.event_type <> 'purchase' GROUP BY 1, 2, 3)
    SELECT b.event_id, b.user_id, count(*) AS pressure FROM b JOIN e s ON s.user_id = b.user_id AND s.event_type <> 'purchase' AND s.t BETWEEN b.since AND b.t GROUP BY 1, 2""")
def pressure_with_reset(spark, d):
    """Events of each user in the last day, since the user's last purchase."""
    return P.rolling_pressure(table(spark, d, "events"), "user_id", "ts", 86400, reset=F.col("event_type") == "purchase")


@query("""WITH g AS (SELECT event_type AS model, user_id % 10 AS node, CASE WHEN event_id % 170 = 0 THEN -1 ELSE user_id % 3 END AS replica, max(event_id) AS gone FROM events WHERE event_id % 50 = 0 OR event_id % 170 = 0 GROUP BY ALL),
    s AS (SELECT event_type AS model, user_id % 10 AS node, user_id % 3 AS replica, json_extract_string(props, '$.k') AS k, max(event_id) AS seq FROM events WHERE event_id % 50 <> 0 AND event_id % 170 <> 0 GROUP BY ALL)
    SELECT model, 'n' || node AS node, count(*) AS total, CAST(sum(seq) AS BIGINT) AS seqs FROM s WHERE seq > coalesce((SELECT gone FROM g WHERE g.model = s.model AND g.node = s.node AND g.replica = s.replica), -1)
    AND seq > coalesce((SELECT gone FROM g WHERE g.model = s.model AND g.node = s.node AND g.replica = -1), -1) GROUP BY 1, 2""")
def prefix_log_live(spark, d):
    """Events as a log of prefix observations, in which replicas and whole nodes are invalidated, folded into a table in two batches, out of order."""
    gone = F.col("event_id") % 170 == 0
    log = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.when(gone | (F.col("event_id") % 50 == 0), "invalidate").otherwise("observe").alias("op"), F.col("event_type").alias("model"), F.array(F.xxhash64(F.get_json_object("props", "$.k"))).alias("chain"),
        F.concat(F.lit("n"), (F.col("user_id") % 10).cast("string")).alias("node"), F.when(gone, -1).otherwise(F.col("user_id") % 3).cast("int").alias("replica"))
    index = PrefixIndex(spark, work_path(spark, "prefixes"), buckets=16)
    for part in (1, 0):
        index.fold(log.where(F.col("seq") % 2 == part))
    return index.live().groupBy("model", "node").agg(F.count("*").alias("total"), F.sum("seq").alias("seqs"))


@query("""WITH l AS (SELECT *, event_id // 1000 AS s FROM events), k AS (SELECT DISTINCT s FROM l ORDER BY s DESC LIMIT 2), g AS (SELECT max(event_id) AS dropped FROM l WHERE user_id = 7 AND s NOT IN (SELECT s FROM k))
    SELECT event_id AS seq, props AS payload FROM l WHERE user_id = 7 AND event_id > coalesce((SELECT dropped FROM g), -1)""")
def replay_after_eviction(spark, d):
    """A log of all users' events of which the latest two segments are kept; one user's, after the last that was taken away."""
    log = EventLog(spark, work_path(spark, "log"), segment=1000)
    log.append(table(spark, d, "events").select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("seq"), F.col("props").alias("payload")))
    log.evict(2)
    return log.after("7", log.dropped("7")).select("seq", "payload")


_TRIMMED = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {_TRIMMED.format('source')} AS source, md5({_TRIMMED.format('text')}) AS digest FROM documents")
def csv_quoted_lines(spark, d):
    """All documents as quoted CSV, line ends within fields, read back."""
    path = work_path(spark, "csv")
    table(spark, d, "documents").select("doc_id", "source", "text").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return R.read_delimited(spark, path).select(field("doc_id").cast("long").alias("doc_id"), field("source").alias("source"), F.md5(field("text")).alias("digest"))


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_type), ' '), 'promo')")
def tag_filter(spark, d):
    return N.with_tag(table(spark, d, "part").withColumn("tags", F.split("p_type", " ")), "tags", "Promo").select("p_partkey")


@query("SELECT event_type, count(*) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY GROUP BY 1")
def log_retention(spark, d):
    return N.retained(table(spark, d, "events"), "ts", "2024-01-20 00:00:00", 7).groupBy("event_type").agg(F.count("*").alias("total"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < DATE '1995-06-01' THEN 'failed' ELSE o_orderstatus END AS status FROM orders""")
def stuck_jobs(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    return N.reaped(jobs, "1995-06-01 00:00:00", 0, running="P").select("id", "status")


@query("""WITH g AS (SELECT event_type AS replica, max(ts) AS gone_at FROM events WHERE event_id % 50 = 0 GROUP BY 1)
    SELECT e.event_type AS replica, count(*) AS total FROM events e LEFT JOIN g ON g.replica = e.event_type WHERE gone_at IS NULL OR ts > gone_at GROUP BY 1""")
def invalidated_entries(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("replica"), F.col("ts").alias("last_seen"), "event_id")
    return P.invalidated(e, e.where("event_id % 50 = 0").select("replica", F.col("last_seen").alias("at"))).groupBy("replica").agg(F.count("*").alias("total"))


@query("SELECT event_id AS seq, props AS payload, (SELECT min(event_id) FROM events WHERE user_id = 7) > 101 AS lost FROM events WHERE user_id = 7 AND event_id > 100")
def replayed_events(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    return S.replayed(log, "7", 100).drop("stream")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview FROM documents")
def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", O.preview(F.col("text"), 80).alias("preview"))


@query(f"""WITH {ENTITIES_SQL} SELECT 'case ' || batch_id AS evidence_id, entity_type, count(*) AS total, count(DISTINCT entity_value) AS entities FROM entities WHERE batch_id IN ('b0', 'b1') AND entity_value <> '' GROUP BY 1, 2""")
def evidence_entities(spark, d):
    batches = spark.createDataFrame([("b0", "case b0"), ("b1", "case b1")], "batch_id string, evidence_id string")
    return O.evidence_entities(entities(spark, d), batches)


@query(f"WITH {CALLS_SQL} SELECT call_type, direction, count(*) AS total FROM calls WHERE call_type ILIKE 'click' OR msisdn = 'click' OR call_dialed_num = 'click' GROUP BY 1, 2")
def call_type_of_target(spark, d):
    return C.call_type_breakdown(calls(spark, d), "click").select("call_type", "direction", "total")


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{X.EMAIL.replace("'", "''")}', '[REDACTED:pattern:EMAIL]', 'g'), '{X.IPV4}', '[REDACTED:pattern:IP]', 'g')) AS digest FROM documents""")
def pii_redact_merged(spark, d):
    """All groups at once, overlapping spans merged by strength before they are replaced."""
    groups = {"EMAIL": (X.EMAIL, "block"), "IP": (X.IPV4, "mask")}
    return table(spark, d, "documents").select("doc_id", F.md5(X.redact_merged(F.col("text"), groups)).alias("digest"))


@query("""WITH s AS (SELECT 'cdr' AS record_type, unnest(['call_type', 'k', 'duration']) AS field, unnest([event_type, json_extract_string(props, '$.k'), CAST(value AS VARCHAR)]) AS v FROM events)
    SELECT record_type, field, count(*) AS rows FROM s WHERE v IS NOT NULL GROUP BY 1, 2""")
def record_schema(spark, d):
    from corvane.operators.records import schema_of

    fields = F.create_map(F.lit("call_type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("duration"), F.col("value").cast("string"))
    return schema_of(table(spark, d, "events").select(F.lit("cdr").alias("record_type"), fields.alias("fields")))


@query("""WITH c AS (SELECT unnest(['shipped', 'flag', 'price', 'note', 'mix']) AS field, unnest([strftime(l_shipdate, '%Y-%m-%d'), l_returnflag, CAST(l_extendedprice AS VARCHAR), '', CASE WHEN l_linenumber = 1 THEN 'x' ELSE '2' END]) AS v FROM lineitem),
    k AS (SELECT field, CASE WHEN v = '' THEN NULL WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'number' WHEN lower(v) IN ('true', 'false') THEN 'bool' WHEN try_strptime(v, '%Y-%m-%d') IS NOT NULL THEN 'time' ELSE 'string' END AS kind FROM c)
    SELECT field, CASE count(DISTINCT kind) WHEN 0 THEN 'empty' WHEN 1 THEN max(kind) ELSE 'mixed' END AS type, count(kind) AS non_empty FROM k GROUP BY 1""")
def inferred_types(spark, d):
    x = table(spark, d, "lineitem")
    fields = F.create_map(F.lit("shipped"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("flag"), F.col("l_returnflag"), F.lit("price"), F.format_number("l_extendedprice", 2), F.lit("note"), F.lit(""), F.lit("mix"), F.when(F.col("l_linenumber") == 1, "x").otherwise("2"))
    return R.infer_types(x.select(fields.alias("fields"), F.lit(None).cast("string").alias("_error"))).select("field", "type", "non_empty")


@query(f"""WITH {CALLS_SQL} SELECT count(*) AS total_rows, count(DISTINCT call_dialed_num) AS unique_targets, count(DISTINCT location) AS unique_locations, date_trunc('second', min(call_start_ts)) AS first_time,
    date_trunc('second', max(call_start_ts)) AS last_time, (SELECT string_agg(t || '=' || n, ',' ORDER BY t) FROM (SELECT call_type AS t, count(*) AS n FROM calls GROUP BY 1)) AS call_types FROM calls""")
def sample_profile(spark, d):
    fields = F.create_map(F.lit("to"), F.col("call_dialed_num"), F.lit("place"), F.col("location"), F.lit("kind"), F.lower("call_type"), F.lit("at"), F.date_format("call_start_ts", "dd/MM/yyyy HH:mm:ss"))
    found = R.sample_profile(calls(spark, d).select(fields.alias("fields")), "to", "place", "kind", "at")
    types = F.array_join(F.transform(F.map_entries("call_types"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("call_types")
    return found.select("total_rows", "unique_targets", "unique_locations", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_time", "last_time")], types)
