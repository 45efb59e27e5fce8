"""Queries over canonical records, ingest quality and records of inferred schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.predicates import in_scope, payload_filter, phone_match
from corvane.operators import evidence as V
from corvane.operators import ingest as I
from corvane.operators import records as R
from corvane.plans.book import Book
from corvane.sources.views import CALLS_SQL, GENERIC_SQL, JOBS_SQL, calls, generic, jobs, table
from corvane.sources.work import work_path

_book = Book()
query = _book.add
QUERIES, ORACLE_SQL = _book.queries, _book.sql


def _canonical(spark, d):
    """Events as canonical records with their payload as a text map."""
    c = calls(spark, d)
    payload = F.create_map(F.lit("Type"), F.col("call_type"), F.lit("k"), F.col("call_dialed_num"), F.lit("duration"), F.col("duration_seconds").cast("string"), F.lit("site"), F.col("cell_site_id"))
    return c.select("row_number", F.col("file_id").alias("source_file"), F.col("call_start_ts").alias("timestamp"), "msisdn", "location", payload.alias("payload"))


_PAGE = "row_number, file_id AS source_file, call_start_ts AS timestamp, msisdn, location"
_COLS = ["row_number", "source_file", "timestamp", "msisdn", "location"]


@query(f"WITH {CALLS_SQL} SELECT {_PAGE} FROM calls WHERE location = 'L2' ORDER BY call_start_ts DESC NULLS LAST, file_id, row_number LIMIT 50 OFFSET 25")
def canonical_page(spark, d):
    own = _canonical(spark, d).where("location = 'L2'")
    return own.select(*_COLS).orderBy(F.col("timestamp").desc_nulls_last(), "source_file", "row_number").offset(25).limit(50)


@query(f"WITH {CALLS_SQL} SELECT count(*) AS total_count FROM calls WHERE location = 'L2' AND call_start_ts >= TIMESTAMP '2024-01-05' AND call_start_ts < TIMESTAMP '2024-01-20'")
def canonical_total(spark, d):
    from corvane.functions.predicates import between

    return _canonical(spark, d).where((F.col("location") == "L2") & between("timestamp", "2024-01-05", "2024-01-20")).agg(F.count("*").alias("total_count"))


def _payload(name: str, op: str, value, sql: str):
    def run(spark, d):
        return _canonical(spark, d).where(payload_filter(F.col("payload"), name, op, value)).groupBy("source_file").agg(F.count("*").alias("total"), F.max("row_number").alias("last_row"))

    run.__name__ = f"payload_{op}" if op not in ("exists", "not_exists") else {"exists": "payload_exists", "not_exists": "payload_missing"}[op]
    if op == "gt":
        run.__name__ = "payload_numeric_gt"
    query(f"WITH {CALLS_SQL} SELECT file_id AS source_file, count(*) AS total, max(row_number) AS last_row FROM calls WHERE {sql} GROUP BY 1")(run)


_payload("type", "eq", "CLICK", "call_type = 'CLICK'")
_payload("type", "ne", "CLICK", "call_type <> 'CLICK'")
_payload("TYPE", "contains", "ic", "call_type ILIKE '%ic%'")
_payload("site", "in", ["C1", "C2"], "cell_site_id IN ('C1', 'C2')")
_payload("duration", "gt", 30, "duration_seconds > 30")
_payload("SITE", "exists", None, "true")
_payload("absent", "not_exists", None, "true")


@query(f"WITH {CALLS_SQL} SELECT count(*) AS total FROM calls WHERE regexp_replace('+92-' || imei, '[^0-9]', '', 'g') = '9235000007'")
def target_digits_match(spark, d):
    return calls(spark, d).where(phone_match(F.concat(F.lit("+92-"), "imei"), "92 35 000007")).agg(F.count("*").alias("total"))


@query(f"WITH {GENERIC_SQL} SELECT location, count(*) AS total FROM generic WHERE primary_entity ILIKE '%c-1_7%' GROUP BY 1")
def target_ilike(spark, d):
    return generic(spark, d).where(F.col("primary_entity").ilike("%c-1_7%")).groupBy("location").agg(F.count("*").alias("total"))


# --- ingest quality ----------------------------------------------------------------------------------------------


def _assets(spark, d):
    """Assets: the files of returned lines since 1996."""
    j = jobs(spark, d).where("record_type = 'R' AND file_id >= '1996'")
    return j.select("file_id", "record_type", F.when(F.col("accepted_rows") > 0, "ready").otherwise("pending").alias("structured_status"))


@query(f"""WITH {JOBS_SQL} SELECT record_type, count(*) AS jobs, CAST(sum(total_rows) AS BIGINT) AS total_rows, CAST(sum(accepted_rows) AS BIGINT) AS accepted_rows, CAST(sum(rejected_rows) AS BIGINT) AS rejected_rows,
    CAST(sum(duplicate_rows) AS BIGINT) AS duplicate_rows FROM jobs GROUP BY 1""")
def record_families(spark, d):
    return V.record_families(jobs(spark, d))


@query(f"""WITH {JOBS_SQL} SELECT CAST(coalesce(sum(total_rows), 0) AS BIGINT) AS total_rows, CAST(coalesce(sum(accepted_rows), 0) AS BIGINT) AS accepted_rows, CAST(coalesce(sum(rejected_rows), 0) AS BIGINT) AS rejected_rows,
    CAST(coalesce(sum(duplicate_rows), 0) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE status = 'completed') AS completed_jobs, count(*) FILTER (WHERE status IN ('failed', 'dead_letter')) AS failed_jobs FROM jobs""")
def data_quality_summary(spark, d):
    return V.quality_summary(jobs(spark, d))


@query(f"""WITH {JOBS_SQL}, j AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
        count(DISTINCT record_type) FILTER (WHERE accepted_rows > 0) AS families, sum(total_rows) AS t, sum(accepted_rows) AS acc, sum(rejected_rows) AS rej, sum(duplicate_rows) AS dup FROM jobs),
    a AS (SELECT count(*) AS n_assets, count(*) FILTER (WHERE accepted_rows > 0) AS n_ready FROM jobs WHERE record_type = 'R' AND file_id >= '1996'),
    s AS (SELECT *, greatest(0, 100 - (CASE WHEN n = 0 THEN 35 ELSE 0 END + CASE WHEN families = 0 OR acc = 0 THEN 30 ELSE 0 END + least(25, failed * 10)
        + CASE WHEN rej > 0 THEN 8 + least(22, floor(100 * rej / greatest(t, 1))) ELSE 0 END + CASE WHEN dup > 0 THEN 4 + least(16, floor(100 * dup / greatest(t, 1))) ELSE 0 END
        + CASE WHEN n_assets = 0 THEN 15 WHEN n_ready = 0 THEN 10 ELSE 0 END + CASE WHEN n > 0 AND completed = 0 THEN 20 ELSE 0 END)) AS score FROM j, a)
    SELECT CAST(score AS INTEGER) AS score, CASE WHEN score < 50 THEN 'blocked' WHEN score < 75 THEN 'needs_review' WHEN score < 90 THEN 'usable_with_limitations' ELSE 'ready' END AS level,
        n AS jobs, failed, families, n_assets, n_ready FROM s""")
def case_readiness(spark, d):
    return V.case_readiness(jobs(spark, d), _assets(spark, d))


@query(f"WITH {JOBS_SQL} SELECT j.* FROM jobs j WHERE status = 'completed' AND NOT EXISTS (SELECT 1 FROM jobs a WHERE a.record_type = 'R' AND a.file_id >= '1996' AND a.file_id = j.file_id)")
def missing_assets_anti(spark, d):
    return V.missing_assets(jobs(spark, d), _assets(spark, d), ["file_id"])


@query(f"""WITH {JOBS_SQL}, e AS (SELECT strftime(o_orderdate, '%Y-%m') AS file_id, o_orderkey AS row_number FROM orders WHERE o_totalprice < 2000)
    SELECT file_id, row_number, record_type, status FROM e LEFT JOIN jobs USING (file_id)""")
def errors_left_join(spark, d):
    errors = table(spark, d, "orders").where("o_totalprice < 2000").select(F.date_format("o_orderdate", "yyyy-MM").alias("file_id"), F.col("o_orderkey").alias("row_number"))
    return V.errors_with_jobs(errors, jobs(spark, d).select("file_id", "record_type", "status"), ["file_id"])


@query("""SELECT count(*) AS total, CAST(sum(n_chars) AS BIGINT) AS size, (SELECT string_agg(s || '=' || n, ',' ORDER BY s || '=' || n) FROM (SELECT coalesce(lang, 'unknown') AS s, count(*) AS n FROM documents GROUP BY 1)) AS by_status FROM documents""")
def evidence_status_map(spark, d):
    return V.status_summary(table(spark, d, "documents"), "lang", "n_chars")


@query(f"""WITH {CALLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY msisdn, call_dialed_num, call_type ORDER BY row_number) AS k FROM calls c
        WHERE batch_id <> 'b0' AND NOT EXISTS (SELECT 1 FROM calls s WHERE s.batch_id = 'b0' AND s.msisdn = c.msisdn AND s.call_dialed_num = c.call_dialed_num AND s.call_type = c.call_type))
    SELECT msisdn, call_dialed_num, call_type, row_number FROM r WHERE k = 1""")
def dedup_insert_ignore(spark, d):
    c, key = calls(spark, d).select("msisdn", "call_dialed_num", "call_type", "row_number", "batch_id"), ["msisdn", "call_dialed_num", "call_type"]
    return I.insert_ignore(c.where("batch_id = 'b0'"), c.where("batch_id <> 'b0'"), key, "row_number").drop("batch_id")


@query(f"""WITH {CALLS_SQL} SELECT msisdn, call_dialed_num, arg_max(call_type, row_number) AS call_type, max(row_number) AS row_number, arg_min(location, row_number) AS location FROM calls GROUP BY 1, 2""")
def upsert_latest_wins(spark, d):
    c = calls(spark, d).select("msisdn", "call_dialed_num", "call_type", "row_number", "location", "batch_id")
    return I.upsert_latest(c.where("batch_id = 'b0'").drop("batch_id"), c.where("batch_id <> 'b0'").drop("batch_id"), ["msisdn", "call_dialed_num"], "row_number", ("location",))


@query(f"""WITH {CALLS_SQL}, h AS (SELECT batch_id, string_agg(call_type || '=' || n, ',' ORDER BY call_type || '=' || n) AS call_types FROM (SELECT batch_id, call_type, count(*) AS n FROM calls GROUP BY 1, 2) GROUP BY 1)
    SELECT batch_id, count(*) AS total, min(call_start_ts) AS first_seen, max(call_start_ts) AS last_seen, count(DISTINCT call_dialed_num) AS targets, count(DISTINCT msisdn) AS originators,
           count(DISTINCT location) AS locations, any_value(call_types) AS call_types FROM calls JOIN h USING (batch_id) GROUP BY 1""")
def batch_stats(spark, d):
    return I.batch_stats(calls(spark, d))


@query(f"""WITH {CALLS_SQL}, k AS (SELECT DISTINCT msisdn, call_dialed_num, call_type FROM calls WHERE duration_seconds > 1)
    SELECT count(*) AS total_rows, count(*) FILTER (WHERE duration_seconds <= 1) AS rejected_rows, (SELECT count(*) FROM k) AS inserted_rows,
           greatest(0, count(*) - count(*) FILTER (WHERE duration_seconds <= 1) - (SELECT count(*) FROM k)) AS duplicate_rows FROM calls""")
def quarantine_split(spark, d):
    return I.ingest_counts(calls(spark, d), F.col("duration_seconds") <= 1, ["msisdn", "call_dialed_num", "call_type"])


# --- records of inferred schema ----------------------------------------------------------------------------------


def _records(spark, d):
    return calls(spark, d).select(F.col("row_number").alias("id"), "row_number", "msisdn", "call_dialed_num", "call_start_ts", "duration_seconds", "call_type", "location", "cell_site_id")


@query(f"""WITH {CALLS_SQL} SELECT row_number AS id, msisdn, duration_seconds, call_type FROM calls WHERE lower(call_type) = 'click' AND duration_seconds >= 20 AND location <> 'L1'
    ORDER BY duration_seconds DESC, row_number OFFSET 10 LIMIT 100""")
def e3_filter_sort_page(spark, d):
    return R.query(_records(spark, d), [("call_type", "eq", "Click"), ("duration_seconds", "gte", "20"), ("location", "ne", "l1")], [("duration_seconds", True)], offset=10, fields=["id", "msisdn", "duration_seconds", "call_type"])


@query("""SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_extendedprice >= 20000 AND l_shipdate < DATE '1996-01-01' AND lower(l_returnflag) = 'r'
    ORDER BY round(l_extendedprice, 2) DESC, l_shipdate, id LIMIT 200""")
def e3_typed_values(spark, d):
    """Fields of text stored as VARIANT once, then filtered and sorted as stored."""
    fields = F.create_map(F.lit("price"), F.format_number("l_extendedprice", 2), F.lit("shipped"), F.date_format("l_shipdate", "MM/dd/yyyy"), F.lit("flag"), F.concat(F.lit(" "), F.col("l_returnflag")))
    path = work_path(spark, "typed")
    R.typed_fields(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), fields.alias("fields"))).write.parquet(path)
    rows = R.unfolded(spark.read.parquet(path), ["price", "shipped", "flag"])
    return R.query(rows, [("price", "gte", "20,000"), ("shipped", "lt", "1996-01-01"), ("flag", "eq", "R")], [("price", True), ("shipped", False)], limit=200, fields=["id"])


@query(f"WITH {CALLS_SQL} SELECT call_type, location, count(*) AS total FROM calls GROUP BY 1, 2 ORDER BY total DESC, 1, 2 LIMIT 100")
def e3_group_count(spark, d):
    return R.group_count(_records(spark, d), ["call_type", "location"])


@query(f"WITH {CALLS_SQL} SELECT lower(cell_site_id) AS key, arg_max(cell_site_id, row_number) AS value FROM calls GROUP BY 1")
def e3_distinct(spark, d):
    return R.distinct_values(_records(spark, d), "cell_site_id", "row_number")


@query(f"WITH {CALLS_SQL} SELECT row_number AS id, row_number, msisdn, call_dialed_num, call_start_ts, duration_seconds, call_type, location, cell_site_id FROM calls ORDER BY duration_seconds, row_number LIMIT 1")
def e3_min(spark, d):
    return R.extreme(_records(spark, d), "duration_seconds", "row_number")


@query(f"WITH {CALLS_SQL} SELECT row_number AS id, row_number, msisdn, call_dialed_num, call_start_ts, duration_seconds, call_type, location, cell_site_id FROM calls ORDER BY duration_seconds DESC, row_number LIMIT 1")
def e3_max(spark, d):
    return R.extreme(_records(spark, d), "duration_seconds", "row_number", largest=True)


@query(f"WITH {CALLS_SQL} SELECT lower(call_dialed_num) AS value, count(*) AS total FROM calls GROUP BY 1 ORDER BY total DESC, value LIMIT 10")
def e3_top(spark, d):
    return R.top_values(_records(spark, d), "call_dialed_num")


@query(f"WITH {CALLS_SQL} SELECT location AS grp, CAST(min(duration_seconds) AS DOUBLE) AS extreme, count(*) AS total FROM calls GROUP BY 1")
def e3_grouped_min(spark, d):
    return R.grouped_extreme(_records(spark, d), "location", "duration_seconds", "row_number")


@query(f"""WITH {CALLS_SQL}, m AS (SELECT location, max(duration_seconds) AS extreme FROM calls GROUP BY 1), f AS (SELECT location, extreme, min(row_number) AS since FROM calls JOIN m USING (location) WHERE duration_seconds = extreme GROUP BY 1, 2)
    SELECT location AS grp, CAST(extreme AS DOUBLE) AS extreme, count(*) AS total FROM calls JOIN f USING (location) WHERE row_number >= since GROUP BY 1, 2""")
def e3_grouped_max(spark, d):
    return R.grouped_extreme(_records(spark, d), "location", "duration_seconds", "row_number", largest=True, compat=True)


@query(f"WITH {CALLS_SQL}, g AS (SELECT msisdn, cell_site_id, count(*) AS total FROM calls GROUP BY 1, 2 ORDER BY total DESC, 1, 2 LIMIT 100) SELECT * FROM g WHERE total > 1")
def e3_repeat_pairs(spark, d):
    return R.repeat_pairs(_records(spark, d), ["msisdn", "cell_site_id"])


@query(f"""WITH {CALLS_SQL} SELECT row_number AS id, row_number, msisdn, call_dialed_num, call_start_ts, duration_seconds, call_type, location, cell_site_id FROM calls
    WHERE msisdn = '5' AND call_dialed_num = '9' OR msisdn = '9' AND call_dialed_num = '5' ORDER BY call_start_ts, row_number LIMIT 100""")
def e3_calls_between(spark, d):
    return R.calls_between(_records(spark, d), "5", "9", "msisdn", "call_dialed_num", "call_start_ts")


@query(f"""WITH {CALLS_SQL}, l AS (SELECT row_number AS left_id, epoch_us(call_start_ts) AS lt, msisdn AS entity FROM calls WHERE call_type = 'CLICK'), r AS (SELECT row_number AS right_id, epoch_us(call_start_ts) AS rt, call_dialed_num AS entity FROM calls WHERE call_type = 'VIEW')
    SELECT left_id, right_id, entity, abs(lt - rt) // 1000000 AS delta_seconds FROM l JOIN r USING (entity) WHERE abs(lt - rt) // 1000000 <= 300""")
def correlate_window(spark, d):
    c = _records(spark, d)
    return R.correlate(c.where("call_type = 'CLICK'"), c.where("call_type = 'VIEW'"), ["msisdn"], ["call_dialed_num"], "call_start_ts", "call_start_ts", "id", "id")


# --- times as text, in several layouts, some of which cannot be read ----------------------------------------------


def _texts(spark, d):
    t = F.date_trunc("second", "call_start_ts")
    layout = F.element_at(F.array(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.date_format(t, "MM/dd/yyyy HH:mm:ss"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")), (F.col("row_number") % 3 + 1).cast("int"))
    return _records(spark, d).withColumn("seen", F.when(F.col("row_number") % 7 == 0, "n/a").otherwise(layout))


_TEXTS_SQL = f"{CALLS_SQL}, texts AS (SELECT *, row_number AS id, CASE WHEN row_number % 7 <> 0 THEN date_trunc('second', call_start_ts) END AS t FROM calls)"


@query(f"WITH {_TEXTS_SQL} SELECT id, msisdn FROM texts WHERE (t IS NULL OR t > TIMESTAMP '2024-01-15 12:00:00') AND msisdn = '7' ORDER BY id LIMIT 100")
def e3_time_filter(spark, d):
    """A value that cannot be read as a time compares as text."""
    return R.query(_texts(spark, d), [("seen", "gt", "2024-01-15T12:00:00Z"), ("msisdn", "eq", "7")], fields=["id", "msisdn"])


@query(f"WITH {_TEXTS_SQL} SELECT id, call_type FROM texts ORDER BY t DESC NULLS LAST, id LIMIT 100 OFFSET 50")
def e3_time_sort(spark, d):
    return R.query(_texts(spark, d), sort=[("seen", True)], offset=50, fields=["id", "call_type"])


@query(f"WITH {_TEXTS_SQL} SELECT location AS grp, min(t) AS extreme, count(*) AS total FROM texts WHERE t IS NOT NULL GROUP BY 1")
def e3_grouped_first_time(spark, d):
    own = R.grouped_extreme(_texts(spark, d).where("seen <> 'n/a'"), "location", "seen", "id", numbers=False)
    return own.withColumn("extreme", R.as_time(F.col("extreme")).cast("timestamp_ntz"))


@query(f"WITH {_TEXTS_SQL} SELECT call_type, count(*) AS total FROM texts WHERE t BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY 1")
def e3_between_times(spark, d):
    return R.between_times(_texts(spark, d), "seen", "2024-01-10", "01/20/2024").groupBy("call_type").agg(F.count("*").alias("total"))


@query(f"""WITH {_TEXTS_SQL}, l AS (SELECT id AS left_id, t AS lt, msisdn AS entity FROM texts WHERE call_type = 'ERROR'), r AS (SELECT id AS right_id, t AS rt, msisdn AS entity FROM texts WHERE call_type = 'PURCHASE')
    SELECT left_id, right_id, entity, CASE WHEN lt IS NULL OR rt IS NULL THEN 0 ELSE abs(epoch(lt) - epoch(rt))::BIGINT END AS delta_seconds FROM l JOIN r USING (entity) WHERE lt IS NULL OR rt IS NULL OR abs(epoch(lt) - epoch(rt)) <= 900""")
def correlate_unparsable(spark, d):
    c = _texts(spark, d)
    return R.correlate(c.where("call_type = 'ERROR'"), c.where("call_type = 'PURCHASE'"), ["msisdn"], ["msisdn"], "seen", "seen", "id", "id", 900)


# --- evidence ----------------------------------------------------------------------------------------------------


def _evidence(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").when(F.col("o_orderkey") % 2 == 0, "queued").otherwise("failed")
    modality = F.element_at(F.array(*map(F.lit, ("structured_records", "document", "image", "audio", "video"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    return o.select(F.concat(F.lit("e"), "o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("updated_at"), status.alias("processing_status"), modality.alias("modality"), F.floor("o_totalprice").cast("long").alias("size_bytes"))


_EVIDENCE_SQL = """evidence AS (SELECT 'e' || o_orderkey AS evidence_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'processing' WHEN o_orderkey % 2 = 0 THEN 'queued' ELSE 'failed' END AS processing_status,
    ['structured_records', 'document', 'image', 'audio', 'video'][CAST(o_custkey % 5 + 1 AS INTEGER)] AS modality, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders)"""


@query(f"""WITH {_EVIDENCE_SQL} SELECT count(*) AS evidence_total, {", ".join(f"count(*) FILTER (WHERE processing_status = '{x}') AS {x}" for x in ("completed", "processing", "queued", "failed"))},
    {", ".join(f"count(*) FILTER (WHERE modality = '{x}') AS {y}" for x, y in (("structured_records", "structured_records"), ("document", "documents"), ("image", "images"), ("audio", "audio"), ("video", "video")))},
    CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, (SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT processing_status AS s, count(*) AS n FROM evidence GROUP BY 1)) AS status_counts,
    (SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT modality AS s, count(*) AS n FROM evidence GROUP BY 1)) AS modality_counts FROM evidence""")
def evidence_summary(spark, d):
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    found = V.evidence_summary(_evidence(spark, d))
    return found.select(*[c for c in found.columns if not c.endswith("_counts")], text("status_counts"), text("modality_counts"))


@query(f"""WITH {CALLS_SQL}, e AS (SELECT unnest(['phone', 'dialed', 'location', 'imei']) AS entity_type, unnest([msisdn, call_dialed_num, location, imei]) AS entity_value, call_start_ts AS t FROM calls WHERE file_id = 'f1' AND batch_id = 'b2' AND collection_id = 'col1')
    SELECT entity_type, count(*) AS observation_count, count(DISTINCT entity_value) AS unique_entities, min(t) AS first_seen, max(t) AS last_seen FROM e GROUP BY 1""")
def evidence_entity_rollup(spark, d):
    """The entities frame of one piece of evidence, whose job brought batch b2 of file f1."""
    c = calls(spark, d)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("entity_type"), F.col(v).alias("entity_value")) for k, v in (("phone", "msisdn"), ("dialed", "call_dialed_num"), ("location", "location"), ("imei", "imei"))]))
    found = c.select("tenant_id", "collection_id", "file_id", "batch_id", F.col("call_start_ts").alias("observed_at"), kinds.alias("x")).select("*", "x.*").drop("x")
    own = c.groupBy("tenant_id", "collection_id", "file_id", F.col("batch_id").alias("id")).agg(F.max("call_start_ts").alias("queued_at"))
    job = own.withColumn("evidence_id", F.concat_ws("-", "collection_id", "file_id", "id"))
    none = job.select("evidence_id", F.col("queued_at").alias("updated_at"), F.col("queued_at").alias("timestamp"), F.lit(1).alias("row_number"))
    return V.evidence_detail(none, job, none, none, found, "col1-f1-b2")["entities"]


@query(f"WITH {CALLS_SQL} SELECT call_type, count(*) AS total FROM calls WHERE tenant_id = 't1' AND collection_id = 'col2' GROUP BY 1")
def scoped_call_types(spark, d):
    return in_scope(calls(spark, d), "t1", "col2").groupBy("call_type").agg(F.count("*").alias("total"))
