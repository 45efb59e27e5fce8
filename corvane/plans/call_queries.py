"""Queries over call records and the entity index."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import calls as C
from corvane.operators import entities as E
from corvane.plans.book import Book
from corvane.sources.views import CALLS_SQL, ENTITIES_SQL, GENERIC_SQL, calls, entities, generic

_book = Book()
query = _book.add
QUERIES, ORACLE_SQL = _book.queries, _book.sql
#: A party with calls at every size.
PARTY = "7"


@query(f"""WITH {CALLS_SQL}, g AS (
    SELECT call_dialed_num, count(*) AS total_calls, count(*) FILTER (WHERE direction = 'INCOMING') AS incoming, count(*) FILTER (WHERE direction = 'OUTGOING') AS outgoing,
           min(call_start_ts) AS first_seen, max(call_start_ts) AS last_seen FROM calls GROUP BY 1)
    SELECT *, CASE WHEN outgoing > 0 THEN round(incoming / outgoing, 4) END AS in_out_ratio FROM g ORDER BY total_calls DESC, call_dialed_num LIMIT 20""")
def frequent_contacts(spark, d):
    return C.frequent_contacts(calls(spark, d))


@query(f"""WITH {CALLS_SQL}, g AS (
    SELECT call_dialed_num, file_id, batch_id, count(*) AS total_calls, count(*) FILTER (WHERE direction = 'INCOMING') AS incoming, count(*) FILTER (WHERE direction = 'OUTGOING') AS outgoing,
           min(call_start_ts) AS first_seen, max(call_start_ts) AS last_seen FROM calls WHERE msisdn = '{PARTY}' OR call_dialed_num = '{PARTY}' GROUP BY 1, 2, 3)
    SELECT *, CASE WHEN outgoing > 0 THEN round(incoming / outgoing, 4) END AS in_out_ratio FROM g ORDER BY total_calls DESC, call_dialed_num, file_id, batch_id LIMIT 20""")
def frequent_contacts_by_batch(spark, d):
    return C.frequent_contacts(calls(spark, d), PARTY, by_batch=True)


@query(f"WITH {CALLS_SQL} SELECT call_type, direction, count(*) AS total, min(call_start_ts) AS first_seen, max(call_start_ts) AS last_seen FROM calls GROUP BY 1, 2")
def call_type_breakdown(spark, d):
    return C.call_type_breakdown(calls(spark, d))


@query(f"WITH {CALLS_SQL} SELECT CAST(hour(call_start_ts) AS INTEGER) AS hour, count(*) AS total FROM calls GROUP BY 1")
def hourly_activity(spark, d):
    return C.hourly_activity(calls(spark, d))


@query(f"WITH {CALLS_SQL} SELECT count(*) FILTER (WHERE hour(call_start_ts) BETWEEN 1 AND 4) AS nocturnal_calls, count(*) AS total_calls FROM calls")
def nocturnal_count(spark, d):
    return C.nocturnal_count(calls(spark, d))


@query(f"WITH {CALLS_SQL} SELECT count(*) AS calls, min(duration_seconds) AS shortest, max(duration_seconds) AS longest, round(avg(duration_seconds), 2) AS mean FROM calls WHERE duration_seconds > 0")
def duration_stats(spark, d):
    return C.duration_stats(calls(spark, d))


@query(f"""WITH {CALLS_SQL}, own AS (SELECT msisdn, call_dialed_num, call_start_ts, duration_seconds, row_number FROM calls WHERE duration_seconds > 0)
    (SELECT 'shortest' AS metric, * FROM own ORDER BY duration_seconds, call_start_ts, row_number LIMIT 1)
    UNION ALL (SELECT 'longest', * FROM own ORDER BY duration_seconds DESC, call_start_ts, row_number LIMIT 1)""")
def duration_extremes(spark, d):
    return C.duration_extremes(calls(spark, d))


@query(f"""WITH {CALLS_SQL} SELECT location, count(*) AS visits, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, min(call_start_ts) AS first_seen, max(call_start_ts) AS last_seen
    FROM calls WHERE location <> '' GROUP BY 1 ORDER BY visits DESC, location LIMIT 20""")
def top_locations(spark, d):
    return C.top_locations(calls(spark, d))


@query(f"""WITH {CALLS_SQL} SELECT location, cell_site_id, count(*) AS night_calls FROM calls WHERE hour(call_start_ts) >= 22 OR hour(call_start_ts) <= 6
    GROUP BY 1, 2 ORDER BY night_calls DESC, location, cell_site_id LIMIT 5""")
def base_location_candidates(spark, d):
    return C.base_location_candidates(calls(spark, d))


@query(f"""WITH {CALLS_SQL} SELECT msisdn, call_start_ts, location, cell_site_id, coalesce(lag(cell_site_id) OVER (PARTITION BY msisdn ORDER BY call_start_ts, row_number) <> cell_site_id, false) AS moved, row_number
    FROM calls WHERE msisdn = '{PARTY}' OR call_dialed_num = '{PARTY}' ORDER BY call_start_ts, row_number LIMIT 100""")
def movement_timeline(spark, d):
    return C.movement_path(calls(spark, d), PARTY)


@query(f"""WITH {CALLS_SQL}, {GENERIC_SQL} SELECT day, record_type, count(*) AS total FROM (
    SELECT CAST(call_start_ts AS DATE) AS day, 'cdr' AS record_type FROM calls UNION ALL SELECT CAST(observed_at AS DATE), record_type FROM generic) GROUP BY 1, 2""")
def activity_by_day(spark, d):
    return C.activity_by_day(calls(spark, d), generic(spark, d))


@query(f"""WITH {CALLS_SQL}, {GENERIC_SQL} SELECT * FROM (
    SELECT 'cdr' AS record_type, call_start_ts AS event_time, msisdn AS primary_entity, call_dialed_num AS secondary_entity, direction || ' ' || call_type AS label, location, row_number
    FROM calls WHERE msisdn = '{PARTY}' OR call_dialed_num = '{PARTY}' OR location ILIKE '%{PARTY}%'
    UNION ALL SELECT record_type, observed_at, primary_entity, secondary_entity, record_type, location, row_number FROM generic
    WHERE primary_entity ILIKE '%{PARTY}%' OR secondary_entity ILIKE '%{PARTY}%' OR location ILIKE '%{PARTY}%')
    ORDER BY event_time NULLS LAST, record_type, row_number LIMIT 100""")
def entity_timeline(spark, d):
    return C.entity_timeline(calls(spark, d), generic(spark, d), PARTY)


@query(f"""WITH {CALLS_SQL} SELECT file_id, batch_id, row_number, msisdn, call_dialed_num, call_start_ts, call_type, location FROM calls
    WHERE msisdn = 'L3' OR call_dialed_num = 'L3' OR location ILIKE '%L3%' ORDER BY call_start_ts, row_number LIMIT 20""")
def source_records(spark, d):
    return C.source_records(calls(spark, d), "L3")


@query(f"""WITH {CALLS_SQL}, {GENERIC_SQL}, r AS (SELECT 'cdr' AS family, call_start_ts AS t FROM calls UNION ALL SELECT record_type, observed_at FROM generic)
    SELECT coalesce(family, 'all') AS family, count(*) AS total, min(t) AS first, max(t) AS last FROM r GROUP BY ROLLUP (family)""")
def coverage_summary(spark, d):
    return C.coverage_summary(calls(spark, d), generic(spark, d))


@query(f"""WITH {CALLS_SQL} SELECT max(call_start_ts) FILTER (WHERE call_start_ts < TIMESTAMP '2024-01-10') AS before, min(call_start_ts) FILTER (WHERE call_start_ts >= TIMESTAMP '2024-01-12') AS after,
    count(*) FILTER (WHERE call_start_ts >= TIMESTAMP '2024-01-10' AND call_start_ts < TIMESTAMP '2024-01-12') AS inside FROM calls WHERE msisdn = '{PARTY}' OR call_dialed_num = '{PARTY}'""")
def nearest_activity(spark, d):
    return C.nearest_activity(calls(spark, d), PARTY, "2024-01-10", "2024-01-12")


@query(f"""WITH {CALLS_SQL}, g AS (SELECT msisdn, count(*) AS total FROM calls WHERE msisdn <> '' GROUP BY 1 ORDER BY total DESC, msisdn LIMIT 5)
    SELECT CASE WHEN length(msisdn) <= 4 THEN msisdn ELSE left(msisdn, 2) || '***' || right(msisdn, 2) END AS target, total FROM g""")
def example_targets(spark, d):
    return C.example_targets(calls(spark, d))


@query(f"""WITH {ENTITIES_SQL} SELECT entity_type, entity_value, count(*) AS total, count(DISTINCT record_type) AS families, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
    list_sort(list(DISTINCT record_type)) AS record_types FROM entities WHERE entity_value <> '' GROUP BY 1, 2 ORDER BY total DESC, entity_type, entity_value LIMIT 100""")
def entity_activity(spark, d):
    return E.entity_activity(entities(spark, d))


@query(f"""WITH {ENTITIES_SQL} SELECT entity_type, entity_value, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS total FROM entities WHERE entity_value <> ''
    GROUP BY 1, 2 ORDER BY last_seen DESC NULLS LAST, entity_type, entity_value LIMIT 100""")
def first_seen_last_seen(spark, d):
    return E.first_seen_last_seen(entities(spark, d))


@query(f"""WITH {ENTITIES_SQL}, hits AS (SELECT DISTINCT record_type, batch_id, row_number FROM entities WHERE entity_value ILIKE 'L3')
    SELECT entity_type, entity_value, count(*) AS shared_rows, min(seen_at) AS first_seen, max(seen_at) AS last_seen, list_sort(list(DISTINCT record_type)) AS record_types, list_sort(list(DISTINCT batch_id)) AS batches
    FROM entities JOIN hits USING (record_type, batch_id, row_number) WHERE NOT entity_value ILIKE 'L3' AND entity_value <> '' GROUP BY 1, 2 ORDER BY shared_rows DESC, entity_type, entity_value LIMIT 20""")
def relationship_network(spark, d):
    return E.relationship_network(entities(spark, d), "L3")


@query(f"WITH {ENTITIES_SQL} SELECT entity_type, record_type, count(*) AS total, count(DISTINCT entity_value) AS entities FROM entities WHERE entity_value <> '' GROUP BY 1, 2")
def entity_unpivot(spark, d):
    return entities(spark, d).groupBy("entity_type", "record_type").agg(F.count("*").alias("total"), F.count_distinct("entity_value").alias("entities"))
