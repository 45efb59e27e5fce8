"""Queries over records of inferred schema: filter, sort, page, aggregate, correlate and the named helpers.

A record is a row whose fields are text, or VARIANT values that ``typed_fields`` made of them once; queries of stored values then
parse none of them.  Two values compare as numbers if both are, else as times if both are, else as
lower-case text.  Sorting and extremes rank a value by its number, then its time, then its text, so that the order is
total: values that are no numbers come before numbers, and absent ones first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.names import ALIASES, canonical, normalise
from corvane.functions.text import normalise_name
from corvane.operators.ingest import parse_time, time_in, with_value

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


def clamp(limit: int | None, default: int = DEFAULT_LIMIT) -> int:
    return default if not limit or limit < 1 else min(limit, MAX_LIMIT)


def typed_value(c: Column) -> Column:
    """A text as a VARIANT: number, boolean (t, f, true, false), time, or else the trimmed text; null stays null."""
    text = F.trim(c)
    word = F.lower(text)
    truth = F.when(word.isin("t", "true"), F.lit(True)).when(word.isin("f", "false"), F.lit(False))
    return F.coalesce(*[v.cast("variant") for v in (as_number(text), truth, as_time(text), text)])  # each is made once


def typed_fields(rows: DataFrame, fields: str = "fields") -> DataFrame:
    """Rows whose map of texts has become one of VARIANT values, by ``typed_value``; every other column stays."""
    return rows.withColumn(fields, F.transform_values(fields, lambda _, v: typed_value(v)))


def unfolded(rows: DataFrame, names: list[str], fields: str = "fields") -> DataFrame:
    """The rows with fields of these names as columns, in place of the map; a column of such a name is replaced."""
    others = [c for c in rows.columns if c != fields and c not in names]
    return rows.select(*others, *[F.try_element_at(fields, F.lit(n)).alias(n) for n in names])


def _holds(c: Column, kind: str) -> Column:
    return F.schema_of_variant(c) == kind


class _Typed:
    """What a VARIANT value is as a number, a time and a text: read, not parsed."""

    @staticmethod
    def number(c: Column) -> Column:
        return F.when(_holds(c, "DOUBLE"), F.try_variant_get(c, "$", "double"))

    @staticmethod
    def given(c: Column) -> Column:
        return c.isNotNull() & F.when(F.schema_of_variant(c).isin("DOUBLE", "TIMESTAMP"), F.lit(True)).otherwise(F.try_variant_get(c, "$", "string") != "")

    @staticmethod
    def time(c: Column) -> Column:
        return F.when(_holds(c, "TIMESTAMP"), F.try_variant_get(c, "$", "timestamp"))

    @staticmethod
    def text(c: Column) -> Column:
        number = F.regexp_replace(F.try_variant_get(c, "$", "double").cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
        time = F.date_format(F.try_variant_get(c, "$", "timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.when(_holds(c, "DOUBLE"), number).when(_holds(c, "TIMESTAMP"), time).otherwise(F.try_variant_get(c, "$", "string"))


class _Plain:
    """What a text is as a number, a time and a text."""

    number = staticmethod(lambda c: as_number(c))
    time = staticmethod(lambda c: as_time(c))
    text = staticmethod(lambda c: c.cast("string"))
    given = staticmethod(lambda c: c.isNotNull() & (c.cast("string") != ""))


def _kind(records: DataFrame, field: str):
    """How a field's values are read: as they are stored, or as texts."""
    return _Typed if field in records.columns and records.schema[field].dataType.typeName() == "variant" else _Plain


def number_in(text: Column) -> Column:
    """What ``as_number`` makes of a text without commas."""
    return F.when(text.rlike(r"^-?(0|[1-9][0-9]{0,14})(\.[0-9]+)?$"), text.try_cast("double"))


def without_commas(c: Column) -> Column:
    return F.regexp_replace(F.trim(c.cast("string")), ",", "")


def as_number(c: Column) -> Column:
    """Numbers, with thousands commas; digits that begin with 0 or are longer than 15 stay text."""
    return with_value(without_commas(c), number_in)


def as_time(c: Column) -> Column:
    """Times in any of the layouts of ``parse_time``, month first; null for other texts."""
    return parse_time(c.cast("string"), "month")


def _number_of(value) -> Column:
    """A given value as a number, made in advance."""
    return number_in(without_commas(F.lit(str(value))))


def _time_given(value) -> Column:
    """A given value as a time, made in advance."""
    return time_in(F.trim(F.lit(str(value))), "month")


def rank(c: Column, kind=_Plain) -> Column:
    """What a value sorts by: its number, its time in microseconds, its text."""
    number = kind.number(c)
    time = F.when(number.isNull(), F.unix_micros(kind.time(c)))
    return F.struct(F.coalesce(number, F.lit(float("-inf"))).alias("number"), F.coalesce(time, F.lit(-(1 << 63))).alias("time"), F.coalesce(F.lower(kind.text(c)), F.lit("")).alias("text"))


def equals(c: Column, value, kind=_Plain) -> Column:
    """As numbers if both are, as times if both are, else as text without regard to case."""
    v = F.lit(str(value))
    return F.coalesce(kind.number(c) == _number_of(value), kind.time(c) == _time_given(value), F.lower(kind.text(c)) == F.lower(v), F.lit(False))


def condition(field: str, op: str, value=None, columns: list[str] = (), kind=_Plain) -> Column:
    """One filter; an unknown operator or a blank or unknown field lets no row pass (``ne`` and ``not_exists``: every row
    without the field)."""
    if not field or (columns and field not in columns):
        return F.lit(bool(field) and op in ("ne", "not_exists", "!=", "missing"))
    c = F.col(field)
    given = kind.given(c)
    if op in ("eq", "=", "==", "equals"):
        return given & equals(c, value, kind)
    if op in ("ne", "!=", "not_equals"):
        return ~given | ~equals(c, value, kind)
    if op in ("contains", "like"):
        return given & F.contains(F.lower(kind.text(c)), F.lit(str(value).lower()))
    if op == "in":
        out = F.lit(False)
        for v in value:
            out = out | equals(c, v, kind)
        return given & out
    if op in ("gt", ">", "gte", ">=", "lt", "<", "lte", "<="):
        v = F.lit(str(value))
        sign = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}.get(op, op)
        hold = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[sign]
        return given & F.coalesce(hold(kind.number(c), _number_of(value)), hold(kind.time(c), _time_given(value)), hold(F.lower(kind.text(c)), F.lower(v)))
    if op in ("exists", "not_exists", "missing"):
        return given if op == "exists" else ~given
    return F.lit(False)


def query(records: DataFrame, filters=(), sort=(), id_col: str = "id", limit: int | None = None, offset: int = 0, fields: list[str] | None = None) -> DataFrame:
    """Filters are ANDed; sort is (field, descending) pairs with the id as tie-break; absent values sort as empty text."""
    out = records
    for f in filters:
        out = out.where(condition(f[0], f[1], f[2] if len(f) > 2 else None, records.columns, _kind(records, f[0])))
    # keys are columns of the sorted rows, as a sort would make an expression again for each comparison
    ranks = {f"__rank_{i}": (rank(F.col(field), _kind(records, field)), down) for i, (field, down) in enumerate(sort) if field in records.columns}
    keys = [F.col(name).desc() if down else F.col(name).asc() for name, (_, down) in ranks.items()]
    out = out.withColumns({name: key for name, (key, _) in ranks.items()}) if ranks else out
    out = out.orderBy(*keys, id_col).offset(max(0, offset)).limit(clamp(limit)).drop(*ranks)
    return out.select(*[c for c in fields if c in records.columns]) if fields else out


def group_count(records: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    return records.groupBy(*by).agg(F.count("*").alias("total")).orderBy(F.desc("total"), *by).limit(clamp(limit))


def distinct_values(records: DataFrame, field: str, order: str) -> DataFrame:
    """Values without regard to case, each in the spelling that came last."""
    v = _kind(records, field).text(F.col(field))
    return records.where(v.isNotNull() & (v != "")).groupBy(F.lower(v).alias("key")).agg(F.max_by(v, F.col(order)).alias("value")).orderBy("key")


def extreme(records: DataFrame, field: str, order: str, largest: bool = False) -> DataFrame:
    """The first row, by ``order``, of those with the field's smallest (largest) value; blank ones are left out."""
    c, kind = F.col(field), _kind(records, field)
    key = rank(c, kind).desc() if largest else rank(c, kind).asc()
    return records.where(c.isNotNull() & (F.trim(kind.text(c)) != "")).orderBy(key, order).limit(1)


def top_values(records: DataFrame, field: str, n: int = 10) -> DataFrame:
    v = F.lower(_kind(records, field).text(F.col(field)))
    return records.where(v.isNotNull() & (v != "")).groupBy(v.alias("value")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "value").limit(n)


def grouped_extreme(records: DataFrame, by: str, field: str, order: str, largest: bool = False, compat: bool = False, numbers: bool = True) -> DataFrame:
    """(grp, extreme, total): the extreme of each group with the group's rows; ``compat`` counts only those since the last
    improvement.  Without ``numbers`` times and texts count too, and the extreme is the value's text."""
    c = F.col(field)
    value = as_number(c) if numbers else F.struct(rank(c).alias("k"), c.cast("string").alias("v"))
    rows = records.where(value.isNotNull() if numbers else c.isNotNull() & (F.trim(c.cast("string")) != "")).select(F.col(by).alias("grp"), value.alias("n"), F.col(order).alias("o"))
    ends = rows.groupBy("grp").agg((F.max("n") if largest else F.min("n")).alias("extreme"), F.count("*").alias("total"))
    if compat:
        ends = ends.drop("total")
        hits = rows.join(ends, "grp").withColumn("hit", F.col("n") == F.col("extreme"))
        at = hits.where("hit").groupBy("grp").agg(F.min("o").alias("at"))
        ends = hits.join(at, "grp").where("o >= at").groupBy("grp", "extreme").agg(F.count("*").alias("total"))
    return ends if numbers else ends.withColumn("extreme", F.col("extreme.v"))


def repeat_pairs(records: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """Groups of more than one row among the largest groups."""
    return group_count(records, by, limit).where("total > 1")


def calls_between(records: DataFrame, a: str, b: str, source: str, target: str, time: str, limit: int | None = None) -> DataFrame:
    either = (F.col(source) == a) & (F.col(target) == b) | (F.col(source) == b) & (F.col(target) == a)
    return records.where(either).orderBy(time, "row_number").limit(clamp(limit))


def _time_of(records: DataFrame, time: str) -> Column:
    """The time column as it is, or read from text; null where it cannot be read."""
    return as_time(F.col(time)) if records.schema[time].dataType.simpleString() == "string" else F.col(time).cast("timestamp")


def correlate(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], left_time: str, right_time: str, left_id: str, right_id: str, window_seconds: int = 300) -> DataFrame:
    """Pairs of rows that share an entity and lie at most a window apart, one for each shared entity.

    Each side's entities are exploded; times are dealt into buckets of a window's length and the right side visits
    its own bucket and both neighbours, so the join is on (entity, bucket) and a busy entity is spread over time.
    A row without a time, or with one that cannot be read, meets every row of its entity, with a difference of 0.  The
    difference is in whole seconds, rounded down, and the window holds those of its own length.
    """
    w = max(1, window_seconds) + 1

    def side(df: DataFrame, keys: list[str], time: str, key_id: str, name: str) -> DataFrame:
        entity = F.explode(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys]))))
        return df.select(F.col(key_id).alias(f"{name}_id"), F.unix_micros(_time_of(df, time)).alias(f"{name}_t"), entity.alias("entity"))

    lhs, rhs = side(left, left_keys, left_time, left_id, "left"), side(right, right_keys, right_time, right_id, "right")
    timed_l = lhs.where("left_t IS NOT NULL").withColumn("bucket", F.floor(F.col("left_t") / (w * 1_000_000)))
    timed_r = rhs.where("right_t IS NOT NULL").withColumn("bucket", F.explode(F.expr(f"sequence(floor(right_t / {w * 1_000_000}) - 1, floor(right_t / {w * 1_000_000}) + 1)")))
    delta = F.floor(F.abs(F.col("left_t") - F.col("right_t")) / 1_000_000)
    near = timed_l.join(timed_r, ["entity", "bucket"]).where(delta <= window_seconds).withColumn("delta_seconds", delta).drop("bucket")
    loose = lhs.where("left_t IS NULL").join(rhs, "entity").unionByName(lhs.where("left_t IS NOT NULL").join(rhs.where("right_t IS NULL"), "entity"))
    return near.unionByName(loose.withColumn("delta_seconds", F.lit(0).cast("long"))).select("left_id", "right_id", "entity", "delta_seconds")


def schema_of(rows: DataFrame) -> DataFrame:
    """Fields over all batches of rows(record_type, fields): each field of a record type once, with its rows."""
    return rows.select("record_type", F.explode(F.map_keys("fields")).alias("field")).groupBy("record_type", "field").agg(F.count("*").alias("rows")).orderBy("record_type", "field")


def aliases_of(rows: DataFrame) -> DataFrame:
    """(record_type, canonical, fields): under which names each canonical field of a record type occurs, in order."""
    fields = schema_of(rows)  # a row for each field of a type
    pairs = [F.lit(x) for name, aliases in ALIASES.items() for a in aliases for x in (a, name)]
    own = normalise_name("field")
    name = F.coalesce(F.try_element_at(F.create_map(*pairs), own), own)
    return fields.groupBy("record_type", name.alias("canonical")).agg(F.array_sort(F.collect_set("field")).alias("fields")).orderBy("record_type", "canonical")


def between_times(records: DataFrame, time: str, start: str | None, stop: str | None) -> DataFrame:
    """Rows in the closed range; without a time that can be read a row is left out if a bound is set, and a bound that
    cannot be read is none."""
    bounds = [(_time_given(bound), lower) for bound, lower in ((start, True), (stop, False)) if bound]
    if not bounds:
        return records

    def within(t: Column) -> Column:
        out = t.isNotNull()
        for at, lower in bounds:
            out = out & F.coalesce(t >= at if lower else t <= at, F.lit(True))
        return out

    return records.where(with_value(_time_of(records, time), within))


#: Fields of the envelope that a record has beside its own, by the names they are asked for.
ENVELOPE = {"id": "id", "record_id": "id", "batch_id": "batch_id", "collection_name": "collection_name", "collection": "collection_name", "record_type": "record_type", "source_file": "source_file", "source_entry": "source_entry", "row_number": "row_number", "row": "row_number", "timestamp": "timestamp"}


def field_value(records: DataFrame, name: str) -> Column:
    """A field of records(envelope, normalized map, raw map) by any of its names: the envelope's, then the canonical and
    the plain name among the normalised fields, then the raw ones under it or a spelling of it."""
    plain, known = normalise(name), canonical(name)
    found = []
    if plain in ENVELOPE and ENVELOPE[plain] in records.columns:
        found.append(F.nullif(F.col(ENVELOPE[plain]).cast("string"), F.lit("")) if plain in ("timestamp", "source_entry") else F.col(ENVELOPE[plain]).cast("string"))
    if "normalized" in records.columns:
        found += [F.try_element_at("normalized", F.lit(n)) for n in dict.fromkeys((known, plain))]
    if "raw" in records.columns:
        spellings = F.filter(F.map_entries("raw"), lambda e: normalise_name(e["key"]) == plain)
        found += [F.try_element_at("raw", F.lit(name)), F.get(spellings, F.lit(0))["value"]]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def projected(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The fields asked for, by any of their names; without any the envelope and the normalised fields as a map."""
    if fields:
        return records.select(*[field_value(records, f).alias(f) for f in fields])
    kept = [c for c in dict.fromkeys(ENVELOPE.values()) if c in records.columns]
    return records.select(*kept, *[c for c in ("normalized",) if c in records.columns])


def helper(records: DataFrame, name: str, **given) -> DataFrame:
    """A named query over records(id, row_number, timestamp and canonical fields).

    given: field, value, source, target, start, stop, filters, limit - what the named query asks for.
    """
    filters, limit = list(given.get("filters", ())), given.get("limit")
    value, field = given.get("value"), given.get("field")

    def found(*more, sort=(), n=limit) -> DataFrame:
        return query(records, [*filters, *more], sort, limit=n)

    def kept(*more) -> DataFrame:
        out = records
        for f in (*filters, *more):
            out = out.where(condition(f[0], f[1], f[2] if len(f) > 2 else None, records.columns))
        return out

    by_time = [("timestamp", False)]
    # calls alone, where records of several types are at hand and the caller asks for none
    calls = [("record_type", "eq", "cdr")] if "record_type" in records.columns and not any(f[0] == "record_type" for f in filters) else []
    timed = [*calls, ("duration_seconds", "exists")]
    named = {
        "shortest_call": lambda: found(*timed, sort=[("duration_seconds", False)], n=1),
        "longest_call": lambda: found(*timed, sort=[("duration_seconds", True)], n=1),
        "target_numbers_by_source": lambda: top_values(kept(("source_number", "eq", given.get("source"))), "target_number", limit or 20),
        "calls_by_area": lambda: found(("area", "contains", value)),
        "calls_by_cell_id": lambda: found(("cell_id", "eq", value)),
        "calls_by_date_range": lambda: query(between_times(kept(), "timestamp", given.get("start"), given.get("stop")), sort=by_time, limit=limit),
        "calls_between_numbers": lambda: calls_between(records, given.get("source"), given.get("target"), "source_number", "target_number", "timestamp", limit),
        "failed_calls": lambda: found(("status", "contains", "fail")),
        "roaming_calls": lambda: found(("roaming", "eq", "true")),
        "imei_to_msisdns": lambda: group_count(kept(("imei", "eq", value)) if value else kept(), ["imei", "source_number"], limit),
        "imsi_to_msisdns": lambda: group_count(kept(("imsi", "eq", value)) if value else kept(), ["imsi", "source_number"], limit),
        "plate_search": lambda: found(("plate_number", "contains", value)),
        "sightings_by_location": lambda: found(("location", "contains", value)),
        "repeat_plate_locations": lambda: repeat_pairs(kept(), ["plate_number", "location"], limit),
        "records_by_field": lambda: found((field, "eq", value)),
        "distinct_values": lambda: distinct_values(kept(), field, "row_number"),
        "count_by_field": lambda: top_values(kept(), field, limit or DEFAULT_LIMIT),
        "min_by_field": lambda: extreme(kept(), field, "row_number"),
        "max_by_field": lambda: extreme(kept(), field, "row_number", largest=True),
        "top_by_field": lambda: top_values(kept(), field, limit or 10),
        "timeline_by_entity": lambda: found((field or "msisdn", "eq", value), sort=by_time),
    }
    same = {"sightings_by_plate": "plate_search", "plates_seen_near_location": "sightings_by_location", "sightings_by_time_range": "calls_by_date_range"}
    if same.get(name, name) not in named:
        raise ValueError(f"unknown helper {name}")
    return named[same.get(name, name)]()
