"""From a plain-language question to one of a fixed set of templates, its targets and dates.

Rules are tried in order and the first that fits decides.  A single word fits a whole word of the question, a
phrase fits anywhere.  No query text is ever made from the question.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corvane.functions.predicates import clamp_offset, payload_filter, payload_value
from corvane.operators.records import clamp, rank

#: Templates and the words that call for them, in order of precedence.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("executive_case_brief", ("executive brief", "case brief", "case summary", "summarize this case", "generate report", "full report")),
    ("canonical_records", ("canonical", "source file is", "batch id")),
    ("court_ready_source_summary", ("court ready", "court-ready")),
    ("source_file_audit", ("which files", "source files", "ingested files")),
    ("duplicate_upload_audit", ("duplicate upload", "duplicate file")),
    ("limitations_and_data_quality", ("limitations", "missing data", "data gaps")),
    ("case_readiness", ("readiness", "ready for court", "ready for production", "can we trust", "evidence health")),
    ("evidence_package_summary", ("evidence package",)),
    ("schema_profile", ("schema", "headers", "columns", "fields", "adapter", "detected")),
    ("relationship_network", ("compare", "relationship", "relationships", "network", "link", "links", "connection", "connections")),
    ("entity_timeline", ("timeline", "chronology", "sequence", "events", "history")),
    ("source_records", ("raw rows", "source rows", "sample rows", "show records", "raw records")),
    ("collection_overview", ("collection status", "collection overview", "ingest status")),
    ("data_quality", ("quality", "error", "errors", "rejected", "duplicate", "duplicates", "parser", "failed")),
    ("collection_overview", ("overview", "status", "ingest", "batch", "asset", "assets", "rows")),
    ("call_type_breakdown", ("call type", "gprs", "sms", "volte", "data", "breakdown")),
    ("frequent_contacts", ("contact", "contacts", "contacted", "caller", "called", "dialed", "communicated")),
    ("shortest_call", ("shortest call",)),
    ("longest_call", ("longest call",)),
    ("first_seen_last_seen", ("first seen", "last seen")),
    ("suspicious_patterns", ("suspicious", "anomaly", "anomalies", "investigate next", "key findings")),
    ("activity_by_day", ("activity by day", "daily activity", "per day")),
    ("activity_by_hour", ("activity by hour", "per hour")),
    ("night_activity", ("night activity", "at night")),
    ("duration_extremes", ("hourly", "duration", "longest", "shortest", "temporal", "night")),
    ("subscriber_profile", ("subscriber",)),
    ("imei_imsi_usage", ("imei", "imsi")),
    ("entity_activity", ("entity", "related", "ip")),
    ("anpr_sightings", ("sighting", "sightings", "plate", "camera")),
    ("tower_activity", ("tower", "cell site")),
    ("top_locations", ("top location", "common location", "top locations", "cell", "where", "visited", "site", "seen")),
    ("geospatial_movement", ("movement", "geo", "location", "locations", "base", "lat", "long")),
    ("evidence", ("policy", "source", "evidence", "document", "case note")),
]
#: Templates that run as another one.
ALIASES = {
    "activity_by_hour": "hourly_activity", "night_activity": "nocturnal_count", "shortest_call": "duration_extremes", "longest_call": "duration_extremes", "tower_activity": "top_locations", "repeated_location_visits": "top_locations",
    "subscriber_profile": "entity_activity", "imei_imsi_usage": "entity_activity", "evidence": "entity_activity", "co_travel_or_co_presence": "relationship_network", "court_ready_source_summary": "source_records", "anomaly_summary": "suspicious_patterns",
    "source_file_audit": "collection_overview", "duplicate_upload_audit": "collection_overview", "evidence_package_summary": "collection_overview", "executive_case_brief": "collection_overview", "limitations_and_data_quality": "data_quality", "geospatial_movement": "movement_path",
}
_TARGETS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"),
    re.compile(r"\+?[0-9][0-9 ()-]{6,20}[0-9]"),
    re.compile(r"\b[A-Z]{2,4}-[A-Z0-9]{2,6}(?:-[A-Z0-9]+)*\b", re.I),
    re.compile(r"\b(?:GPRS|SMS|VOLTE)\b", re.I),
]
_DATES = [(re.compile(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"), "%Y-%m-%d"), (re.compile(r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b"), "%d/%m/%Y"), (re.compile(r"\b[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}\b"), "%d %B %Y"), (re.compile(r"\b[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}\b"), "%B %d, %Y")]


@dataclass
class Plan:
    template: str
    intent: str
    targets: list[str] = field(default_factory=list)
    start: str | None = None
    stop: str | None = None
    confidence: float = 0.72


def says(question: str, words: tuple[str, ...]) -> bool:
    q = question.lower()
    tokens = set(re.findall(r"[a-z0-9]+", q))
    return any(w in q if re.search(r"[^a-z0-9]", w) else w in tokens for w in words)


def target_type(target: str) -> str:
    if "@" in target:
        return "email"
    if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", target):
        return "ip"
    if target in ("GPRS", "SMS", "VOLTE"):
        return "call_type"
    if re.fullmatch(r"[0-9]{8,19}", target):
        return "phone"
    return "identifier" if any(c.isdigit() for c in target) else "entity"


#: Words that are no targets, and what is a word and a number.
_NO_TARGETS = ("call", "calls", "data", "record", "records")
_NO_TARGET = re.compile(r"(?:on|in|at|by|from|to)-?[0-9]{1,6}", re.I)


def _day(digits: str) -> bool:
    """Whether eight digits are a day: year, month, day."""
    try:
        return len(digits) == 8 and bool(datetime.strptime(digits, "%Y%m%d"))
    except ValueError:
        return False


def extract_targets(question: str) -> list[str]:
    """Addresses, numbers and identifiers in order of place; dates, words of the trade and a word with a number are none."""
    found = []
    taken = [m.span() for p, _ in _DATES for m in p.finditer(question)]
    for pattern in _TARGETS:
        for m in pattern.finditer(question):
            if any(m.start() < b and m.end() > a for a, b in taken):
                continue
            text, number = m[0].strip(), re.sub(r"\D", "", m[0])
            if "@" in text:
                value = text.lower()
            elif re.fullmatch(r"[0-9.]+", text) and text.count(".") == 3:
                value = text
            elif not re.search(r"[A-Za-z]", text) and 8 <= len(number) <= 19:
                value = number
            else:
                value = re.sub(r"[\s_]+", "-", text.upper())
            if value.lower() in _NO_TARGETS or _NO_TARGET.fullmatch(value) or not re.search(r"[A-Za-z]", text) and _day(number):
                continue
            found.append((m.start(), value))
            taken.append(m.span())
    return list(dict.fromkeys(v for _, v in sorted(found)))


def extract_dates(question: str) -> tuple[str | None, str | None]:
    """Half-open bounds from the first day named to the day after the last."""
    days = []
    for pattern, layout in _DATES:
        for m in pattern.finditer(question):
            try:
                days.append(datetime.strptime(m[0], layout))
            except ValueError:
                continue
    if not days:
        return None, None
    return min(days).strftime("%Y-%m-%dT00:00:00Z"), (max(days) + timedelta(days=1)).strftime("%Y-%m-%dT00:00:00Z")


def choose_template(question: str) -> str:
    dated = extract_dates(question)[0] is not None
    for template, words in RULES:
        if template == "court_ready_source_summary" and dated and says(question, ("happened", "events on", "timeline on", "activity on")):
            return "entity_timeline"
        if says(question, words):
            return template
        if template == "canonical_records" and re.search(r"\b(?:where|with)\s+\w+\s+(?:is\b|equals\b|contains\b|exists\b|=|>|<)", question.lower()) and says(question, ("records", "rows")):
            return template
        if template == "anpr_sightings" and says(question, ("seen",)) and any(target_type(t) == "identifier" for t in extract_targets(question)):
            return template
    return "frequent_contacts"


def choose_intent(question: str, template: str) -> str:
    if template in ("executive_case_brief", "court_ready_source_summary"):
        return "hybrid"
    if template in ("source_records", "schema_profile", "data_quality", "case_readiness"):
        return "hybrid" if template == "source_records" and says(question, ("summarize", "explain", "cite", "why", "report", "context")) else "records"
    semantic = says(question, ("policy", "document", "case note", "explain", "why", "evidence", "cite"))
    exact = says(question, ("records", "rows", "calls", "count", "top", "list", "contact", "contacts", "location", "timeline"))
    return "hybrid" if semantic and exact else "semantic" if semantic else "records"


def plan(question: str) -> Plan:
    template, targets, (start, stop) = choose_template(question), extract_targets(question), extract_dates(question)
    intent = choose_intent(question, template)
    sure = 0.72 + 0.12 * bool(targets) + 0.06 * bool(start) + 0.04 * (len(targets) > 1) + 0.08 * (intent == "hybrid")
    return Plan(template, intent, targets, start, stop, round(min(0.95, sure), 2))


def answer(question: str, calls, generic, entities, jobs=None, limit: int = 20, assets=None, canonical=None, rows=None, tenant: str | None = None, collection: str | None = None):
    """What the question's template gives over the record relations (the first target counts): a frame, or several by name.

    canonical(record_type, source_file, timestamp, row_number, payload), assets and rows(record_type, fields) serve the
    templates that ask for them.  With a tenant, only its rows of each relation are read, and of a collection if given.
    """
    from corvane.functions.predicates import in_scope
    from corvane.operators import calls as C
    from corvane.operators import entities as E
    from corvane.operators import evidence as V
    from corvane.operators import overview as O
    from corvane.operators import records as R

    if tenant is not None:
        calls, generic, entities, jobs, assets, canonical, rows = (x if x is None else in_scope(x, tenant, collection) for x in (calls, generic, entities, jobs, assets, canonical, rows))
    p = plan(question)
    target = p.targets[0] if p.targets else ""
    start, stop = (x and x.rstrip("Z") for x in (p.start, p.stop))

    def needed(name, frame):
        if frame is None:
            raise ValueError(f"this question needs the {name}")
        return frame

    def temporal():
        return {"hourly": C.hourly_activity(calls, target), "nocturnal": C.nocturnal_count(calls, target), "duration_stats": C.duration_stats(calls, target), "duration_extremes": C.duration_extremes(calls, target)}

    def quality():
        return {"summary": V.quality_summary(needed("jobs", jobs)), "jobs": jobs.orderBy(*[F.desc(c) for c in ("queued_at", "file_id", "record_type") if c in jobs.columns]).limit(R.clamp(limit))}

    def suspicious():
        t, q = temporal(), quality()
        return {"night_activity": t["nocturnal"], "duration_extremes": t["duration_extremes"], "duration_stats": t["duration_stats"], "data_quality": q["summary"], "recent_quality_jobs": q["jobs"]}

    run = {
        "frequent_contacts": lambda: C.frequent_contacts(calls, target, limit), "call_type_breakdown": lambda: C.call_type_breakdown(calls, target), "hourly_activity": lambda: C.hourly_activity(calls, target),
        "nocturnal_count": lambda: C.nocturnal_count(calls, target), "duration_extremes": lambda: C.duration_extremes(calls, target), "suspicious_patterns": suspicious,
        "activity_by_day": lambda: C.activity_by_day(calls, generic, target, start, stop), "top_locations": lambda: C.top_locations(calls, target, limit), "movement_path": lambda: C.movement_path(calls, target),
        "entity_timeline": lambda: C.entity_timeline(calls, generic, target), "source_records": lambda: {"calls": C.source_records(calls, target, limit), "generic": C.generic_source_records(generic, target, limit)},
        "canonical_records": lambda: canonical_rows(needed("canonical records", canonical), canonical_hints(question), start, stop),
        "entity_activity": lambda: E.entity_activity(entities, target), "first_seen_last_seen": lambda: E.first_seen_last_seen(entities), "relationship_network": lambda: E.relationship_network(entities, target),
        "collection_overview": lambda: O.collection_overview(needed("jobs", jobs), assets, R.clamp(limit)), "data_quality": quality, "schema_profile": lambda: R.schema_of(needed("rows", rows)),
        "anpr_sightings": lambda: C.sightings(generic, target), "case_readiness": lambda: V.case_readiness(needed("jobs", jobs), needed("assets", assets)),
    }
    found = run[ALIASES.get(p.template, p.template)]()
    only = {"shortest_call": "shortest", "longest_call": "longest"}.get(p.template)
    return p, found.where(F.col("metric") == only) if only and "metric" in found.columns else found


@dataclass
class Hints:
    record_type: str | None = None
    source_file: str | None = None
    batch_id: str | None = None
    filters: list[tuple[str, str, str | list[str]]] = field(default_factory=list)
    exists: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    sort: tuple[str, bool] | None = None
    limit: int | None = None
    offset: int | None = None


#: How a comparison is worded.
_OPERATORS = [
    ("gte", r">=|at least|greater than or equal to"), ("lte", r"<=|at most|less than or equal to"), ("gt", r">|greater than|more than|over|above"), ("lt", r"<|less than|under|below"),
    ("ne", r"!=|is not|not equal to|not equals"), ("contains", r"contains|containing|like|includes"), ("in", r"in"), ("eq", r"=|is|equals|equal to"),
]
_TYPES = ("cdr", "ipdr", "anpr", "subscriber", "tower_location", "transaction", "access_log", "generic")


def canonical_hints(question: str) -> Hints:
    """What a question says about the rows it wants: type, file, batch, filters, presence, order and page."""
    h, q = Hints(), question.strip().rstrip("?.")
    low = q.lower()
    h.record_type = next((t for t in _TYPES if re.search(rf"\b{t.replace('_', '[ _]')}s?\b", low)), None)
    for name, pattern in (("source_file", r"source file(?: is| =)?\s+['\"]?([\w.\-]+)"), ("batch_id", r"batch(?: id)?(?: is| =)?\s+['\"]?([\w\-]+)")):
        if m := re.search(pattern, q, re.I):
            setattr(h, name, m[1])
    for m in re.finditer(r"\b(?:where|and|with)\s+([A-Za-z_][\w.]*)\s+(exists|is missing|missing)\b", q, re.I):
        (h.exists if m[2].lower() == "exists" else h.missing).append(m[1])
    rest = re.split(r"\b(?:order by|sorted by|sort by|limit|offset)\b", q, flags=re.I)[0]
    at = re.search(r"\bwhere\b", rest, re.I)
    for clause in re.split(r"\s+and\s+", rest[at.end() :].strip(), flags=re.I) if at else ():
        for op, words in _OPERATORS:
            m = re.match(rf"([A-Za-z_][\w.]*)\s*(?:{words})\s*(?<![\w])(?:['\"]([^'\"]*)['\"]|(.+))$" if op not in ("in", "eq", "ne") else rf"([A-Za-z_][\w.]*)\s+(?:{words})\s+(?:['\"]([^'\"]*)['\"]|(.+))$", clause, re.I)
            if m:
                value = (m[2] if m[2] is not None else m[3]).strip()
                if not re.match(r"missing\b", value, re.I):
                    h.filters.append((m[1], op, [v.strip(" '\"") for v in re.split(r",|\bor\b", value.strip("()"))] if op == "in" else value))
                break
    if m := re.search(r"\b(?:order by|sorted by|sort by)\s+(\w+)(?:\s+(asc|desc)\w*)?", q, re.I):
        h.sort = (m[1], (m[2] or "desc").lower() == "desc")
    for name in ("limit", "offset"):
        if m := re.search(rf"\b{name}\s+(\d+)", low):
            setattr(h, name, int(m[1]))
    return h


def canonical_rows(canonical, hints: Hints, start: str | None = None, stop: str | None = None):
    """Canonical records as a question's hints ask for them: latest first, or by the field named, a page of them."""
    out = canonical
    for column in ("record_type", "source_file", "batch_id"):
        if (wanted := getattr(hints, column)) and column in out.columns:
            out = out.where(F.lower(column) == wanted.lower())
    for bound, op in ((start, ">="), (stop, "<")):
        if bound:
            at = F.lit(bound).try_cast("timestamp_ntz")
            out = out.where(F.col("timestamp").cast("timestamp_ntz") >= at if op == ">=" else F.col("timestamp").cast("timestamp_ntz") < at)
    for name, op, value in hints.filters:
        if name not in ("record_type", "source_file", "batch_id"):
            out = out.where(payload_filter(F.col("payload"), name, op, value))
    for name in hints.exists:
        out = out.where(payload_filter(F.col("payload"), name, "exists"))
    for name in hints.missing:
        out = out.where(payload_filter(F.col("payload"), name, "not_exists"))
    order = [F.col("timestamp").desc_nulls_last(), F.col("source_file"), F.col("row_number")]
    if hints.sort:
        key = F.col(hints.sort[0]).cast("string") if hints.sort[0] in out.columns else payload_value(F.col("payload"), hints.sort[0])
        order = [rank(key).desc() if hints.sort[1] else rank(key).asc(), *order]
    return out.orderBy(*order).offset(clamp_offset(hints.offset)).limit(clamp(hints.limit))
