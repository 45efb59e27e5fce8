"""Field names: canonical names, record types by their fields, and roles of columns by their values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names under which each canonical field is known.
ALIASES = {
    "timestamp": ("timestamp", "time", "datetime", "date_time", "event_time", "event_timestamp", "start_time", "started_at", "call_time", "call_datetime", "sighting_time", "access_time", "transaction_time", "txn_time", "logged_at"),
    "date": ("date", "call_date", "event_date", "sighting_date", "transaction_date", "txn_date"),
    "duration_seconds": ("duration", "duration_sec", "duration_secs", "duration_seconds", "call_duration", "call_duration_sec", "call_duration_seconds", "billsec", "seconds"),
    "source_number": ("source_number", "src_number", "from_number", "calling_number", "caller", "a_number", "msisdn_a", "originating_number", "originator", "source_msisdn"),
    "target_number": ("target_number", "dst_number", "to_number", "called_number", "callee", "b_number", "msisdn_b", "terminating_number", "recipient", "target_msisdn"),
    "msisdn": ("msisdn", "phone", "phone_number", "mobile", "mobile_number", "subscriber_number"),
    "imsi": ("imsi", "subscriber_imsi"),
    "imei": ("imei", "device_imei", "handset_imei"),
    "cell_id": ("cell_id", "cellid", "cid", "cgi", "tower_id", "site_id", "enodeb", "eci"),
    "lac": ("lac", "location_area_code", "tac"),
    "area": ("area", "region", "zone", "city", "district", "sector"),
    "status": ("status", "call_status", "result", "disposition", "response_status"),
    "roaming": ("roaming", "is_roaming", "roam", "roaming_flag"),
    "call_type": ("call_type", "direction", "event_type", "cdr_type", "service_type"),
    "plate_number": ("plate", "plate_number", "license_plate", "licence_plate", "registration", "registration_no", "reg_no", "vehicle_registration", "vrn", "anpr"),
    "location": ("location", "camera_location", "site_location", "address", "place", "checkpoint"),
    "camera_id": ("camera", "camera_id", "camera_name", "checkpoint_id", "lane_camera"),
    "latitude": ("lat", "latitude", "gps_lat", "y"),
    "longitude": ("lon", "lng", "longitude", "gps_lon", "gps_lng", "x"),
    "ip": ("ip", "ip_address", "subscriber_ip", "user_ip"),
    "source_ip": ("source_ip", "src_ip", "srcaddr", "client_ip", "origin_ip"),
    "target_ip": ("target_ip", "destination_ip", "dst_ip", "dstaddr", "server_ip"),
    "source_port": ("source_port", "src_port", "sport"),
    "target_port": ("target_port", "destination_port", "dst_port", "dport"),
    "bytes": ("bytes", "byte_count", "total_bytes", "bytes_total", "octets"),
    "upload_bytes": ("upload_bytes", "bytes_up", "tx_bytes", "uplink_bytes"),
    "download_bytes": ("download_bytes", "bytes_down", "rx_bytes", "downlink_bytes"),
    "subscriber_name": ("name", "subscriber_name", "customer_name", "owner_name", "full_name"),
    "identifier": ("id", "identifier", "national_id", "cnic", "nic", "passport", "customer_id"),
    "account": ("account", "account_no", "account_number", "wallet", "iban"),
    "counterparty": ("counterparty", "beneficiary", "merchant", "receiver", "sender"),
    "transaction_id": ("transaction_id", "txn_id", "tx_id", "reference", "reference_no", "rrn"),
    "amount": ("amount", "txn_amount", "transaction_amount", "value", "debit", "credit"),
    "currency": ("currency", "ccy"),
    "http_method": ("method", "http_method", "verb"),
    "path": ("path", "url", "uri", "endpoint", "request_path"),
    "user_agent": ("user_agent", "ua", "browser"),
    "user": ("user", "username", "user_id", "login", "actor", "principal"),
}
#: Canonical fields that speak for a record type, in order of precedence.
SIGNALS = {
    "cdr": ("source_number", "target_number", "duration_seconds", "call_type", "cell_id", "imei", "imsi"),
    "anpr": ("plate_number", "camera_id", "location", "sighting_time", "timestamp"),
    "ipdr": ("source_ip", "target_ip", "ip", "source_port", "target_port", "bytes", "upload_bytes", "download_bytes"),
    "subscriber": ("msisdn", "subscriber_name", "identifier", "account", "imsi", "imei"),
    "tower_location": ("cell_id", "lac", "latitude", "longitude", "area", "location"),
    "transaction": ("transaction_id", "amount", "currency", "account", "counterparty"),
    "access_log": ("http_method", "path", "status", "ip", "source_ip", "user_agent", "user"),
}
#: For each record type, groups of headers of which it needs one each, in order of precedence.
REQUIRED = [
    ("cdr", [("source_number", "src_number", "from_number", "calling_number", "caller"), ("target_number", "dst_number", "to_number", "called_number", "callee"), ("timestamp", "call_time", "call_start_ts", "call_start_dt_tm", "call_start_time", "duration_seconds", "call_type")]),
    ("cdr", [("msisdn",), ("call_start_dt_tm", "call_start_time"), ("call_dialed_num", "dialed_number")]),
    ("anpr", [("plate", "plate_number", "license_plate", "registration_number")]),
    ("ipdr", [("source_ip", "src_ip", "ip_address"), ("destination_ip", "dst_ip", "dest_ip")]),
    ("subscriber", [("msisdn", "phone_number", "subscriber_number"), ("cnic", "customer_id", "subscriber_id", "name")]),
    ("tower_location", [("cell_id", "cell_site_id", "site_id"), ("lat", "latitude"), ("longitude", "lon", "lng")]),
    ("transaction", [("amount", "transaction_amount"), ("account", "account_number", "from_account", "sender")]),
    ("access_log", [("ip", "source_ip", "src_ip"), ("user", "username", "user_id", "path", "url")]),
]
_CANONICAL = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
#: What a value of a role looks like, and how much a value counts.
LOOKS = {
    "email": (1.0, r"(?i)^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"),
    "ipv4": (1.0, r"^(?:\d{1,3}\.){3}\d{1,3}$"),
    "ipv6": (1.0, r"(?i)^(?:[a-f0-9]{0,4}:){2,7}[a-f0-9]{0,4}$"),
    "phone": (1.0, r"^\+?\d(?:[\s().\-]?\d){9,18}$"),
    "imei_imsi": (0.85, r"^\d{14,15}$"),
    "vehicle": (0.7, r"(?i)^[A-Z0-9][A-Z0-9\- ]{3,12}[A-Z0-9]$"),
}
#: What a field's name hints at, and how much that counts.
HINTS = {
    "timestamp": (0.15, "time|date|_at$|_ts$|_tm$"),
    "phone": (0.2, "msisdn|phone|mobile|caller|callee|dialed"),
    "ip": (0.2, "ip"),
    "email": (0.2, "mail"),
    "imei_imsi": (0.2, "imei|imsi"),
    "vehicle": (0.2, "plate|vehicle|registration"),
    "identifier": (0.1, "id|target|entity|account|user"),
}
#: A field of a lower score is text.
LEAST_SCORE = 0.3
ROLES = ("phone", "email", "ip", "imei_imsi", "vehicle", "identifier", "timestamp")


def normalise(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def canonical(name: str) -> str:
    own = normalise(name)
    return _CANONICAL.get(own, own)


def record_type_by_signals(fields: list[str]) -> str:
    """The type with most signals among the fields, two at least; of equal ones the first."""
    names = {canonical(f) for f in fields}
    scores = {kind: len(names & set(signals)) for kind, signals in SIGNALS.items()}
    best = max(scores, key=scores.get)
    return best if scores[best] >= 2 else "generic"


def record_type_by_headers(headers: list[str], wanted: str | None = None) -> str:
    """The first type of which every group has a header; a type asked for whose groups lack one is an error."""
    seen = {normalise(h) for h in headers}
    fits = [kind for kind, groups in REQUIRED if all(seen & set(g) for g in groups)]
    if wanted and wanted not in ("generic", *fits):
        raise ValueError(f"the columns of {wanted} are missing")
    return wanted or (fits[0] if fits else "generic")


def column_roles(rows: DataFrame, sample: int = 500) -> DataFrame:
    """(field, role, score) of each field of rows(fields): what its name hints at and its values look like.

    At most ``sample`` rows are looked at.
    """
    from corvane.operators.ingest import parse_time

    cells = rows.limit(sample).select(F.explode("fields").alias("field", "v")).where("trim(v) <> ''")
    v = F.trim("v")
    number = F.regexp_replace(v, "[^0-9]", "")
    like = lambda kind, c: c.rlike(LOOKS[kind][1]).cast("double") * LOOKS[kind][0]
    points = {
        "timestamp": parse_time(v).isNotNull().cast("double"),
        "email": like("email", v),
        "ip": F.greatest(like("ipv4", v), like("ipv6", v)),
        "phone": F.when(F.char_length(number).between(10, 15), like("phone", v)).otherwise(0.0),
        "imei_imsi": like("imei_imsi", number),
        "vehicle": F.when(v.rlike(r"^\d+$"), 0.0).otherwise(like("vehicle", v)),
        "identifier": F.lit(0.0),
    }
    votes = cells.groupBy("field").agg(*[F.avg(c).alias(k) for k, c in points.items()])
    name = F.lower(F.col("field"))
    scored = F.array(*[F.struct((F.col(k) + F.when(name.rlike(HINTS[k][1]), HINTS[k][0]).otherwise(0.0)).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("role")) for i, k in enumerate(ROLES)])
    best = votes.select("field", F.array_max(scored).alias("b"))
    return best.select("field", F.when(F.col("b.score") < LEAST_SCORE, "text").otherwise(F.col("b.role")).alias("role"), F.round("b.score", 4).alias("score"))


def targets_of(roles: DataFrame) -> tuple[str | None, str | None]:
    """The first and second fields that can name a target, in order of the roles."""
    rows = roles.where(F.col("role").isin(*ROLES[:-1])).collect()  # one row for each column of a file
    order = sorted(rows, key=lambda r: (ROLES.index(r["role"]), -r["score"], r["field"]))
    return (order[0]["field"] if order else None), (order[1]["field"] if len(order) > 1 else None)
