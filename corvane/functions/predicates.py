"""Predicates shared by the record templates, each a Column built from values that are never put into query text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def phone_match(c: Column, target: str) -> Column:
    """Equal digits, for targets of eight digits or more."""
    wanted = "".join(x for x in target if x in "0123456789")
    return digits(c) == wanted if len(wanted) >= 8 else F.lit(False)


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def target_in(target: str, columns: list[str], wildcard: list[str] = (), extra: list[Column] = ()) -> Column:
    """No target: all rows.  Otherwise exact or digit-wise equality on columns, or text found in the wildcard ones."""
    if not target:
        return F.lit(True)
    exact = [F.col(c) == target for c in columns] + [phone_match(F.col(c), target) for c in columns]
    return F.coalesce(any_of(exact + [F.col(c).ilike(f"%{target}%") for c in wildcard] + list(extra)), F.lit(False))


def between(c: str, start: str | None = None, stop: str | None = None) -> Column:
    """Half-open [start, stop); an empty bound is none."""
    out = F.lit(True)
    if start:
        out = out & (F.col(c) >= F.lit(start).cast("timestamp_ntz"))
    if stop:
        out = out & (F.col(c) < F.lit(stop).cast("timestamp_ntz"))
    return out


def clamp(limit: int | None, default: int = 20, most: int = 100) -> int:
    return default if not limit or limit < 1 else min(limit, most)


def clamp_offset(offset: int | None, most: int = 100_000) -> int:
    return min(max(0, offset or 0), most)


def payload_value(payload: Column, key: str) -> Column:
    """The value of a key in a text map: exact name, else the first name equal without regard to case."""
    other = F.element_at(F.map_values(F.map_filter(payload, lambda k, _: F.lower(k) == key.lower())), 1)
    return F.coalesce(F.try_element_at(payload, F.lit(key)), F.when(F.size(F.map_filter(payload, lambda k, _: F.lower(k) == key.lower())) > 0, other))


def payload_filter(payload: Column, key: str, op: str, value=None) -> Column:
    """eq, ne (absent passes), contains, in, gt, gte, lt, lte (numbers only), exists, not_exists."""
    found = payload_value(payload, key)
    present = F.exists(F.map_keys(payload), lambda k: F.lower(k) == key.lower())
    if op in ("exists", "not_exists"):
        return present if op == "exists" else ~present
    if op == "eq":
        return F.coalesce(found == value, F.lit(False))
    if op == "ne":
        return F.coalesce(found != value, F.lit(True))
    if op == "contains":
        return F.coalesce(found.ilike(f"%{value}%"), F.lit(False))
    if op == "in":
        return F.coalesce(found.isin([str(v) for v in value]), F.lit(False))
    if op in ("gt", "gte", "lt", "lte"):
        number = F.when(found.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), found.try_cast("double"))
        wanted = float(value)
        return F.coalesce({"gt": number > wanted, "gte": number >= wanted, "lt": number < wanted, "lte": number <= wanted}[op], F.lit(False))
    raise ValueError(f"unknown operator {op}")


def in_scope(df, tenant: str, collection: str | None = None):
    """The rows of one tenant and, if given, one of its collections; a blank tenant has no rows."""
    out = df.where(F.col("tenant_id") == tenant) if tenant else df.limit(0)
    return out.where(F.col("collection_id") == collection) if collection else out
