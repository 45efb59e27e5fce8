"""A collection's report: the frames of twelve templates, what they show, how far they can be trusted, and what to do next.

Every value comes from a frame of at most some rows; nothing is inferred beyond them.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame

from corvane.operators import calls as C
from corvane.operators import entities as E
from corvane.operators import evidence as V
from corvane.operators import overview as O
from corvane.operators import records as R
from corvane.sources.store import formatted

#: Sections in order: (title, section, frame, rows at most).
TABLES = [
    ("Readiness", "case_readiness", "readiness", 1), ("Ingest jobs", "overview", "jobs", 8), ("Record families", "overview", "record_families", 8), ("Assets", "overview", "assets", 8), ("Fields by record type", "schema_profile", "fields", 8),
    ("Data quality", "data_quality", "summary", 1), ("Recent errors", "data_quality", "errors", 10), ("Frequent contacts", "frequent_contacts", "contacts", 10), ("Activity by hour", "temporal_activity", "hourly", 24),
    ("Durations", "temporal_activity", "duration_stats", 1), ("Shortest and longest", "temporal_activity", "duration_extremes", 2), ("At night", "temporal_activity", "nocturnal", 1), ("Top locations", "top_locations", "locations", 10),
    ("Entities", "entity_activity", "entities", 10), ("Relationships", "relationship_network", "network", 10), ("Timeline", "entity_timeline", "timeline", 15), ("Sightings", "anpr_sightings", "sightings", 10),
    ("Source rows of calls", "source_records", "calls", 8), ("Source rows of other records", "source_records", "generic", 8), ("Evidence", "evidence", "previews", 8),
]


def frames(calls: DataFrame, generic: DataFrame, entities: DataFrame, jobs: DataFrame, assets: DataFrame | None = None, rows: DataFrame | None = None, errors: DataFrame | None = None, evidence: DataFrame | None = None, target: str = "", limit: int = 10) -> dict[str, dict[str, DataFrame]]:
    """The frames of each section; those whose relation is not at hand are left out."""
    given = lambda **x: {k: v for k, v in x.items() if v is not None}
    return {
        "overview": O.collection_overview(jobs, assets, limit),
        "frequent_contacts": {"contacts": C.frequent_contacts(calls, target, limit)},
        "temporal_activity": {"hourly": C.hourly_activity(calls, target), "nocturnal": C.nocturnal_count(calls, target), "duration_stats": C.duration_stats(calls, target), "duration_extremes": C.duration_extremes(calls, target)},
        "top_locations": {"locations": C.top_locations(calls, target, limit)},
        "entity_activity": {"entities": E.entity_activity(entities, target, limit)},
        "anpr_sightings": {"sightings": C.sightings(generic, target)},
        "relationship_network": {"network": E.relationship_network(entities, target, limit)},
        "entity_timeline": {"timeline": C.entity_timeline(calls, generic, target)},
        "source_records": {"calls": C.source_records(calls, target, limit), "generic": C.generic_source_records(generic, target, limit)},
        "schema_profile": given(fields=None if rows is None else R.schema_of(rows)),
        "data_quality": given(summary=V.quality_summary(jobs), errors=errors),
        "case_readiness": given(readiness=None if assets is None else V.case_readiness(jobs, assets)),
        "evidence": given(previews=evidence),
    }


def collected(sections: dict[str, dict[str, DataFrame]]) -> dict[str, dict[str, list[dict]]]:
    """The first rows of each frame, as many as its table shows."""
    most = {(section, frame): n for _, section, frame, n in TABLES}
    return {s: {f: [r.asDict(recursive=True) for r in formatted(df).limit(most.get((s, f), 10)).collect()] for f, df in part.items()} for s, part in sections.items()}


def _rows(found: dict, section: str, frame: str) -> list[dict]:
    return found.get(section, {}).get(frame, [])


def _one(found: dict, section: str, frame: str) -> dict:
    return next(iter(_rows(found, section, frame)), {})


def findings(found: dict) -> list[str]:
    """What the frames show, each a statement of values in them."""
    out = []
    families, contacts, places = (_rows(found, *k) for k in (("overview", "record_families"), ("frequent_contacts", "contacts"), ("top_locations", "locations")))
    if families:
        out.append(f"{len(families)} record families hold {sum(int(f['total_rows'] or 0) for f in families)} rows.")
    if jobs := _rows(found, "overview", "jobs"):
        out.append(f"{len(jobs)} ingest jobs are shown, the latest first.")
    if contacts:
        first = list(contacts[0].items())
        out.append("Most frequent contact: " + ", ".join(f"{k} {v}" for k, v in first[:3]) + ".")
    if places:
        out.append("Most frequent location: " + ", ".join(f"{k} {v}" for k, v in list(places[0].items())[:2]) + ".")
    if quality := _one(found, "data_quality", "summary"):
        out.append(f"{quality['rejected_rows']} rows were rejected and {quality['duplicate_rows']} were duplicates.")
    if ready := _one(found, "case_readiness", "readiness"):
        out.append(f"Readiness is {ready['level']}, with a score of {ready['score']}.")
    if evidence := _rows(found, "evidence", "previews"):
        out.append(f"{len(evidence)} previews of evidence are attached.")
    return out


def confidence(found: dict) -> list[str]:
    out = []
    if any(rows for part in found.values() for rows in part.values()):
        out.append("High for values in the tables: each is computed by a fixed template.")
    if ready := _one(found, "case_readiness", "readiness"):
        out.append(f"The collection is {ready['level']} by checks of its jobs, quality and assets.")
    if _rows(found, "evidence", "previews"):
        out.append("Medium for evidence: it depends on what was indexed.")
    return out or ["Low: no rows and no evidence were found."]


def limits(found: dict) -> list[str]:
    out = []
    if not any(rows for s, part in found.items() if s not in ("data_quality", "case_readiness") for rows in part.values()):
        out.append("No structured rows were found.")
    if not _rows(found, "evidence", "previews"):
        out.append("No evidence was found, or none was asked for.")
    quality, ready = _one(found, "data_quality", "summary"), _one(found, "case_readiness", "readiness")
    if int(quality.get("rejected_rows") or 0):
        out.append("Rejected rows may leave gaps until they are mended and taken in again.")
    if int(quality.get("failed_jobs") or 0):
        out.append("Some ingest jobs failed; their files are missing from all tables.")
    if ready.get("level") in ("blocked", "needs_review"):
        out.append("The readiness checks ask for repairs before this is used outside.")
    return [*out, "Nothing is inferred beyond the rows returned."]


def next_steps(found: dict) -> list[str]:
    out = ["Check the source rows and files of each finding before it is used outside.", "Mend rejected rows, duplicate uploads and failed jobs, and run the templates again.", "Look into single entities by timeline, relationships and source rows."]
    return out if _rows(found, "evidence", "previews") else [*out, "Add or index documents where evidence in words is needed."]


def _cell(v) -> str:
    return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")


def markdown(collection: str, found: dict, target: str = "", warnings: list[str] = (), at: datetime | None = None) -> str:
    at = at or datetime.now(timezone.utc)
    out = ["# Collection report", "", f"- Made at: {at.strftime('%Y-%m-%dT%H:%M:%SZ')}", f"- Collection: {_cell(collection)}", *([f"- Target: {_cell(target)}"] if target else []), ""]
    lists = lambda title, lines: [f"## {title}", "", *[f"- {_cell(x)}" for x in lines], ""] if lines else []
    out += lists("Findings", findings(found)) + lists("Confidence", confidence(found))
    for title, section, frame, most in TABLES:
        if rows := _rows(found, section, frame)[:most]:
            out += [f"## {title}", "", "| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0])]
            out += ["| " + " | ".join(map(_cell, r.values())) + " |" for r in rows] + [""]
    out += lists("Limits", limits(found)) + lists("Next steps", next_steps(found)) + lists("Warnings", list(warnings))
    return "\n".join(out)


def case_report(collection: str, calls: DataFrame, generic: DataFrame, entities: DataFrame, jobs: DataFrame, target: str = "", warnings: list[str] = (), **given) -> tuple[dict, str]:
    """(rows of each section, the report as Markdown) of a collection; ``given`` are the other relations of ``frames``."""
    found = collected(frames(calls, generic, entities, jobs, target=target, **given))
    return found, markdown(collection, found, target, warnings)
