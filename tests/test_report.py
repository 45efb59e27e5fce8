from corvane.plans import report as P
from corvane.sources.views import calls, entities, generic, jobs


def test_the_report_of_a_collection(spark, data):
    from corvane.plans.record_queries import _assets

    rows = spark.createDataFrame([("cdr", {"a": "1"})], "record_type string, fields map<string,string>")
    errors = spark.createDataFrame([("f|1", 3, "bad\nnumber")], "file_id string, row_number int, message string")
    found, text = P.case_report("col1", calls(spark, data), generic(spark, data), entities(spark, data), jobs(spark, data), target="7", warnings=["slow"], assets=_assets(spark, data), rows=rows, errors=errors)
    assert set(found) == {"overview", "frequent_contacts", "temporal_activity", "top_locations", "entity_activity", "anpr_sightings", "relationship_network", "entity_timeline", "source_records", "schema_profile", "data_quality", "case_readiness", "evidence"}
    for title in ("Findings", "Confidence", "Readiness", "Ingest jobs", "Record families", "Frequent contacts", "Activity by hour", "Durations", "Top locations", "Timeline", "Limits", "Next steps", "Warnings"):
        assert f"## {title}\n" in text, title
    assert "- Target: 7" in text and "f\\|1" in text and "bad number" in text and "No evidence was found" in text and "index documents" in text
    assert all(len(r) <= 24 for part in found.values() for r in part.values())
    total = sum(x["total_rows"] for x in found["overview"]["record_families"])
    assert f"hold {total} rows" in text and f"{found['data_quality']['summary'][0]['rejected_rows']} rows were rejected" in text


def test_a_report_of_nothing(spark, data):
    none = [df.limit(0) for df in (calls(spark, data), generic(spark, data), entities(spark, data), jobs(spark, data))]
    evidence = spark.createDataFrame([("note", "text")], "source string, preview string")
    found, text = P.case_report("empty", *none, evidence=evidence)
    assert "1 previews of evidence" in text and "## Ingest jobs" not in text and "Medium for evidence" in text and "index documents" not in text
    assert "No structured rows" in "\n".join(P.limits({s: {f: [] for f in part} for s, part in found.items()}))
    assert P.confidence({}) == ["Low: no rows and no evidence were found."]
