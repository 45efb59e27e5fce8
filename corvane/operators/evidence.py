"""Ingest quality: families, summaries, readiness, missing assets, errors and evidence roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["total_rows", "accepted_rows", "rejected_rows", "duplicate_rows"]
#: Points that a failing check takes from 100.
PENALTY = {"no_jobs": 35, "no_families": 30, "no_assets": 15, "none_ready": 10, "none_completed": 20, "per_failed": 10, "most_failed": 25, "rejected": (8, 22, 100), "duplicate": (4, 16, 100)}


def record_families(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("record_type").agg(F.count("*").alias("jobs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def quality_summary(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS], F.count_if(F.col("status") == "completed").alias("completed_jobs"), F.count_if(F.col("status").isin("failed", "dead_letter")).alias("failed_jobs"))


def case_readiness(jobs: DataFrame, assets: DataFrame) -> DataFrame:
    """A score of 100 less penalties, and its level; one row from one pass over each table."""
    j = jobs.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status").isin("failed", "dead_letter")).alias("failed"),
        F.count_distinct(F.when(F.col("accepted_rows") > 0, F.col("record_type"))).alias("families"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    a = assets.agg(F.count("*").alias("n_assets"), F.count_if(F.col("structured_status") == "ready").alias("n_ready"))
    p, total = PENALTY, F.greatest(F.col("total_rows"), F.lit(1))
    share = lambda c, least, most, scale: F.when(F.col(c) > 0, least + F.least(F.lit(most), F.floor(F.lit(scale) * F.col(c) / total))).otherwise(0)
    penalty = (
        F.when(F.col("n") == 0, p["no_jobs"]).otherwise(0) + F.when((F.col("families") == 0) | (F.col("accepted_rows") == 0), p["no_families"]).otherwise(0)
        + F.least(F.lit(p["most_failed"]), F.col("failed") * p["per_failed"]) + share("rejected_rows", *p["rejected"]) + share("duplicate_rows", *p["duplicate"])
        + F.when(F.col("n_assets") == 0, p["no_assets"]).when(F.col("n_ready") == 0, p["none_ready"]).otherwise(0) + F.when((F.col("n") > 0) & (F.col("completed") == 0), p["none_completed"]).otherwise(0)
    )
    score = F.greatest(F.lit(0), 100 - penalty).cast("int")
    level = F.when(F.col("score") < 50, "blocked").when(F.col("score") < 75, "needs_review").when(F.col("score") < 90, "usable_with_limitations").otherwise("ready")
    both = j.join(a)  # two tables of one row
    return both.withColumn("score", score).withColumn("level", level).select("score", "level", F.col("n").alias("jobs"), "failed", "families", "n_assets", "n_ready")


def missing_assets(jobs: DataFrame, assets: DataFrame, key: list[str]) -> DataFrame:
    """Completed jobs without an asset."""
    return jobs.where("status = 'completed'").join(assets.select(*key).distinct(), key, "left_anti")


def errors_with_jobs(errors: DataFrame, jobs: DataFrame, key: list[str]) -> DataFrame:
    """Each error beside every job of its file, or alone."""
    return errors.join(jobs, key, "left")


def status_summary(items: DataFrame, status: str, size: str) -> DataFrame:
    """Totals, and counts by status as one list of ``status=count``."""
    by = items.groupBy(F.coalesce(F.col(status), F.lit("unknown")).alias("s")).agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    return by.agg(F.sum("n").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "s", "n"))), ",").alias("by_status"))


#: Modality and confidence by file extension.
MODALITIES = [
    ("tabular", 0.65, ("csv", "tsv", "json", "jsonl", "ndjson", "parquet")),
    ("text", 0.6, ("log",)),
    ("text", 0.55, ("txt", "md")),
    ("document", 0.55, ("pdf",)),
    ("document", 0.5, ("doc", "docx", "rtf", "odt")),
    ("image", 0.5, ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff")),
    ("audio", 0.5, ("wav", "mp3", "m4a", "flac", "ogg", "aac")),
]
SPECIAL_TYPES = ("cdr", "ipdr", "anpr", "subscriber", "tower_location", "transaction", "access_log")


def classify_evidence(file_name: Column, record_type: Column) -> Column:
    """(modality, confidence): a special record type decides first, then the file's extension; else unknown."""
    ext = F.lower(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)$", 1))
    modality, confidence = F.when(record_type.isin(*SPECIAL_TYPES), "structured_records"), F.when(record_type.isin(*SPECIAL_TYPES), 0.9)
    for name, sure, extensions in MODALITIES:
        modality, confidence = modality.when(ext.isin(*extensions), name), confidence.when(ext.isin(*extensions), sure)
    return F.struct(modality.otherwise("unknown").alias("modality"), confidence.otherwise(0.15).cast("decimal(5,4)").alias("confidence"))


def evidence_summary(items: DataFrame) -> DataFrame:
    """One row over items(processing_status, modality, size_bytes): ten counts, the bytes, and counts by status and by
    modality as maps.  Items are counted by both at once, so a few rows are left for the maps."""
    by = items.groupBy("processing_status", "modality").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"))
    status, modality = F.col("processing_status"), F.col("modality")
    count = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    totals = by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("evidence_total"), count(status == "completed").alias("completed"), count(status == "processing").alias("processing"),
        count(status.isin("queued", "registered")).alias("queued"), count(status == "failed").alias("failed"), count(modality == "structured_records").alias("structured_records"),
        count(modality == "document").alias("documents"), count(modality == "image").alias("images"), count(modality == "audio").alias("audio"), count(modality == "video").alias("video"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("total_size_bytes"),
    )

    def counts(column: str) -> DataFrame:
        one = by.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n"))
        return one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"{column.removeprefix('processing_')}_counts"))

    return totals.join(counts("processing_status")).join(counts("modality"))  # tables of one row


def evidence_detail(item: DataFrame, jobs: DataFrame, assets: DataFrame, records: DataFrame, entities: DataFrame, evidence_id: str, limit: int = 20) -> dict[str, DataFrame]:
    """The five frames of one piece of evidence: the item, its jobs and assets newest first, its latest records, and its
    entities by type."""
    mine = lambda df: df.where(F.col("evidence_id") == evidence_id)
    scope = ["tenant_id", "collection_id", "file_id", "batch_id"]
    batches = mine(jobs).select("tenant_id", "collection_id", "file_id", F.col("id").alias("batch_id")).distinct()
    rollup = entities.join(batches, scope, "left_semi").groupBy("entity_type").agg(
        F.count("*").alias("observation_count"), F.count_distinct("entity_value").alias("unique_entities"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
    return {
        "item": mine(item).limit(1), "jobs": mine(jobs).orderBy(F.desc("queued_at")), "assets": mine(assets).orderBy(F.desc("updated_at")),
        "records": mine(records).orderBy(F.desc("timestamp"), "row_number").limit(limit), "entities": rollup.orderBy(F.desc("observation_count"), "entity_type"),
    }
