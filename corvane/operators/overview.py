"""Collections and evidence seen as a whole, schema profiles, repairs, picks, log merges and small signal functions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.evidence import COUNTS, record_families


def evidence_list(items: DataFrame, jobs: DataFrame, assets: DataFrame) -> DataFrame:
    """Evidence beside its jobs and assets, each missing side null."""
    return items.join(jobs, "evidence_id", "left").join(assets, "evidence_id", "left")


def evidence_entities(entities: DataFrame, batches: DataFrame) -> DataFrame:
    """Entities of each piece of evidence: batches(batch_id, evidence_id) tells where rows came from."""
    return entities.join(batches, "batch_id").groupBy("evidence_id", "entity_type").agg(F.count("*").alias("total"), F.count_distinct("entity_value").alias("entities"))


def evidence_search(items: DataFrame, text: str = "", columns: tuple[str, ...] = (), **equal: str) -> DataFrame:
    """Optional equality filters and a text found in any column."""
    for c, v in equal.items():
        if v:
            items = items.where(F.col(c) == v)
    if not text:
        return items
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").ilike(f"%{text}%"), F.lit(False))
    return items.where(hit)


def collection_overview(jobs: DataFrame, assets: DataFrame | None = None, limit: int = 20) -> dict[str, DataFrame]:
    """A collection's latest jobs and assets, the newest first, and its record families, those of most rows first."""
    pick = lambda df, names: [c for c in names if c in df.columns]
    latest = jobs.orderBy(*[F.desc_nulls_last(c) for c in pick(jobs, ("queued_at",))], *pick(jobs, ("source_file", "file_id", "record_type"))).limit(limit)
    shown = latest.select(*pick(jobs, ("source_file", "file_id", "record_type", "status", *COUNTS, "queued_at", "completed_at")))
    out = {"jobs": shown, "record_families": record_families(jobs).orderBy(F.desc("total_rows"), "record_type")}
    if assets is not None:
        newest = assets.orderBy(*[F.desc_nulls_last(c) for c in pick(assets, ("created_at",))], *pick(assets, ("source_file", "file_id"))).limit(limit)
        out["assets"] = newest.select(*(pick(assets, ("source_file", "file_id", "detected_record_type", "structured_status", "rag_status", "source_entry", "size_bytes", "created_at")) or assets.columns))
    return out


def collection_status(jobs: DataFrame, assets: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of independent counts, each from one pass over its table."""
    j = jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    a = assets.agg(F.count("*").alias("assets"), F.count_if(F.col("structured_status") == "ready").alias("ready"))
    return j.join(a).join(errors.agg(F.count("*").alias("errors")))  # tables of one row


def repaired_assets(jobs: DataFrame, assets: DataFrame, key: list[str]) -> DataFrame:
    """Assets with those added that completed jobs lack."""
    done = jobs.where("status = 'completed'").select(*key).distinct().join(assets.select(*key).distinct(), key, "left_anti")
    return assets.unionByName(done.withColumn("structured_status", F.lit("ready")), allowMissingColumns=True)


def schema_profile(rows: DataFrame, payload: str) -> DataFrame:
    """Keys of a JSON column: in how many rows, and how many of their values are numbers."""
    pairs = rows.select(F.explode(F.from_json(payload, "map<string,string>")).alias("field", "value"))
    return pairs.groupBy("field").agg(F.count("*").alias("rows"), F.count(F.col("value").try_cast("bigint")).alias("numbers"))


def enriched(rows: DataFrame, values: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with columns filled from values where they have none."""
    new = values.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(new, key, "left").select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def preferred_replica(replicas: DataFrame, node_id, replica_id) -> DataFrame:
    """The replica asked for if it is there, else the least busy, longest unused, on most free memory."""
    asked = F.when((F.col("node_id") == node_id) & (F.col("replica_id") == replica_id), 0).otherwise(1)
    return replicas.orderBy(asked, "in_flight", "last_used", F.desc("free_memory"), "node_id", "replica_id").limit(1)


def merged_log(lines: DataFrame, model: str) -> DataFrame:
    """Lines of a model's log, or of all its replicas' (``model#n``) where it has none of its own, by time."""
    own = lines.where(F.col("key") == model)
    source = own if own.limit(1).count() else lines.where(F.col("key").startswith(f"{model}#"))
    return source.orderBy("ts", "key", "seq")


def fixed_blocks(usage: DataFrame, time: str = "created_at", days: int = 30) -> DataFrame:
    """Usage by blocks of days counted from year 1, each under the month in which it begins."""
    epoch = 719162  # days from 0001-01-01 to 1970-01-01
    day = F.unix_date(F.to_date(time)) + epoch
    start = F.date_from_unix_date((F.floor(day / days) * days - epoch).cast("int"))
    return usage.groupBy(F.date_format(start, "yyyy-MM").alias("bucket"), "model").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("requests"))


def rolled_buckets(buckets: DataFrame, by: str) -> DataFrame:
    """Bucketed usage summed again by model, user or bucket."""
    return buckets.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "requests")])


def rms(samples: Column) -> Column:
    return F.when(F.size(samples) > 0, F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples))).otherwise(0.0)


def resampled(samples: Column, rate_in: int, rate_out: int) -> Column:
    """Samples at another rate by linear interpolation."""
    n = F.floor(F.size(samples) * F.lit(rate_out) / rate_in).cast("int")
    place = lambda i: i * F.lit(rate_in / rate_out)
    low = lambda i: F.least(F.floor(place(i)).cast("int"), F.size(samples) - 1)
    value = lambda i: F.get(samples, low(i)) + (F.get(samples, F.least(low(i) + 1, F.size(samples) - 1)) - F.get(samples, low(i))) * (place(i) - low(i))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), value)).otherwise(F.array().cast("array<double>"))


def future_labels(last: str, period: str, count: int) -> list[str]:
    """Labels of the buckets after the last one."""
    layout, step = {"day": ("%Y-%m-%d %H:%M", timedelta(hours=1)), "week": ("%Y-%m-%d", timedelta(days=1)), "month": ("%Y-%m-%d", timedelta(days=1)), "all": ("%Y-%m", None)}[period]
    at, out = datetime.strptime(last, layout), []
    for _ in range(count):
        at = at + step if step else (at.replace(day=28) + timedelta(days=4)).replace(day=1)
        out.append(at.strftime(layout))
    return out


def cron_due(last_run: datetime | None, now: datetime, interval: timedelta, running: bool) -> bool:
    """A job is due if none of it is pending or running and a whole interval has gone since its last run."""
    return not running and (last_run is None or now - last_run >= interval)


def nonempty_networks(networks: DataFrame, arrays: str) -> DataFrame:
    """Rows with a non-empty nested array, those with most of them first."""
    return networks.where(F.exists(arrays, lambda a: F.size(a) > 0)).orderBy(F.size(arrays).desc(), "id")


def ranked(results: DataFrame, score: str, top_n: int, tie: str) -> DataFrame:
    return results.orderBy(F.desc(score), tie).limit(max(1, top_n))


def reranked(items: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """Items by the scores(index, score) that a reranker gave them by their place ``index``; those without one are left out,
    and a place that is none of an item's is passed over."""
    return ranked(items.join(scores.groupBy("index").agg(F.max("score").alias("score")), "index"), "score", top_n, "index")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, as for one citation of each source."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def assets_in_order(assets: DataFrame, limit: int = 20) -> DataFrame:
    """Mirrored assets first, then the last updated."""
    return assets.orderBy(F.when(F.col("rag_status") == "mirrored", 0).otherwise(1), F.desc("updated_at"), "asset_id").limit(limit)


def preview(c: Column, most: int) -> Column:
    """The text, or its beginning with a mark that it was cut."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def first_with_rows(*frames: DataFrame) -> DataFrame:
    """The first frame that has a row, as for evidence from vectors, else words, else the catalogue."""
    for df in frames[:-1]:
        if df.limit(1).count():
            return df
    return frames[-1]
