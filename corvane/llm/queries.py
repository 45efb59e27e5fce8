"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import decontaminate, pieces, pii, quality, resharding, rollups, rules, runs, simhash, toxicity, urls, warc, whitening
from corvane.llm.common import held_out, table, written


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 0.5)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.train(docs))
    return found.select("doc_id", "found.n_email", "found.n_ip", "found.n_card", "found.n_phone", "found.base_sha256", "found.spans", "found.n_added")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels"))), 0.3)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated_pairs(docs, table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.deduplicated(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encoded.select("doc_id", "encoded.n_pieces", "encoded.ids_sha256", "encoded.lossless")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter (the batch is sent twice), those with repeated lines get the counts of their distinct lines,
    then exact copies of a document with a smaller id leave."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    store = rollups.Store(spark)
    load = rollups.counted(docs)
    store.apply("load", load)
    store.apply("load", load)
    lines = F.split("text", "\n")
    again = docs.where(F.size(F.array_distinct(lines)) < F.size(lines))
    store.apply("distinct/lines", rollups.counted(again.withColumn("text", F.array_join(F.array_distinct(lines), "\n"))))
    keys = docs.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"), "source", "lang").where("h IS NOT NULL")
    first = written(keys.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    copies = keys.join(first, "h").where("doc_id <> first")
    store.apply("copies", copies.select(F.lit("delete").alias("op"), "doc_id", "source", "lang", F.lit(rollups.VERSION).alias("tokenizer"), F.lit(0).alias("n_chars"), F.lit(0).alias("n_tokens")))
    return store.totals()


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    found = whitening.whiten(rows, model)
    n, error, explained = (model.n, model.identity_error, model.explained()) if model else (0, None, [])
    share = F.array(*[F.lit(e).cast("double") for e in explained]) if explained else F.array().cast("array<double>")
    return found.select("vec_id", "whitened.deviation", F.posexplode("whitened.values").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened", F.get(share, "k").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


#: Words of a text, as the contract has them.
WORDS = r"[^\x20\x09-\x0D]+"


def _cycled(text: Column, doc_id: Column) -> Column:
    """The text; for one document in ten, from some word on a cycle of its own words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    root = F.slice(words, a + 1, p)
    cycle = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), cycle), " ")).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _cycled(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.mark_runs(docs).select("doc_id", "periodic.runs", "periodic.collapsed").withColumn("best", runs.strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")], F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of documents, dealt to 16 old shards, move to 24 shards of near equal bytes; the rows come from the files written."""
    rows = resharding.reshard(spark, f"{sf_dir}/documents.parquet").rows()
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select("doc_id", resharding.text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_quality_classifier, op4_decontamination, op5_warc, op6_url_filters, op7_quality_rules, op8_pieces, op9_simhash, op10_token_counts, op11_whitening, op12_runs, op13_resharding, pipeline)}
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
        b AS (SELECT row_number() OVER () AS b, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
        items AS (
            SELECT *, count(*) OVER (PARTITION BY b) AS n FROM (
                SELECT DISTINCT b, item_id, least(len(w), 5) AS width, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS shingle
                FROM b, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0)
        ), cut AS (
            SELECT DISTINCT d, doc_id, width, array_to_string(w[i : i + width - 1], ' ') AS shingle
            FROM d, (SELECT DISTINCT width FROM items) AS s, unnest(range(1, len(w) - width + 2)) AS t(i) WHERE len(w) >= width
        ), found AS (
            SELECT d, b, doc_id, item_id, n, count(*) AS c FROM cut JOIN items USING (width, shingle) GROUP BY ALL HAVING count(*) >= 0.8 * n
        )
        SELECT DISTINCT ON (doc_id, item_id) doc_id, item_id, n AS n_shingles, c AS n_shared FROM found ORDER BY doc_id, item_id, c DESC, n DESC""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT h, max(page_id) AS original, count(*) AS c FROM p WHERE n >= 1000 GROUP BY h)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN c > 1 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN c > 1 AND page_id <> original THEN original END AS refers_to
        FROM p LEFT JOIN g USING (h)""",
    "op6_url_filters": f"""
        WITH u AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
        ), r AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in urls.RULES)}) AS t(rule_host, start, action)),
        fits AS (
            SELECT page_id, rule_host || start AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || start) DESC, length(rule_host) DESC) AS place
            FROM u JOIN r ON ends_with('.' || host, '.' || rule_host) AND starts_with(path, start)
        ), listed AS (
            SELECT page_id FROM u WHERE {" OR ".join(f"ends_with('.' || host, '.{h}')" for h in urls.BLOCKED_HOSTS)}
                OR list_has_any(string_split(replace(host, '-', '.'), '.'), [{", ".join(f"'{w}'" for w in urls.BLOCKED_WORDS)}]))
        SELECT u.page_id, host, path, rule, coalesce(action, CASE WHEN listed.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM u LEFT JOIN fits ON fits.page_id = u.page_id AND place = 1 LEFT JOIN listed ON listed.page_id = u.page_id""",
    "op7_quality_rules": rf"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                   length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS s FROM w, unnest(range(1, len(words) - 3)) AS t(i)
        ), again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, unnest(range(0, 5)) AS t(j) GROUP BY doc_id),
        base AS (
            SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
                   len(list_filter(words, lambda x: lower(rtrim(x, '.,;:!?')) IN ({", ".join(f"'{x}'" for x in rules.STOP_WORDS)}))) AS n_stop,
                   len(list_filter(words, lambda x: regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$'))) AS n_upper,
                   len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet,
                   len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) AS n_ellipsis
            FROM w LEFT JOIN covered USING (doc_id)
        ), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.01
               AND n_upper / n_words <= 0.5 AND n_dup_lines / n_lines <= 0.5 AND n_bullet / n_lines <= 0.9 AND n_ellipsis / n_lines <= 0.3 AS kept
        FROM judged""",
}
