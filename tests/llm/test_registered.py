"""The registered queries over the smallest tables: rows against SQL, and the columns that they promise."""

import os

import duckdb
import pytest

from corvane.llm import queries as Q
from corvane.llm import rollups

COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted", "op2_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans n_added", "op3_quality_classifier": "doc_id held_out score predicted",
    "op8_pieces": "doc_id n_pieces ids_sha256 lossless", "op9_simhash": "doc_id fingerprint component_id", "op10_token_counts": "source lang tokenizer n_docs n_chars n_tokens",
}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, data, duck, name):
    df = Q.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    cur = duck.execute(Q.ORACLE_SQL[name])
    found = [c[0] for c in cur.description]
    assert sorted(found) == cols
    want = sorted(str(tuple(r[found.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name].split()
    rows = df.collect()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    if name == "op10_token_counts":
        assert sum(r["n_docs"] for r in rows) == docs.select("text").distinct().count()
    else:
        assert len(rows) == docs.count()
    if "predicted" in df.columns:
        least = {"op1_toxicity": 0.5, "op3_quality_classifier": 0.3}[name]
        assert all(r["predicted"] == (r["score"] >= least) for r in rows)
        labels = {r["doc_id"]: r["toxic" if least == 0.5 else "quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
        judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
        assert sum(a == b for a, b in judged) / len(judged) > 0.85  # few rows are held out here; see test_classifiers


def test_scans_read_the_columns_they_need(spark, data):
    plan = Q.op7_quality_rules(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Python" not in plan and "Exchange" not in plan


def test_token_counts_equal_a_recount(spark, data):
    """op10 against a loop: the first document of each text counts, with its distinct lines."""
    import tiktoken
    import base64

    with open(rollups.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("x", pat_str=rollups.PATTERN, mergeable_ranks=ranks, special_tokens={})
    first, want = {}, {}
    for x in sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda x: x["doc_id"]):
        first.setdefault(x["text"], x)
    for text, x in first.items():
        text = "\n".join(dict.fromkeys(text.split("\n")))
        n = want.setdefault((x["source"], x["lang"]), [0, 0, 0])
        for k, more in enumerate((1, len(text), len(own.encode_ordinary(text)))):
            n[k] += more
    got = {(x["source"], x["lang"]): [x["n_docs"], x["n_chars"], x["n_tokens"]] for x in Q.op10_token_counts(spark, data).collect()}
    assert got == want


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.85), ("op3_quality_classifier", "quality", 0.95)])
def test_precision_and_recall_on_held_out_rows(spark, name, label, least):
    """Rows that no fit ever saw, of a table with some hundreds of them."""
    data = "/root/testdata/sf0.1"
    labels = {x["doc_id"]: x[label] for x in spark.read.parquet(f"{data}/labels.parquet").collect()}
    judged = [(x["predicted"], labels[x["doc_id"]]) for x in Q.QUERIES[name](spark, data).where("held_out").collect() if x["doc_id"] in labels]
    hits = sum(a == b == 1 for a, b in judged)
    recall, precision = hits / sum(b == 1 for _, b in judged), hits / sum(a == 1 for a, _ in judged)
    assert recall >= least and precision >= least, (recall, precision, len(judged))
