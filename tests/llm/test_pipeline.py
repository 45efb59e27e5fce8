import hashlib

import corpus_pipeline as C
from corvane.llm import decontaminate, pieces, pii, quality
from corvane.llm.common import table
from test_near_copies import plain_groups


def test_stages_equal_brute_force(spark, data):
    """Each stage against a plain loop over its own input, on the smallest tables."""
    docs = table(spark, data, "documents")
    columns, at, seen = docs.columns, docs, []
    for k, (name, stage) in enumerate(C.STAGES):
        before = {x["doc_id"]: x for x in at.collect()}
        out = stage(spark, at, data)
        if k < 4:
            assert out.columns == columns
        at = spark.createDataFrame(out.collect(), out.schema)
        seen.append((name, before, {x["doc_id"]: x for x in at.collect()}))
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    model = quality.train(docs, table(spark, data, "labels"))
    keep = {i for i, x in a.items() if model.scores(quality.term_matrix([x["text"]], quality._Memo()))[0] >= C.QUALITY_THRESHOLD}
    assert set(b) == keep and len(b) < len(a)
    assert set(c) == plain_groups([(i, x["text"]) for i, x in b.items()]) and len(c) < len(b)
    items = decontaminate.Index([(x["item_id"], x["text"]) for x in table(spark, data, "benchmark").collect()])
    assert set(d) == {i for i, x in c.items() if not items.search(x["text"])}
    assert set(e) == set(d) and not any(pii._emails(x["text"]) and list(pii._emails(x["text"])) for x in e.values())
    codec = pieces.Codec(pieces.read_model())
    assert set(f) == set(e)
    for i, x in f.items():
        assert codec.decode(x["ids"]) == e[i]["text"] and x["lossless"] and hashlib.sha256(b"".join(int(k).to_bytes(4, "little") for k in x["ids"])).hexdigest() == x["ids_sha256"]


def test_stages_take_empty_tables_and_nulls(spark, data):
    docs = table(spark, data, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    for frame in (docs.limit(0), odd):
        at = frame
        for _, stage in C.STAGES:
            at = stage(spark, at, data)
            at = spark.createDataFrame(at.collect(), at.schema)
