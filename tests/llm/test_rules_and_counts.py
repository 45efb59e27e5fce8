import re
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

from corvane.llm import rollups as R
from corvane.llm import rules as Q


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts_equal_brute_force(docs_frame, make_text):
    texts = [None, "", "\n \t\n", "one", "a b c d e a b c d e", "a b c d e f a b c d e g h a b c d e", "x x x x x x x x", "l1 w\nl1 w\n\nl1 w\r\n", "# $ % é😀 |<>&*", "a b c d e x a b c d e y a b c d e", "p q r s t u p q r s t u v w " * 3, make_text(1, 300), make_text(1, 30) + " " + make_text(1, 30), make_text(4, 20000), "\x1f a\x0bb\x0cc"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one")]
    docs = docs_frame(rows)
    out = Q.apply_rules(docs, column="judged")
    got = out.select("judged.*").collect()
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert [tuple(x[c] for c in cols) for x in got] == [plain_counts(t) for _, t in rows]
    assert out.columns == [*docs.columns, "judged"] and not any(x["kept"] for x in got if x["base_failed"])
    assert Q.apply_rules(docs.limit(0)).count() == 0
    odd = docs.limit(2).withColumns({"__words": F.lit(1), "__Hashes": F.lit(2), "___base": F.lit(3)})
    assert Q.apply_rules(odd).columns == odd.columns and Q.apply_rules(odd).select("__words", "__Hashes", "___base").first()[:] == (1, 2, 3)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text,rule", [
    ("The cat sat on the mat and it was happy to be there for a while.", None), ("$a $b $c the of and $d $e $f $g $h $i", "symbols_per_word"), ("WE ARE ALL SHOUTING HERE AND THE NOISE IS VERY LOUD", "upper_word_share"),
    ("zzz yyy xxx www vvv uuu ttt sss rrr qqq ppp", "stop_word_share"), ("a b c d e f g h i j k the", "mean_word_chars"), ("\n".join(f"- the item number {i} is good" for i in range(9)), "bullet_line_share"), ("\n".join(f"the item number {i} is good..." for i in range(9)), "ellipsis_line_share"),
])
def test_thresholds(docs_frame, text, rule):
    x = Q.apply_rules(docs_frame([(1, text)]), column="j").first()["j"]
    assert x["broken"] == ([rule] if rule else []) and x["kept"] == (rule is None)


def _changes(spark, rows):
    return spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, tokenizer string, n_chars long, n_tokens long")


def _state(store):
    return {(x["source"], x["lang"], x["tokenizer"]): (x["n_docs"], x["n_chars"], x["n_tokens"]) for x in store.totals().collect()}


def test_deltas_equal_a_recount(spark):
    store, truth = R.Store(spark), {}
    batches = {
        "a": [("upsert", i, f"s{i % 3}", "en" if i % 2 else None, "t1", i, i * 2) for i in range(30)] + [("upsert", 5, "s2", "en", "t2", 7, 7)],
        "b": [("delete", 3, None, None, "t1", 0, 0), ("delete", 999, None, None, "t1", 0, 0), ("upsert", 4, "s9", "de", "t1", 100, 50), ("upsert", 6, "s0", None, "t1", 1, 1), ("upsert", 6, "s0", None, "t1", 2, 2), ("delete", 6, None, None, "t1", 0, 0)],
        "c": [("upsert", 3, "s0", "en", "t1", 8, 8), ("upsert", 4, "s9", "de", "t1", 90, 45), ("noop", 8, "s", "l", "t1", 1, 1), ("upsert", None, "s0", "en", "t1", None, None)],
    }
    for name, rows in batches.items():
        assert store.apply(name, _changes(spark, rows))
        assert not store.apply(name, _changes(spark, rows))
        last = {}
        for op, d, s, l, t, c, k in rows:
            if op != "noop":
                last[d, t] = max(last.get((d, t), (False, 0, 0, "", "")), (op == "upsert", c or 0, k or 0, s or "", l or ""))
        for key, (enters, c, k, s, l) in last.items():
            truth.pop(key, None)
            if enters:
                truth[key] = (s or None, l or None, c, k)
        want = {}
        for (_, t), (s, l, c, k) in truth.items():
            old = want.get((s, l, t), (0, 0, 0))
            want[s, l, t] = (old[0] + 1, old[1] + c, old[2] + k)
        assert _state(store) == want
    assert store.committed() == ["a", "b", "c"]


def test_any_text_is_a_batch_id(spark):
    store = R.Store(spark)
    names = ["a/b", "..", " ", "", "a", ".hidden", "_x", "é%2F", "x.y"]
    for k, name in enumerate(names):
        assert store.apply(name, _changes(spark, [("upsert", k, "s", "en", "t", 1, 1)]))
        other = R.Store(spark, store.path)  # a second writer, later, sees what the first committed
        assert not other.apply(name, _changes(spark, [("upsert", 100 + k, "s", "en", "t", 1, 1)]))
    assert store.committed() == names and _state(store) == {("s", "en", "t"): (9, 9, 9)}
    with pytest.raises(ValueError):
        store.apply("x" * 300, _changes(spark, []))


def test_rows_without_an_id_are_documents_of_their_own(spark):
    store = R.Store(spark)
    rows = [("upsert", None, "s", "en", "t", 5, 2), ("upsert", None, "s", "en", "t", 5, 2), ("delete", None, "s", "en", "t", 0, 0)]
    store.apply("a", _changes(spark, rows))
    store.apply("b", _changes(spark, [("delete", None, None, None, "t", 0, 0), ("upsert", None, "s", "en", "t", 1, 1)]))
    assert _state(store) == {("s", "en", "t"): (3, 11, 5)}


def test_snapshots_do_not_change_totals(spark, monkeypatch):
    monkeypatch.setattr(R, "COMPACT_EVERY", 2)
    store, r = R.Store(spark), __import__("random").Random(2)
    truth = {}
    for k in range(7):
        rows = [("delete" if r.random() < 0.3 else "upsert", i, f"s{i % 2}", "en", "t", r.randrange(50), 1) for i in r.sample(range(40), 12)]
        store.apply(f"batch {k}", _changes(spark, rows))
        for op, i, s, _, _, c, _ in rows:
            truth.pop(i, None)
            if op == "upsert":
                truth[i] = (s, c)
        want = {}
        for s, c in truth.values():
            n = want.get((s, "en", "t"), (0, 0, 0))
            want[s, "en", "t"] = (n[0] + 1, n[1] + c, n[2] + 1)
        assert _state(store) == want
    assert store._names("snapshots") == ["00000002", "00000004", "00000006"] and len(store._read("rows", R._ROW)) == 2
    assert store.current().count() == len(truth)


def test_a_batch_that_broke_off_is_written_anew(spark):
    store = R.Store(spark)
    rows = _changes(spark, [("upsert", 1, "s", "en", "t", 5, 5)])
    rows.drop("op").withColumns({"n_docs": F.lit(1), "bucket": F.lit(0)}).limit(1).write.partitionBy("bucket").parquet(f"{store.path}/rows/b-a")  # left by the broken attempt
    assert _state(store) == {} and store.apply("a", rows) and _state(store) == {("s", "en", "t"): (1, 5, 5)}


def test_long_runs_of_blanks_are_counted(docs_frame):
    rows = [(1, " " * 2_000_000 + "a"), (2, "x" + "\n" * 250_000), (3, "a" * 300_000), (4, " " * R.RUN + "a")]
    got = {x["doc_id"]: x["n_tokens"] for x in R.counted(docs_frame(rows)).collect()}
    assert got[1] == 2_000_000 and got[2] > 100_000 and got[3] > 10_000 and got[4] == R.RUN
    assert R.stretches("a b" + " " * 10) == ["a b" + " " * 10] and "".join(R.stretches(rows[0][1])) == rows[0][1]


def test_token_counts(docs_frame, make_text):
    import base64

    with open(R.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("x", pat_str=R.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, make_text(1, 50)), (2, None), (3, ""), (4, "<|endoftext|> it's\n\n  x"), (5, "é😀" * 2000)]
    got = {x["doc_id"]: x for x in R.counted(docs_frame(rows)).collect()}
    assert {i: x["n_tokens"] for i, x in got.items()} == {i: len(own.encode_ordinary(t or "")) for i, t in rows}
    assert got[5]["n_chars"] == 4000 and R.counted(docs_frame([])).count() == 0
