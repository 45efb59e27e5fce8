import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import urls as U
from corvane.llm import warc as W

SCHEMA = "page_id long, url string, html string, verdict string"


def plain_warc(rows):
    out, groups = [], {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000:
            groups.setdefault(p, []).append(i)
    for i, _, html in rows:
        p = (html or "").encode()
        ids = [x for x in groups.get(p, []) if x is not None]
        revisit = len(groups.get(p, [])) > 1 and ids and i != max(ids)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    big = "<p>WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n é</p>" * 60
    rows = [(i, f"http://a.org/{i}", big if i % 3 == 0 else f"{big}{i % 5}") for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x\r\ny", "small"), (103, "u", "small"), (5, "http://a.org/5", big + "0"), (None, "n", big), (104, "u", "\r\n\r\n" * 400)]
    pages = spark.createDataFrame([(*r, "v") for r in rows], SCHEMA)
    got = W.deduplicated(spark, pages).collect()
    assert all(x["intact"] for x in got)
    assert sorted(((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got), key=str) == plain_warc(rows)


def test_payloads_are_stored_once(spark, tmp_path):
    html = "<html>" + "x" * 2000
    pages = spark.createDataFrame([(i, "u", html, "") for i in range(50)], SCHEMA)
    path = f"file://{tmp_path}/w"
    W.write_archives(W.resolved(W.headers_of(pages)), path, records_per_file=10)
    records = W.read_archives(spark, path).collect()
    full = [x for x in records if x["payload"] is not None]
    assert len(records) == 50 and len(full) == 1 and bytes(full[0]["payload"]).decode() == html and full[0]["page_id"] == 49
    assert {x["refers_to"] for x in records if x["payload"] is None} == {49}


def test_ids_at_both_ends_of_their_range(spark, tmp_path):
    big = "x" * 1500
    ids = [(1 << 63) - 1, -(1 << 63), 10**18, -(10**18), 1234567890123456789, 2**53 + 1, 0, 5, None]
    pages = spark.createDataFrame([(i, "u", big, "") for i in ids] + [(7, "u", "other", "")], SCHEMA)
    got = {x["page_id"]: x["refers_to"] for x in W.deduplicated(spark, pages).collect()}
    assert got == {i: None if i == (1 << 63) - 1 else (1 << 63) - 1 for i in ids} | {7: None}
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    W.write_archives(W.resolved(W.headers_of(pages)), a)
    assert W.deduplicate_archives(spark, a, b).count() == 0
    assert {x["page_id"]: x["refers_to"] for x in W.read_archives(spark, b).collect()} == got


@pytest.mark.parametrize("size", ["²", "--5", "-", "-1", "9" * 19, "9" * 30, "1e3", "٣", " ", "+4", "0x10", ""])
def test_damaged_numbers_are_damaged_records(size):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n\r\n\r\na\r\n\r\n"
    bad = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {size}\r\n\r\nabc\r\n\r\n".encode()
    assert [r[2] for r in W.parse(good + bad + good)] == ["response", "damaged", "response"]


@given(st.lists(st.one_of(st.binary(max_size=40), st.sampled_from([b"WARC/1.1\r\n", b"\r\n\r\n", b"Content-Length: ", b"Page-ID: ", b"WARC-Type: revisit\r\n", b"3", b"-", "²".encode(), b"\r\n"])), max_size=20))
@settings(max_examples=400, deadline=None)
def test_no_bytes_make_the_parser_fail(parts):
    data = b"".join(parts)
    found = list(W.parse(data))
    assert all(len(r) == len(W.RECORD.names) for r in found) and sum(len(r[7] or b"") for r in found) <= len(data)


def test_empty_pages(spark):
    assert W.deduplicated(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def plain_judge(url, rules, blocked, words):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    bad = any(host == b or host.endswith("." + b) for b in blocked) or set(re.split("[.-]", host)) & set(words)
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x", "https://example.org/en/12?q#f", "http://example.org", "http://x.com/fr/a://b/de/", "http://x.com/de/", "http://com/de/1", "http://notexample.net/", "HTTP://Cheap-Pills.example.com/fr/",
    "http://www.cheap-pills.example.com/en", "http://a.localhost?x", "http://notlocalhost/", "http://casino.example.net", "http://casinos.example.net", "http://x.net/casino", "http://local", "http://home.arpa/x", "http://arpa/", "http://-.--..net/",  "http://user@host:80/p", "http://a..org/z", "http://é.org/é", "x://y#/z", "http://org/" + "a" * 50000, "a\n://b.org/\nc",
]


def test_urls_equal_brute_force(spark):
    rows = [(i, u, None, "v") for i, u in enumerate(URLS)] + [(1, URLS[4], None, "v")]
    pages = spark.createDataFrame(rows, SCHEMA)
    want = [(i, *plain_judge(u, U.RULES, U.BLOCKED_HOSTS, U.BLOCKED_WORDS)) for i, u, *_ in rows]
    rules, blocked, words = spark.createDataFrame(U.RULES, "host string, path string, action string"), spark.createDataFrame([(h,) for h in U.BLOCKED_HOSTS], "host string"), spark.createDataFrame([(w,) for w in U.BLOCKED_WORDS] + [(None,)], "word string")
    for how in ({}, {"rules": rules, "blocked": blocked, "words": words}, {"most": 3}, {"words": words, "most": 3}):
        out = U.judge_urls(pages, **how, column="verdict")
        assert out.columns == pages.columns
        got = out.select("page_id", "verdict.*").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str), how
    assert U.judge_urls(pages.limit(0)).count() == 0 and U.judge_urls(pages, [], [], []).where("judged.verdict = 'block'").count() == 0


def test_collisions_are_confirmed_by_the_string(tmp_path, monkeypatch):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda b, seed=0: len(b) % 2)
    path = str(tmp_path / "index")
    U.write_index(path, [("a.org", "/x", "block"), ("b.org", "/x", "allow")], ["c.org", "dd.org"])
    index = U.Index(path)
    assert index.judge(["a.org", "b.org", "z.org", "c.org", "x.dd.org", ""], ["/xy", "/x", "/x", "", "/", "/"]) == [("a.org/x", "block"), ("b.org/x", "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow")]


def test_empty_index(tmp_path):
    path = str(tmp_path / "index")
    U.write_index(path)
    assert U.Index(path).judge(["a.org"], ["/"]) == [(None, "allow")]


def test_hosts_of_very_many_labels(tmp_path):
    path = str(tmp_path / "index")
    U.write_index(path, U.RULES, ["a.b.c.test"], ["spam"])
    many = "x." * 1_000_000
    assert U.Index(path).judge([many + "a.b.c.test", many + "org", many + "spam.net", many], ["/"] * 4) == [(None, "block"), ("org/", "allow"), (None, "block"), (None, "allow")]


def test_a_large_index_from_a_table(spark, tmp_path):
    """The file of a table equals that of a list, and a worker finds what is in it only."""
    n = 50_000
    rows = spark.range(n, numPartitions=7).select(F.concat(F.lit("host"), "id", F.lit(".net")).alias("host"))
    rules = spark.createDataFrame([("host7.net", "/a", "allow")], "host string, path string, action string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    U.write_index_table(a, U.entry_table(spark, rules, rows, []))
    U.write_index(b, [("host7.net", "/a", "allow")], [f"host{i}.net" for i in range(n)])
    with open(a, "rb") as x, open(b, "rb") as y:
        assert x.read() == y.read()
    assert U.Index(a).judge(["host7.net", "www.host49999.net", f"host{n}.net", "host7.net"], ["/ab", "/", "/", "/b"]) == [("host7.net/a", "allow"), (None, "block"), (None, "allow"), (None, "block")]


def test_the_longest_string_wins_then_the_longer_host(tmp_path):
    path = str(tmp_path / "index")
    U.write_index(path, [("org", "/abc", "allow"), ("x.org", "/", "block"), ("x.org", "/a", "block")], [])
    assert U.Index(path).judge(["x.org", "x.org"], ["/abc", "/"]) == [("x.org/a", "block"), ("x.org/", "block")]


def test_archives_with_copies_and_revisits_are_deduplicated(spark, tmp_path):
    """Responses, copies of them, and revisits by id and by digest, over several files; then a second round changes nothing."""
    big = [f"<html>{k}" + "x" * (1500 + k) for k in range(6)]
    pages = spark.createDataFrame([(k, f"http://a.org/{k}", big[k % 6], "") for k in range(30)] + [(90, "u", "small", ""), (91, "u", "small", ""), (92, "u", None, "")], SCHEMA)
    a, b, c = (f"file://{tmp_path}/{x}" for x in "abc")
    W.write_archives(W.resolved(W.headers_of(pages)), a, records_per_file=4)
    copies = spark.createDataFrame([(200 + k, "http://copy.org", big[k], "") for k in range(3)], SCHEMA)
    W.write_archives(W.resolved(W.headers_of(copies)), a, records_per_file=4)
    record = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(big[5].encode()).hexdigest().encode() + b"\r\nPage-ID: 300\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    gone = record.replace(b"sha1:", b"sha1:00").replace(b"300", b"301")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    (tmp_path / "a" / "foreign.warc").write_bytes(info + record + b"no record at all\r\n\r\n" + gone + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut")
    (tmp_path / "a" / "image.png").write_bytes(b"\x89PNG\xff\xfe" * 50)
    lost = W.deduplicate_archives(spark, a, b).collect()
    assert sorted((x["record_type"], x["page_id"]) for x in lost if x["record_type"] == "revisit") == [("revisit", 301)]
    assert sorted(bytes(x["payload"])[:9] for x in lost if x["record_type"] == "damaged") == [b"WARC/1.0\r", b"no record", b"\x89PNG\xff\xfe\x89PN"]
    want = {**{k: big[k % 6] for k in range(30)}, 90: "small", 91: "small", 92: "", **{200 + k: big[k] for k in range(3)}, 300: big[5]}
    for at in (b, c):
        records = W.with_payloads(W.read_archives(spark, at)).collect()
        assert {x["page_id"]: bytes(x["payload"]).decode() for x in records} == want and len(records) == len(want)
        uris = [x["record_uri"] for x in records]
        assert len(set(uris)) == len(uris)
        stored = [x for x in records if x["record_type"] == "response"]
        assert len(stored) == 6 + 3 and all(x["resolved_uri"] in uris for x in records if x["record_type"] == "revisit")
        assert sorted(x["page_id"] for x in stored) == [27, 28, 90, 91, 92, 200, 201, 202, 300]
        if at == b:
            assert W.deduplicate_archives(spark, b, c).count() == 0


def test_files_keep_within_their_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", str(k) + "y" * (100 if k % 3 else 9000 * (1 + k)), "") for k in range(60)], SCHEMA).coalesce(1)
    path = tmp_path / "w"
    W.write_archives(W.resolved(W.headers_of(pages)), f"file://{path}", records_per_file=50, file_bytes=600_000)
    sizes = [p.stat().st_size for p in path.glob("part-*")]
    assert max(sizes) < 600_000 + 50 * 700 and len(sizes) < 40 and W.read_archives(spark, f"file://{path}").where("intact").count() == 60


def test_record_ids_and_dates(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "z" * 2000, ""), (1, "u", "z" * 2000, ""), (0, "u", "z" * 2000, ""), (7, "u", "w" * 2000, ""), (8, "u", "w" * 2000, "")], SCHEMA)
    path = tmp_path / "w"
    W.write_archives(W.resolved(W.headers_of(pages)), f"file://{path}", date="2026-01-02T03:04:05Z")
    records = W.read_archives(spark, f"file://{path}").collect()
    by = {x["page_id"]: x for x in records}
    assert len({x["record_uri"] for x in records}) == 5 and by[0]["refers_to_uri"] is None and by[0]["refers_to"] == 1 and by[7]["refers_to_uri"] == by[8]["record_uri"]
    assert all(b"WARC-Date: 2026-01-02T03:04:05Z\r\n" in p.read_bytes() for p in path.glob("part-*") if p.stat().st_size)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    W.read_archives(spark, f"file://{path}")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
