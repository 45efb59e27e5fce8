"""CSV records over many splits against a parser of the whole file, character by character."""

import random

import pytest

from corvane.sources import delimited as D
from corvane.sources import readers as R


def whole(text, sep=","):
    """All records of a text, each its fields: what a field holds is decided one character at a time."""
    records, record, field, i, quoted, begun = [], [], "", 0, False, False
    text = text.replace("\r\n", "\n")
    blank = lambda c: c.isspace() and c not in (sep, "\n")

    def end_field():
        nonlocal field, begun
        record.append(field.strip())
        field, begun = "", False

    while i <= len(text):
        c = text[i] if i < len(text) else ""
        if quoted:
            after = text[i + 1 : i + 2]
            if c == "":
                quoted = False
                continue
            if c != '"':
                field += c
            elif after == '"':
                field += c
                i += 1
            elif after in ("", "\n", sep):
                quoted = False
            else:
                field += c
        elif c == '"' and not begun and not field.strip():
            quoted, begun, field = True, True, ""
        elif c == sep:
            end_field()
        elif c in ("\n", ""):
            if record or field.strip() or begun:
                end_field()
                records.append(record)
            record, field, begun = [], "", False
        else:
            field += c
            begun = begun or not blank(c)
        i += 1
    return records


def random_file(r, n):
    piece = lambda: r.choice(["a", "b", " ", "x1", ",", '"', '""', "\n", "\r\n", "é", '","', '\n"', "long words here"])
    return "h1,h2\n" + "".join(piece() if r.random() < 0.5 else f'"{r.randrange(99)}\n{r.randrange(9)}",{r.randrange(99)}\n' for _ in range(n))


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def records(spark, path, sep=","):
    found, first, files = D.read_records(spark, path, sep)
    rows = sorted(found.select("file", "number", D.cells(found["record"], sep)).collect())
    assert sorted(first.select("file", "number").collect()) == [(f, 1) for f in sorted({x[0] for x in rows})]
    assert files >= len({x[0] for x in rows})
    out = {}
    for file, number, fields in rows:
        out.setdefault(file.rsplit("/", 1)[1], []).append((number, fields))
    return out


def test_records_over_many_splits(spark, tmp_path, small_splits):
    texts = {f"f{k}.csv": random_file(random.Random(k), 40 + 20 * k) for k in range(6)}
    texts["open.csv"] = 'h\n"begun\n' + "and never closed, x\n" * 60
    texts["long.csv"] = 'h,i\n1,"' + "line\n" * 200 + '",2\n3,4\n\n  \n"5",6'
    texts["empty.csv"] = ""
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = records(spark, f"file://{tmp_path}/*.csv")
    for name, text in texts.items():
        want = whole(text)
        assert got.get(name, []) == list(enumerate(want, 1)), name


def test_states_of_lines_compose():
    r, opening = random.Random(4), D._opening(",")
    for _ in range(3000):
        lines = ["".join(r.choice('a", ') for _ in range(r.randrange(8))) for _ in range(3)]
        for inside in (False, True):
            state = inside
            for line in lines:
                state = D.ends_open(line, ",", state, opening)
            text = ("\"" if inside else "") + "\n".join(lines) + "\nz\nlast"  # the field is stripped
            assert (whole(text)[-1][-1].endswith("last") and "\n" in whole(text)[-1][-1]) == state, (lines, inside)


def test_rows_and_headers(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes(b'"id\nno",Name\r\n1,"two\r\nlines, and ""more"""\r\n2,5" pipe,6" pipe\r\n\r\n3\r\n')
    got = [(x["row_number"], dict(x["fields"]), x["_error"]) for x in R.read_delimited(spark, f"file://{tmp_path}/a.csv").orderBy("row_number").collect()]
    assert got == [(2, {"id_no": "1", "name": 'two\nlines, and "more"'}, None), (3, {"id_no": "2", "name": '5" pipe', "extra_1": '6" pipe'}, None), (4, {"id_no": "3", "name": ""}, None)]
    (tmp_path / "b.tsv").write_text('a\tb\tc\n1\t\t"x\n\ty"\n')
    assert [dict(x["fields"]) for x in R.read_any(spark, f"file://{tmp_path}/b.tsv").collect()] == [{"a": "1", "b": "", "c": "x\n\ty"}]


def test_a_record_too_long(spark, tmp_path, monkeypatch, small_splits):
    monkeypatch.setattr(D, "MOST", 400)
    (tmp_path / "a.csv").write_text("h,i\n1,2\n3,\"" + "never closed\n" * 300)
    got = {x["row_number"]: (x["_error"], x["fields"]) for x in R.read_delimited(spark, f"file://{tmp_path}/a.csv").collect()}
    assert got[2] == (None, {"h": "1", "i": "2"}) and got[3][0] == "long_record" and got[3][1]["line"].startswith('3,"never closed\nnever') and len(got[3][1]["line"]) == 400 and len(got) == 2


def test_a_wide_record(spark, tmp_path):
    wide = ",".join(f'"c{i}, ""x"""' for i in range(20000))
    (tmp_path / "a.csv").write_text(f"a\n{wide}\n")
    row = R.read_delimited(spark, f"file://{tmp_path}/a.csv").first()["fields"]
    assert len(row) == 20000 and row["extra_19999"] == 'c19999, "x"'
