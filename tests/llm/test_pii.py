import hashlib
import re

import numpy as np
import pytest

from corvane.llm import pii as P

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


TEXTS = [
    "", "a@b", "a@b.c", "x.y+z@sub.example-1.com. and @b.c a@@b.c a@b..c", "a@b.c@d.e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.004 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111",
    "+1 (499) 555-6503 +12 +123456789012345678 ++1 222 333 44", "é😀 a@b.co 😀 10.0.0.1", "1" * 300, "9.9.9.9" * 50, "%" * 200 + "@x.y", "+1-4111111111111111", "0000000000000000",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_equal_the_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_random_texts_equal_the_patterns():
    r = np.random.default_rng(0)
    for _ in range(3000):
        text = "".join(r.choice(list("a1290.@+-() 4%\n5"), r.integers(0, 60)))
        assert P.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000):
        P.base_spans(text)


@pytest.fixture(scope="module")
def tagger(make_text):
    plain = {ord(c): None for c in "0123456789"}
    return P.Tagger().fit(*P.training_windows([make_text(i, 100) if i % 2 else make_text(i, 100).translate(plain) for i in range(160)]))


def test_gradients():
    ids, tags = P.training_windows(["plain words of a text that goes on"], 12)
    t = P.Tagger()
    _, grads = t.loss(ids, tags)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, ends = t.p[k], []
        for h in (0.01, -0.01):
            t.p[k] = keep.copy()
            t.p[k][at] += h
            ends.append(t.loss(ids, tags)[0])
        t.p[k] = keep
        assert (ends[0] - ends[1]) / 0.02 == pytest.approx(g[at], rel=0.02, abs=1e-3), k


def test_network_on_held_out_windows(tagger, make_text):
    ids, tags = P.training_windows([make_text(i, 100) for i in range(500, 540)], 600, seed=77)
    got = tagger.decode(ids)
    assert (got == tags).mean() > 0.97 and (got == tags)[tags > 0].mean() > 0.9


def _planted(make_text, made):
    """Each identifier (or None and a look-alike) in a text of its own: texts, true spans."""
    texts, gold = [], []
    for k, (kind, found) in enumerate(made):
        before = make_text(2000 + k, 30).translate({ord(c): None for c in "0123456789"}) + " "
        texts.append(before + found + " " + make_text(5000 + k, 20).translate({ord(c): None for c in "0123456789"}))
        gold.append((kind, len(before), len(before) + len(found)))
    return texts, gold


def test_spellings_that_the_patterns_miss(tagger, make_text):
    """Made-up identifiers of another seed in other texts: what no pattern finds is added, look-alikes are left alone."""
    r = np.random.default_rng(4711)
    texts, gold = _planted(make_text, [P._made_up(r) for _ in range(900)])
    base = [P.base_spans(t) for t in texts]
    missed = hit = false = 0
    for (kind, a, b), fixed, more in zip(gold, base, P.added_spans(texts, base, tagger)):
        if kind is None:
            false += len(more)
        elif not any(k == kind for k, *_ in fixed):
            missed += 1
            hit += any(k == kind and x < b and y > a for k, x, y in more)
    assert missed > 300 and hit >= 0.9 * missed and false <= 5, (hit, missed, false)


def test_spellings_that_were_never_trained(tagger, make_text):
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    made = [("email", f"{word()} at {word()} dot museum") for _ in range(60)] + [("email", f"{word()}.{word()} [at] {word()} dot co dot uk") for _ in range(60)]
    texts, gold = _planted(make_text, made)
    found = P.added_spans(texts, [[] for _ in texts], tagger)
    near = [any(k == kind and x < b and y > a for k, x, y in more) for (kind, a, b), more in zip(gold, found)]
    assert sum(near) >= 0.8 * 120, (sum(near[:60]), sum(near[60:]))


def test_windows_that_are_not_decoded_hold_nothing(make_text):
    r = np.random.default_rng(12)
    for k in range(2000):
        kind, made = P._made_up(r)
        if kind:
            assert P.anchors(f"some words {made} and more"), made
    assert not P.anchors("He sat at the table. Then at noon he left; antidote, dots and data.")


def test_clean_texts_have_no_added_spans(tagger, make_text):
    texts = [make_text(k, 150) for k in range(60)] + ["On 12.03.2024 at 10:45 version 2.11.0 sold 12,400 units for $35.20 (p. 112-118).", "a" * 20000 + "1" * 20000]
    assert sum(map(len, P.added_spans(texts, [P.base_spans(t) for t in texts], tagger))) == 0


def test_added_spans_and_windows(tagger, make_text):
    texts = [make_text(1, 40).replace("1", "") + " call (499) 555-6503 now " + make_text(2, 40), "", "no such thing here"]
    base = [P.base_spans(t) for t in texts]
    added = P.added_spans(texts, base, tagger)
    assert added[1:] == [[], []]
    # blocks of windows of any size give the same spans
    assert P.added_spans(texts, base, tagger, block=1) == added


def test_rows_and_redaction(docs_frame, tagger, make_text):
    rows = [(1, "mail bob@example.com or +1 (499) 555-6503 now"), (2, None), (3, ""), (3, ""), (None, make_text(3, 20000))]
    out = {x["doc_id"]: x["f"] for x in P.find_personal_data(docs_frame(rows), tagger, "f").collect()}
    assert out[1]["n_email"] == 1 and out[1]["n_phone"] == 1 and out[1]["base_sha256"] == hashlib.sha256(b"email:5:20,phone:24:41").hexdigest()
    assert out[2]["base_sha256"] == out[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[2]["spans"] == ""
    docs = docs_frame(rows)
    red = {x["doc_id"]: x for x in P.redact_documents(docs, tagger).collect()}
    assert red[1]["text"] == "mail [EMAIL] or [PHONE] now" and red[1]["n_chars"] == len(red[1]["text"]) and red[2]["text"] is None and red[3]["text"] == ""
    assert P.redact_documents(docs, tagger).columns == docs.columns and P.redact_documents(docs.limit(0), tagger).count() == 0
    assert P.redact("ab cd", [("ip", 0, 2), ("card", 1, 4)]) == "[IP]d"


def test_training_from_a_table(docs_frame, make_text):
    assert P.train(docs_frame([(i, make_text(i, 30)) for i in range(5)]), 4, 60).p["E"].shape[1] == P.EMBED
    assert P.train(docs_frame([]), 4, 60)


def test_anchors_do_not_depend_on_lower_case():
    text = "write to anna at firm dot org today"
    for before in ("", "\u0130 ", "\u0130" * 5 + " DOT. ", "dotted antidote _dot_ "):
        at = len(before)
        assert [a - at for a in P.anchors(before + text) if a >= at] == P.anchors(text) and P.anchors(text) == [text.index("dot")]


def test_columns_of_our_names_stay(docs_frame, tagger):
    from pyspark.sql import functions as F

    df = docs_frame([(1, "mail bob@example.com"), (2, None)]).withColumn("__found", F.lit(5)).withColumn("__found_", F.lit("x"))
    got = P.redact_documents(df, tagger).orderBy("doc_id").collect()
    assert [(x["__found"], x["__found_"]) for x in got] == [(5, "x")] * 2 and "bob" not in got[0]["text"] and got[1]["text"] is None
