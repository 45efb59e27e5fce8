import os

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import pieces as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no model file")


@pytest.fixture(scope="module")
def model():
    return P.read_model()


@pytest.fixture(scope="module")
def codecs(model):
    return P.Codec(model, 0.0), P.Codec(model, 0.3, 5), P.Codec(model, 0.3, 6)


ODD = ["", " ", "  a  b ", "▁x ▁▁ y", "\n\n a\tb\r\n", "日本語 😀 é́", "a" * 500, "\x00\x01", "Hello world. " * 50, "x" * 40000]


def test_without_dropout_equals_the_library(model, codecs, make_text):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in [make_text(1, 500), *ODD]:
        if "▁" not in t:
            assert codecs[0].encode(t).tolist() == sp.encode(t), t[:20]


@pytest.mark.parametrize("text", ODD)
def test_lossless(codecs, text):
    for c in codecs:
        for key in (0, 1, 7):
            assert c.decode(c.encode(text, key)) == text


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_lossless_for_any_text(text):
    c = P.codec(P.read_model(), 0.3, 5)
    assert c.decode(c.encode(text, 3)) == text


def test_seeds_and_documents_vary(codecs, make_text):
    text = make_text(2, 200)
    a, b, c = (x.encode(text).tolist() for x in codecs)
    assert b != c and a != b and len(b) > len(a) and b == P.Codec(P.read_model(), 0.3, 5).encode(text).tolist()
    assert codecs[1].encode(text, 0).tolist() != codecs[1].encode(text, 1).tolist()


def plain_encode(codec, text, doc):
    """The definition, word by word: the best pair left, the leftmost of equals, is asked about and joined or dropped."""
    out = []
    units = codec.units.findall(" " + text) if text else []
    for unit, key in zip(units, codec.keys(doc, len(units))):
        parts = [P.MARK if c == " " else c for c in unit]
        alive, asked = [True] * (len(parts) - 1), 0
        block = None
        while True:
            best = min(((codec.scores[codec.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if alive[i] and a + b in codec.ids), default=None)
            if best is None:
                break
            if asked % 32 == 0:
                block = int(codec._skips(np.array([key], dtype=np.uint64), asked // 32)[0])
            skip = block >> asked % 32 & 1
            asked += 1
            i = best[1]
            if skip:
                alive[i] = False
                continue
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            alive[i : i + 1] = []
            for j in (i - 1, i):  # its neighbours make new candidates
                if 0 <= j < len(alive):
                    alive[j] = True
        for p in parts:
            out += [codec.ids[p]] if p in codec.ids else [int(np.frombuffer(codec.bytes[b], np.int32)[0]) for b in p.encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_equals_the_definition(model, make_text, rate):
    c = P.Codec(model, rate, 9)
    texts = [make_text(1, 120), make_text(1, 120), "naïve  façade 😀 日本 extraordinarily-uncharacteristically-long-hyphenated-compound-words here", "b" * 300, "https://a.example.org/internationalization?q=1 " * 3]
    for docs in ([1, 2, 3, 4, 5], [9, 1, 1, -4, 0]):
        assert [x.tolist() for x in c.encode_batch(texts, docs)] == [plain_encode(c, t, d) for t, d in zip(texts, docs)]


def test_every_place_of_a_word_is_drawn_anew(model):
    """Of a word with several merges all segmentations come up, and the plain one at least as often as no skip."""
    c = P.Codec(model, 0.1, 9)
    ids = c.encode("mountain " * 4000, 3).tolist()
    plain = P.Codec(model, 0.0).encode("mountain").tolist()
    text = " ".join(map(str, ids))
    asked = c.merged(" mountain")[0]
    share = text.count(" ".join(map(str, plain))) / 4000
    assert 0.9**asked - 0.03 < share < 0.9 and len({bytes(x) for x in c.found}) > 4


def test_forgetting_changes_nothing(model, make_text, monkeypatch):
    texts = [make_text(k, 100) for k in range(6)]
    want = [x.tolist() for x in P.Codec(model, 0.2, 9).encode_batch(texts, range(6))]
    monkeypatch.setattr(P, "_MEMO", 50)
    c = P.Codec(model, 0.2, 9)
    assert [c.encode(t, k).tolist() for k, t in enumerate(texts)] == want


def test_full_dropout_leaves_characters(model):
    c = P.Codec(model, 1.0)
    assert len(c.encode("stone walks")) == len("stone walks") + 1


def test_rows(docs_frame, make_text):
    rows = [(1, make_text(1, 50)), (1, make_text(1, 50)), (2, None), (3, ""), (None, "a b")]
    docs = docs_frame(rows)
    out = P.encode_documents(docs).select("doc_id", "text", "encoded.*").collect()
    assert all(x["lossless"] for x in out) and out[0]["ids_sha256"] == out[1]["ids_sha256"] and [x["n_pieces"] for x in out[2:4]] == [0, 0]
    back = P.decode_documents(P.encode_documents(docs).select("doc_id", "encoded.ids")).collect()
    assert [x["text"] for x in back] == [t or "" for _, t in rows]
    assert P.encode_documents(docs.limit(0)).count() == 0
