import random
import zlib

import numpy as np
import pytest

from corvane.llm import quality as Q
from corvane.llm import toxicity as X
from corvane.llm.common import held_out, labelled_sample


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["stupid", "moron", "scum", "disgusting", "worthless"]
    auto, r = X.Automaton(terms), random.Random(2)
    words = set(terms)
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(r.randrange(4)):
                k = r.randrange(3)
                at = r.randrange(len(w) or 1)
                if k == 0 and w:
                    w.pop(at)
                elif k == 1:
                    w.insert(at, r.choice("abcstudmorn1é"))
                elif w:
                    w[at] = r.choice("abcstudmorn1é")
            words.add("".join(w))
    for w in words - {""}:
        found = auto.match(w)
        starts = [t for t in terms if w.startswith(t)]
        near = [(edit_distance(w, t), t) for t in terms if edit_distance(w, t) <= X.edits_allowed(t)]
        if starts:
            assert found == (terms.index(max(starts, key=len)), 0), w
        elif near:
            assert found and found[1] == min(near)[0], w
        else:
            assert found is None, w


def test_quotation_weighs_less_than_abuse():
    scanner = X.Scanner(["idiot"])
    (abuse,) = scanner.hits("you are an idiot and a bore")
    (quoted,) = scanner.hits('she wrote "he is an idiot" in her note')
    (reported,) = scanner.hits("they used the word idiot twice")
    assert abuse[2] > 1 > 0.5 > quoted[2] and quoted[3] and reported[3] and not abuse[3]


def _sample(make_text, bad, n=120):
    out = []
    for i in range(n):
        words = make_text(i, 80).split()
        if i % 2:
            for k in range(3):
                words.insert((i * 7 + k * 13) % len(words), bad[(i + k) % len(bad)])
        out.append((" ".join(words), i % 2))
    return out


def test_toxicity_learns_terms_and_finds_misspellings(make_text):
    bad = ["blithering", "numbskull", "wretched"]
    model = X.fit(_sample(make_text, bad))
    assert {t[:5] for t in model.terms} >= {b[:5] for b in bad}
    score = lambda t: float(model.scores(np.array([model.features(t)]))[0])
    assert score("you numbskull and you wretched thing") > 0.5
    assert score("you numbskul and you wretchd blitherng thing") > 0.5
    assert score(make_text(999, 200)) < 0.5 and score("") < 0.5 and score(None) < 0.5


def test_toxicity_without_labels_is_low():
    model = X.fit([])
    assert model.scores(np.array([model.features("any text")]))[0] < 0.5


def test_copies_speak_once(make_text):
    odd = "zyxwvut " + make_text(1, 60)
    sample = [(odd, 1)] * 30 + [(make_text(i + 50, 60), 0) for i in range(60)]
    assert X.mine_lexicon(sample) == []


def test_quality_separates_junk(make_text):
    junk = lambda i: " ".join(w + "$$$" for w in make_text(i, 60).split())
    sample = [(make_text(i, 60), 1) for i in range(100)] + [(junk(i), 0) for i in range(100)]
    model = Q.fit(sample, (100, 100))
    memo = Q._Memo()
    scores = model.scores(Q.term_matrix([make_text(900, 70), junk(901), "", None], memo))
    assert scores[0] > 0.7 > 0.3 > scores[1] and scores[2] == scores[3] == model.prior


def test_quality_votes_equal_brute_force(make_text):
    model = Q.fit([(make_text(i, 30), i % 2) for i in range(60)], (300, 30))
    x = Q.term_matrix([make_text(i + 500, 30) for i in range(5)], Q._Memo())
    latent = model.project(x)
    for row, got in zip(latent, model.scores(x)):
        cos = np.array([float(row @ v) for v in model.vectors])
        near = sorted(range(60), key=lambda i: -cos[i])[: model.neighbours]
        w = [max(cos[i], 0) ** 8 * model.votes[i] for i in near]
        assert got == pytest.approx(sum(a * model.labels[i] for a, i in zip(w, near)) / sum(w), abs=1e-4)


def test_held_out_rows_never_train(spark, make_text):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None), (None, 1)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 30)
    ids = [int(t.split()[1]) for t, _ in rows]
    assert sum(y for _, y in rows) == 30 and len(rows) == 60
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    flags = docs.select("doc_id", held_out(docs["doc_id"]).alias("h")).collect()
    assert all(x["h"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in flags)


@pytest.mark.parametrize("module,label", [(Q, "quality"), (X, "toxic")])
def test_scores_keep_rows_and_columns(docs_frame, spark, make_text, module, label):
    rows = [(1, "fine words here"), (1, "fine words here"), (2, None), (3, ""), (None, make_text(1, 20000))]
    docs = docs_frame(rows)
    labels = spark.createDataFrame([(1, 1)], f"doc_id long, {label} int")
    out = module.score_documents(docs, module.train(docs, labels), "s")
    assert out.columns == [*docs.columns, "s"] and all(0 <= x["s"] <= 1 for x in out.collect()) and out.count() == 5
    none = module.train(docs, labels.limit(0))
    assert module.score_documents(docs.limit(0), none, "s").count() == 0
