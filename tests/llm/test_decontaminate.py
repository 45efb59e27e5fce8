import re

import pytest

from corvane.llm import decontaminate as D


def plain(docs, items, t=0.8):
    def cut(words, width):
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}

    best = {}
    for d, text in docs:
        own = re.findall(r"\w+", (text or "").lower())
        for i, item in items:
            words = re.findall(r"\w+", (item or "").lower())
            width = min(5, len(words))
            s = cut(words, width) if words else set()
            n = len(s & cut(own, width)) if words else 0
            if s and n >= t * len(s) - 1e-9:
                best[d, i] = max(best.get((d, i), (0, 0)), (n, len(s)))
    return sorted(((d, i, n, k) for (d, i), (k, n) in best.items()), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_pairs_equal_brute_force(spark, docs_frame, make_text, broadcast):
    items = [(i, make_text(1000 + i, 6 + i * 9)) for i in range(12)] + [(50, "short one"), (51, ""), (52, None), (53, "lone"), (3, make_text(2003, 40)), (None, make_text(2004, 40))]
    docs = [(i, make_text(i, 300)) for i in range(20)]
    for k, (i, text) in enumerate(items[:12]):
        words = text.split()
        whole = make_text(300 + k, 4000).split()
        docs.append((100 + k, " ".join(whole[:2000] + words + whole[2000:])))
        docs.append((200 + k, " ".join(whole[:50]) + " " + text.upper().replace(" ", ", ") + "."))
        cut = words[: int(len(words) * 0.7)]
        docs.append((300 + k, " ".join(whole[:50] + cut)))  # too little of it
        half = len(words) // 2
        docs.append((400 + k, " ".join(words[:half] + whole[:30] + words[half:])))  # in two places
    docs += [(500, "Short  ONE"), (501, None), (502, ""), (100, docs[20][1]), (None, items[3][1]), (503, "a lone word, a short one"), (504, items[-2][1]), (505, items[-1][1] + " " + items[-2][1])]
    long, half = items[8][1].split(), len(items[8][1].split()) // 2
    docs += [(7, " ".join(long[:half])), (7, " ".join(long[half - 4 :]))]  # two rows of one id that only together hold the item
    df = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated_pairs(docs_frame(docs), df, broadcast=broadcast).select("doc_id", "item_id", "n_shingles", "n_shared").collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)


@pytest.mark.parametrize("broadcast", [None, False])
def test_stage_drops_only_those(spark, docs_frame, make_text, broadcast):
    item = make_text(7, 30)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    half = item.split()
    docs = docs_frame([(1, item), (2, make_text(8, 100)), (3, None), (2, "x " + item), (4, " ".join(half[:17])), (4, " ".join(half[13:])), (None, item), (None, "other")])
    out = D.drop_contaminated(docs, items, broadcast=broadcast)
    assert out.columns == docs.columns and sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=str) == sorted(
        [(2, make_text(8, 100)), (3, None), (4, " ".join(half[:17])), (4, " ".join(half[13:])), (None, "other")], key=str)
    assert D.drop_contaminated(docs, items.limit(0), broadcast=broadcast).count() == 8 and D.contaminated_pairs(docs.limit(0), items, broadcast=broadcast).count() == 0


def test_sketches_of_documents_are_partial_and_enough(make_text):
    """A large class's cutoff leaves out most of a document's hashes, and each document at the threshold still shares one."""
    items = [(i, make_text(i, 200)) for i in range(20)]
    index = D.Index(items)
    (_, cutoff, *_), = index.classes
    assert int(cutoff) / 2**64 < 0.35
    for i, text in items:
        words = text.split()
        assert [x[0] for x in index.search(make_text(900 + i, 5000) + " " + " ".join(words[20:182]))] == [i]
