"""FM-index: index, search, location and cutting against brute force."""

import random

import brute
import numpy as np
import pytest

from fettle.llm import contamination as C

rng = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(12)] + ["É", "日本", "x9"]


def _text(n):
    return "".join(w + rng.choice([" ", "\n", ", ", "--", "."]) for w in rng.choices(VOCABULARY, k=n))


@pytest.mark.parametrize("n,size", [(1, 2), (50, 3), (400, 5), (900, 200)])
def test_suffix_array_and_index(n, size):
    sequence = np.append(np.random.default_rng(n).integers(1, size, n), 0)
    sa = C.suffix_array(sequence, int(size - 1).bit_length() or 1)
    values = sequence.tolist()
    assert sa.tolist() == sorted(range(n + 1), key=lambda i: values[i:])
    index = C.FMIndex(sequence, size)
    phrases = [values[i:i + k] for i in range(0, n, 7) for k in (1, 2, 5) if i + k <= n]
    table = np.array([p + [0] * (5 - len(p)) for p in phrases])
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(n + 1) if values[i:i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def _tables(spark):
    items = [(i, _text(rng.choice([1, 3, 9, 10, 14, 30]))) for i in range(25)] + [(3, "repeated under one id w1 w2"), (90, None), (91, ""), (None, _text(12))]
    texts = [_text(rng.randrange(0, 120)) for _ in range(120)] + [None, "", " .,", items[5][1].upper(), items[5][1]]
    for i, t in items[:12]:
        texts.append(f"{_text(15)} {t} {_text(4)}")
        texts.append(texts[-1])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, words string").repartition(3)
    return docs, spark.createDataFrame(items, "item_id bigint, text string"), texts, [("" if i is None else i, t) for i, t in items]


@pytest.mark.parametrize("shard_bytes,block_bytes", [(1 << 20, 1 << 20), (400, 1 << 20), (1 << 20, 300), (50, 50)])
def test_passages_equal_brute_force(spark, shard_bytes, block_bytes):
    docs, bench, texts, items = _tables(spark)
    want = brute.passages(texts, items)
    found = C.find_passages(docs, bench, shard_bytes=shard_bytes, block_bytes=block_bytes)
    rows = C.report(found).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]


def test_cut_texts_hold_no_passage(spark):
    items = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (1, "short one")]
    texts = ["Before it, Alpha beta -- gamma delta epsilon zeta eta theta iota kappa lambda mu. After it.", "nothing here", "short ONE", None, "",
             "a short one b"]
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id bigint, text string, clean string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in C.decontaminate(docs, bench).collect()}
    assert sorted(got) == [0, 1, 3, 4, 5]  # of document 2 no word is left
    assert got[0]["text"] == "Before it,  . After it." and got[5]["text"] == "a   b"
    assert got[1]["text"] == "nothing here" and got[3]["text"] is None and got[4]["text"] == ""
    assert all(got[k]["clean"] == texts[k] for k in got)  # a column of the caller's that is named like an inner one


def test_empty_tables(spark, no_docs):
    docs, bench, texts, _ = _tables(spark)
    assert C.report(C.find_passages(no_docs, bench)).count() == 0
    none = C.report(C.find_passages(docs, bench.limit(0)))
    assert none.filter("contaminated").count() == 0 and none.count() == len(texts)


def test_hard_texts(spark, hard_docs, hard_texts):
    bench = spark.createDataFrame([(1, "one"), (2, "10 0 0 255")], "item_id bigint, text string")
    rows = C.report(C.find_passages(hard_docs, bench)).collect()
    want = sorted(map(str, brute.passages(hard_texts, [(1, "one"), (2, "10 0 0 255")])))
    assert sorted(str(tuple(r)[1:]) for r in rows) == want
