"""Fill-in-middle, ranked search and coded ids against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fettle.llm import balltree, idcoder, infill

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

# -- fill in the middle -----------------------------------------------------------------

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def fim(doc_id, text):
    """The contract by a plain regular expression over code points."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return n, form, len(pre), len(mid), sha(out), sha(text)


HARD = [None, "", " ", "\n\t ", "a", " a", "a ", "é", "é  ü\x0b\U0001F600 x ", "<P> in it", "a<", "P>b <S", "x <", "\x1f \x85  y", "é" * 5_000,
        "\U0001F600 a€ " * 20_000, "w " * 50_000]


def test_infill_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(HARD * 6)] + [(None, "a b c d"), (7, "same é same"), (7, "same é same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = infill.report(infill.transform(docs)).collect()
    assert Counter(tuple(r[1:]) for r in got) == Counter(
        (n, form, pre, mid, out, back) for n, form, pre, mid, out, back in (fim(*r) for r in rows))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_cuts_by_character_and_keeps_columns(spark):
    docs = spark.createDataFrame([(i, "aé€\U0001F600" * 9, "u", "f") for i in range(60)], "doc_id bigint, text string, units string, `a.b` string")
    out = infill.transform(docs, unit="char", fim=100)
    assert out.columns == ["doc_id", "a.b", "units", "form", "output", "prefix_chars", "middle_chars"]
    rows = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    for r in rows:
        h = infill.hashes(r["doc_id"], 42)
        a, b = sorted((h[0] % 37, h[1] % 37))
        assert (r["units"], r["prefix_chars"], r["middle_chars"], r["back"]) == (36, a, b - a, "aé€\U0001F600" * 9)
        assert r["output"].endswith("<M>" + ("aé€\U0001F600" * 9)[a:b])
    assert infill.transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.transform(docs, unit="line")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a é€\U0001F600\n\x1f ", max_size=40))
def test_exception_index_converts_both_ways(text):
    data = text.encode()
    index = infill.Exceptions(data)
    points = np.arange(len(text) + 1)
    places = [len(text[:k].encode()) for k in points]
    assert index.bytes_of(points).tolist() == places and index.points_of(places).tolist() == points.tolist()
    assert len(index.at) == sum(c > "\x7f" for c in text)
    assert [data[:e].decode() for e in infill.word_ends(data)] == ["".join(UNITS.findall(text)[:k + 1]) for k in range(len(UNITS.findall(text)))]


# -- ranked search ----------------------------------------------------------------------

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [t for t in TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]


def ranked(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    used = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(used), sum(n for _, _, n in used)
    df = Counter(t for _, c, _ in used for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in used:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes,block_terms", [(8 << 20, 8_192), (3_000, 25)])
def test_search_equals_brute_force(spark, shard_bytes, block_terms):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(300)]
    text = lambda n: " ".join(vocabulary[min(299, int(rng.expovariate(0.02)))] for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(500)] + [(900 + i, "w1 w2 w3 tie") for i in range(15)]
    docs += [(None, "w1 w2 w3 tie"), (1000, None), (1001, ""), (1002, "!!"), (1003, text(5_000)), (1003, text(30)), (3, docs[3][1])]
    items = [(i, text(12)) for i in range(25)] + [(90, None), (91, ""), (92, "absent words"), (93, "tie TIE tie"), (94, docs[40][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("x")).repartition(5)
    got = balltree.search(frame, spark.createDataFrame(items + items[:2], "item_id bigint, text string"), shard_bytes=shard_bytes, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items)


def test_search_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id bigint, item_id bigint, text string"), spark.createDataFrame([(1, 1, "a b")], "doc_id bigint, item_id bigint, text string")
    assert [balltree.search(a, b).count() for a, b in ((none, none), (none, some), (some, none), (some, some))] == [0, 0, 0, 1]


def test_subtrees_are_pruned_and_nothing_is_lost():
    rng = np.random.default_rng(5)
    topics = [[f"t{k}x{i}" for i in range(40)] for k in range(20)]
    texts = [" ".join(rng.choice(topics[i % 20], 30)) for i in range(4_000)]
    block = balltree.blocks_of([(k, " ".join(topics[k][:12])) for k in range(20)], 10_000)[0]
    shard = balltree.Shard(texts)
    weights = np.full(len(block.column), 3_000, np.int64)
    best = {k: balltree.Best(10) for k in range(20)}
    total = int(shard.length.sum())
    scored = balltree.search_shard(shard, list(range(4_000)), block, weights, 4_000, total, best)
    assert scored < 0.25 * 20 * 4_000
    for k in range(20):
        m = 25 + (75 * 30 * 4_000) // total
        full = sorted((-sum(3_000 * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in topics[k][:12] if t in c), i)
                      for i, c in ((i, Counter(t.split())) for i, t in enumerate(texts)) if any(t in c for t in topics[k][:12]))[:10]
        assert [(-s, i) for s, i in best[k].rows] == full


# -- coded ids --------------------------------------------------------------------------

def lists_of_ids():
    low, any_id = st.integers(0, 5), st.integers(0, 65_535)
    return st.lists(st.one_of(st.lists(low, max_size=200), st.lists(any_id, max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(lists_of_ids())
def test_blocks_come_back(blocks):
    coded = idcoder.encode([np.array(b, np.uint32) for b in blocks])
    assert [d.tolist() for d in idcoder.decode(coded, [len(b) for b in blocks])] == blocks
    assert all(c == b"" for c, b in zip(coded, blocks) if not b)


def test_carries_and_long_runs_come_back(monkeypatch):
    monkeypatch.setattr(idcoder, "LANES", 3)
    rng = np.random.default_rng(1)
    blocks = [np.full(9_000, 65_535), np.zeros(5_000), rng.integers(0, 65_536, 6_000), np.arange(7_000) % 3, np.repeat(rng.integers(0, 65_536, 900), 8),
              rng.zipf(1.3, 8_000) % 65_536, np.array([65_535])]
    blocks = [b.astype(np.uint32) for b in blocks]
    coded = idcoder.encode(blocks)
    assert all((a == b).all() for a, b in zip(idcoder.decode(coded, list(map(len, blocks))), blocks))
    assert len(coded[0]) < 400 and len(coded[3]) < 400 and len(coded[2]) < 2.3 * 6_000
    alone = [idcoder.encode([b])[0] for b in blocks]  # a block does not depend on its neighbours
    assert alone == coded
    with pytest.raises(ValueError):
        idcoder.encode([np.array([1 << 16])])


def test_blocks_are_coded_in_little_memory_and_no_symbol_is_searched_level_by_level(monkeypatch):
    """A tree of counts for each block took 131 KB, and 16 levels of it for each id that was not predicted."""
    import tracemalloc

    rng = np.random.default_rng(8)
    blocks = [rng.integers(0, 65_536, 40).astype(np.uint32) for _ in range(400)]
    tracemalloc.start()
    coded = idcoder.encode(blocks)
    back = idcoder.decode(coded, [40] * 400)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(back, blocks)) and most < 20_000_000
    # counts that are too large together are halved, and the ids come back
    monkeypatch.setattr(idcoder, "_MOST", 100)
    few = [(rng.zipf(1.5, 3_000) % 60).astype(np.uint32), np.zeros(50, np.uint32)]
    assert [d.tolist() for d in idcoder.decode(idcoder.encode(few), [3_000, 50])] == [b.tolist() for b in few]


def test_damaged_blocks_end_with_other_ids():
    block = (np.arange(3_000) * 7_919 % 5_000).astype(np.uint32)
    whole = idcoder.encode([block])[0]
    rng = np.random.default_rng(9)
    for at in [*rng.integers(0, len(whole), 20).tolist(), len(whole) - 1, len(whole) - 4]:
        spoilt = bytearray(whole)
        spoilt[at] ^= 0x5A
        got = idcoder.decode([bytes(spoilt)], [len(block)])[0]
        assert len(got) == len(block) and (at < len(whole) - 4 or not (got == block).all())


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_words_are_tokenised_as_in_whole_texts(tokenizer):
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(tokenizer), idcoder.Words(tokenizer)
    rng = random.Random(2)
    signs = ["a", "B", "é", " ", " ", " ", "\n", "\t", "'s", "'", "7", ".", " ", " ", "\U0001F600", "中", "\x1f", "\x85", "word", "<|endoftext|>", "́", "‍"]
    texts = ["", " ", "  a", "a  ", "a   b", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3_000))]
    got = words.encode(texts, 2)
    for t, ids in zip(texts, got):
        assert ids.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2], repr(t)
    assert [i.tolist() for i in words.encode(texts, 2)] == [i.tolist() for i in got]


def test_new_words_are_handed_over_in_rows(tokenizer):
    """The tokenizer was called with every new word by itself."""
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(tokenizer), idcoder.Words(tokenizer)
    rng, seen, run = random.Random(6), [], words.run
    words.run = lambda texts, **kind: (seen.append(len(texts)), run(texts, **kind))[1]
    texts = [" ".join("".join(rng.choice("abcé中d.\n") for _ in range(rng.randint(1, 9))) for _ in range(400)) + end for end in ("", "\n", " ", "é")]
    got = words.encode([*texts, "", "<|endoftext|> a b"], 2)
    assert [g.tolist() for g in got] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in [*texts, "", "<|endoftext|> a b"]]
    assert sum(seen) < 600


def test_ids_are_written_in_order_and_read_back(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gämma", "12", "\n\n"]) for _ in range(rng.randint(0, 400))) for _ in range(120)]
    rows = [(i * 7 % 121, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "long text " * 9_000), (503, "x"), (503, "x"), (None, "last")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1)).repartition(4)
    path = str(tmp_path / "ids")
    idcoder.write(docs, path, tokenizer, block_ids=64, frame_ids=300)
    got = idcoder.report(idcoder.read(spark, path)).collect()
    expected, at = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    frames = spark.read.parquet(path)
    assert frames.agg(F.max(F.array_max("sizes"))).first()[0] == 64 and frames.count() > 20


def test_damage_is_found_and_nothing_is_nothing(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id bigint, text string")
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    idcoder.write(docs, whole, tokenizer)
    frames = spark.read.parquet(whole)
    spoilt = F.transform("blocks", lambda b: F.unhex(F.concat(F.lit("A1B2C3"), F.substring(F.hex(b), 7, 1 << 20))))
    frames.withColumn("blocks", spoilt).write.parquet(broken)
    with pytest.raises(Exception, match="is damaged"):
        idcoder.read(spark, broken).collect()
    idcoder.write(docs.limit(0), str(tmp_path / "none"), tokenizer)
    assert idcoder.read(spark, str(tmp_path / "none")).count() == 0
