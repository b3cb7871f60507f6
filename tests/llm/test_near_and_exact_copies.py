"""SimHash groups, near-copy removal and streaming exact deduplication against brute force."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fettle.llm import components, exact, simhash

rng = random.Random(11)
WORDS = [f"w{i}" for i in range(3000)]


def _near(text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 200))) for _ in range(60)]
    out = list(base) + [None, "", " \n", "a b c", "A  b\tC", "É É", "é é"]
    for t in base[:20]:
        out += [t, t.upper(), _near(t, 1), _near(t, 2)]
    long = " ".join(rng.choices(WORDS, k=400))
    out += [_near(long, 1) for _ in range(60)]  # one dense group
    return out


@pytest.mark.parametrize("shard,block", [(30_000, 40_000), (20, 16)])
def test_groups_equal_brute_force(spark, texts, monkeypatch, shard, block):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "LEAF", 64 if shard == 20 else 1 << 20)
    ids = [i if i % 7 else None for i in range(len(texts))]
    docs = spark.createDataFrame([(i, k, t) for k, (i, t) in enumerate(zip(ids, texts))], "doc_id bigint, k int, text string").repartition(3)
    prints = [brute.fingerprint(t) for t in texts]
    want = sorted(str((i, f"{p:016x}", c)) for i, p, c in zip(ids, prints, brute.groups(prints, ids)))
    got = sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in simhash.cluster(docs).collect())
    assert got == want


def test_majority_over_many_hashes():
    g = np.random.default_rng(1)
    sizes = np.array([1, 254, 255, 256, 1000, 3])
    hashes = g.integers(0, 2 ** 63, sizes.sum(), dtype=np.uint64) * np.uint64(2) + g.integers(0, 2, sizes.sum(), dtype=np.uint64)
    got, at = simhash.majority(hashes, sizes), 0
    for n, x in zip(sizes, got):
        part = hashes[at:at + n]
        at += n
        assert int(x) == sum(1 << b for b in range(64) if 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > n)


def test_search_finds_every_pair():
    g = np.random.default_rng(2)
    points = g.integers(0, 2 ** 62, 3000, dtype=np.uint64)
    points[1500:] = points[:1500] ^ (np.uint64(1) << g.integers(0, 62, 1500, dtype=np.uint64)) ^ (np.uint64(1) << g.integers(0, 62, 1500, dtype=np.uint64))
    forest = simhash.Forest(3000)
    simhash.search_block(points, np.arange(3000), np.arange(2500), np.arange(2500, 3000), 4, forest, lambda a, b: np.ones(len(a), bool))
    want = simhash.Forest(3000)
    for i in range(3000):
        j = np.flatnonzero(np.bitwise_count(points[:2500 if i >= 2500 else 3000] ^ points[i]) <= 4)
        want.join(np.full(len(j), i), j)
    assert (forest.label == want.label).all()


def test_routes_meet_every_close_pair():
    g = np.random.default_rng(3)
    half = g.integers(0, 2 ** 62, 2000, dtype=np.uint64)
    points = np.concatenate((half, half ^ np.uint64(0b1011)))
    tree = simhash.vantage_tree(half[:500], 4)
    who, leaf, visits = simhash.route(tree, points, 4)
    assert sorted(who[~visits].tolist()) == list(range(4000))
    home = dict(zip(who[~visits].tolist(), leaf[~visits].tolist()))
    seen = {k: set() for k in range(4000)}
    for k, x in zip(who.tolist(), leaf.tolist()):
        seen[k].add(x)
    assert all(home[k] in seen[k + 2000] or home[k + 2000] in seen[k] for k in range(2000))
    assert 16 == len(set(home.values())) and visits.sum() < 20_000


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7), (1, 2), (2, 1), (259, 160)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got.pop(1) == 1 and got.pop(2) == 1
    assert set(got.values()) == {5} and len(got) == 61 + 60 + 1
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_copies_leave_one_document(spark):
    base = [" ".join(rng.choices(WORDS, k=300)) for _ in range(12)]
    half = [" ".join(base[i].split()[:150] + rng.choices(WORDS, k=150)) for i in range(12)]
    rows = [(i, t, "p") for i, t in enumerate(base)] + [(100 + i, _near(t, 3), "p") for i, t in enumerate(base)]
    rows += [(200 + i, t, "p") for i, t in enumerate(base[:4])] + [(200, base[0], "p"), (None, base[1], "p"), (None, "alone with no key", "p")]
    rows += [(300 + i, t, "p") for i, t in enumerate(half)] + [(400, None, "p"), (401, "", "p"), (402, "tiny text", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, body string").repartition(3)
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] for r in got.collect()), key=lambda x: (x is None, x))
    assert kept == [*range(12), *range(300, 312), 400, 402, None]


def _graded(seed):
    """Texts at all similarities from about 0.5 to 1: chains, dense groups, short texts, repeated shingles."""
    g = random.Random(seed)
    out = []
    for size in (6, 9, 14, 30, 80, 200, 400):
        for _ in range(6):
            base = g.choices(WORDS, k=size)
            out.append(" ".join(base))
            for share in (0.01, 0.02, 0.03, 0.05, 0.08):
                w = list(base)
                for _ in range(max(1, round(share * size))):
                    w[g.randrange(size)] = g.choice(WORDS)
                out.append(" ".join(w))
            out.append(" ".join(base[:round(size * 0.85)]))
            out.append(" ".join(base + base))
    chain = g.choices(WORDS, k=120)
    for _ in range(40):  # each near the one before, the ends far apart
        chain = chain[4:] + g.choices(WORDS, k=4)
        out.append(" ".join(chain))
    return out


@pytest.mark.parametrize("group_bytes", [16 << 20, 4_000])
def test_near_copies_equal_exact_jaccard(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(simhash, "GROUP_BYTES", group_bytes)
    texts = _graded(5)
    sets = [{tuple(t.lower().split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((j, i))
                a, b = sorted((top(i), top(j)))
                label[b] = a
    want = {top(i) for i in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"] for r in simhash.deduplicate(docs).collect()}
    assert want <= got  # nothing below 0.8 is merged
    merged = len(texts) - len(want)
    assert len(got - want) <= 0.02 * merged, (len(got - want), merged)
    assert merged > 60 and len(pairs) > 100


def test_sets_share_what_python_says():
    g = random.Random(3)
    raw = [{g.randrange(50) for _ in range(g.randrange(1, 40))} for _ in range(30)]
    sets = simhash.Sets([b"".join(x.to_bytes(8, "big") for x in sorted(s)) for s in raw])
    a, b = np.array([g.randrange(30) for _ in range(400)]), np.array([g.randrange(30) for _ in range(400)])
    assert sets.shared(a, b).tolist() == [len(raw[x] & raw[y]) for x, y in zip(a, b)]
    assert sets.alike(a, b, 0.8).tolist() == [len(raw[x] & raw[y]) >= 0.8 * len(raw[x] | raw[y]) for x, y in zip(a, b)]


def test_empty_tables(spark, no_docs):
    assert simhash.cluster(no_docs).count() == 0
    assert simhash.deduplicate(no_docs).count() == 0


# -- exact ------------------------------------------------------------------------------

def _weak(text):
    return F.pmod(F.crc32(text.cast("binary")), F.lit(5)).cast("string")


@pytest.mark.parametrize("digest", [exact.sha256, _weak])
def test_exact_groups_equal_brute_force(spark, tmp_path, digest):
    body = ["a b", "a  b", "a\tb\n", "c", None, "", " ", "é  x", "é   x"] + [f"t{i}" for i in range(30)]
    rows = [(i * 3 % 101 if i % 10 else None, t, "x") for i, t in enumerate(body * 3)] + [(7, "hot", "x")] * 3 + [(i, "hot", "x") for i in range(500, 700)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id bigint, text string, digest string").repartition(5).write.parquet(path)
    import re
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    members = {}
    for i, t, _ in rows:
        members.setdefault(norm(t), []).append(i)
    got = exact.deduplicate(spark, path, digest=digest).collect()
    assert len(got) == len(rows)
    want = {(i, min((x for x in m if x is not None), default=None), len(m)) for m in members.values() for i in m}
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == want
    assert sum(r["kept"] for r in got) == len(members)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    if digest is exact.sha256:
        assert {r["digest"] for r in got} == {brute.sha(t) for t in members}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, folder = f"{tmp_path}/docs", f"{tmp_path}/state"
    one = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id bigint, text string")
    one.coalesce(1).write.parquet(path)
    exact.first_seen(spark, path, "doc_id", "text", folder)
    spark.createDataFrame([(1, "a"), (9, "c")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(path)
    state = exact.first_seen(spark, path, "doc_id", "text", folder)
    got = {r["digest"]: (r["n"], r["first"]["key"]) for r in state.collect()}
    assert got == {brute.sha("a"): (2, 1), brute.sha("b"): (1, 6), brute.sha("c"): (1, 9)}


def test_exact_on_single_file_and_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/none.parquet")
    assert exact.deduplicate(spark, f"{tmp_path}/none.parquet").count() == 0
    import pyarrow as pa
    import pyarrow.parquet as pq
    pq.write_table(pa.table({"doc_id": [2, 1], "text": ["x ", "x\n"]}), f"{tmp_path}/one.parquet")
    rows = exact.report(exact.deduplicate(spark, f"{tmp_path}/one.parquet")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows) == [(1, 1, 2, True), (2, 1, 2, False)]


def test_exact_copies_beside_clashing_columns(spark, tmp_path):
    rows = [(i, f"text {i % 3}", "x", i, "f") for i in range(9)]
    path = str(tmp_path / "clash.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string, _metadata string, digest int, `file` string").write.parquet(path)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.deduplicate(spark, path).collect()}
    assert got == {i: (i % 3, 3, i < 3) for i in range(9)}
