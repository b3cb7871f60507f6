"""Sharding, mixing, chat, fixity, toxicity and the pipeline."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from fettle.llm import chat, fixity, mixing, sharding, toxicity

# -- sharding ---------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 2_000])
def test_shards_are_level_gapless_and_whole(spark, bucket_bytes):
    rows = [(i if i % 11 else None, f"text é {i}" * (i % 5), "s") for i in range(500)] + [(3, None, "s"), (4, "", "s")] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string").repartition(4)
    got = sharding.two_pass_shuffle(docs.withColumnRenamed("shard", "bucket"), shards=7, bucket_bytes=bucket_bytes)
    assert got.columns == ["doc_id", "text", "bucket", "shard", "slot"]
    out = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((i, t) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.two_pass_shuffle(docs, shards=7, bucket_bytes=bucket_bytes)  # the column named shard is replaced
    lone = lambda rs: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rs if r["doc_id"] not in (None, 3, 4))
    if bucket_bytes == 1 << 20:
        assert len(lone(again.collect())) == len(lone(out))


def test_order_is_shuffled_and_reproducible(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    one, two = (sharding.two_pass_shuffle(d, shards=1, bucket_bytes=4_000) for d in (docs, docs.repartition(5)))
    order = [r["doc_id"] for r in one.orderBy("slot").collect()]
    assert order == [r["doc_id"] for r in two.orderBy("slot").collect()]
    falls = sum(a > b for a, b in zip(order, order[1:]))
    assert 150 < falls < 250 and order != sorted(order)


def test_few_rows_of_many_bytes_are_spread(spark):
    rows = spark.createDataFrame([(7, "x" * 50_000)] * 120 + [(i, "y") for i in range(100, 200)], "doc_id bigint, text string")
    packed = rows.select(F.struct("doc_id", "text").alias("row"), F.col("doc_id").alias("key"), F.col("text").alias("body")).repartition(3)
    size = 6_000_000 // 20
    heavy = sharding.scatter(packed, 1, 20, size).groupBy("bucket").agg(F.sum(F.length("row.text")).alias("n")).collect()
    assert len(heavy) == 20 and max(r["n"] for r in heavy) < 3 * size  # one key holds 99 % of all bytes
    got = sharding.two_pass_shuffle(rows, shards=4, bucket_bytes=size).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [55] * 4


def test_hot_keys_are_spread(spark):
    docs = spark.range(2000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("x" * 50).alias("text"))
    rows = docs.select(F.struct("doc_id").alias("row"), F.col("doc_id").alias("key"), F.col("text").alias("body"))
    counts = [r["count"] for r in sharding.scatter(rows, 1, 20, 4_000).groupBy("bucket").count().collect()]
    assert len(counts) == 20 and max(counts) < 200
    report = sharding.report(sharding.two_pass_shuffle(docs, shards=24)).collect()
    assert len(report) == 2000 and {r["text_crc32"] for r in report} == {brute.crc("x" * 50)} and {r["size"] for r in report} == {58}


# -- mixing -----------------------------------------------------------------------------

def test_poisson_tables_and_counts(spark):
    table = spark.createDataFrame([(0.0,), (0.3,), (7.9,), (30.0,)], "rate double")
    parts, steps = mixing.poisson_table(F.col("rate"))
    for r in table.select("rate", parts.alias("p"), steps.alias("s")).collect():
        mean, p, total = r["rate"] / r["p"], math.exp(-r["rate"] / r["p"]), 0.0
        for k, c in enumerate(r["s"]):
            total += p
            assert abs(c - total) < 1e-9
            p = p * mean / (k + 1)
        assert r["p"] == max(1, math.ceil(r["rate"] / 8))


def test_copies_follow_the_target_weights(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("c").alias("copies"), F.when(
        F.col("id") < 6000, "a").when(F.col("id") < 8000, "b").when(F.col("id") < 8900, None).otherwise("d").alias("source"))
    mixed = mixing.mix(docs, weights={"a": 1.0, "b": 2.0, "d": 1.0})
    assert mixed.columns == ["doc_id", "text", "copies", "source", "copy", "order_key"]
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert None not in n
    for source, share in (("a", 0.25), ("b", 0.5), ("d", 0.25)):
        want = share * 8100
        assert abs(n[source] - want) < 5 * math.sqrt(want * (22 if source == "d" else 1.1))
    order = [r["order_key"] for r in mixed.collect()]
    assert order == sorted(order)


def test_mixing_edges(spark, hard_docs, no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.mix(hard_docs, weights={}).count() == 0
    once = sorted(str(tuple(r)) for r in mixing.mix(hard_docs).collect())
    assert once == sorted(str(tuple(r)) for r in mixing.mix(hard_docs.repartition(7)).collect())


# -- chat -------------------------------------------------------------------------------

LOG = "conv_id bigint, seq bigint, message_id bigint, event string, role string, text string"


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "Hel"), (1, 4, 2, "delta", None, "lo"),
        (1, 4, 2, "delta", None, "lo"),  # delivered twice
        (1, 5, 3, "message", "user", "again?"), (1, 6, 4, "delta", "assistant", "ye"), (1, 7, 4, "delta", None, "s"),
        (1, 8, 2, "regenerate", None, None), (1, 9, 2, "delta", None, "Good "), (1, 10, 2, "delta", None, "day"),
        (1, 11, 5, "message", "user", "tx"), (1, 12, 5, "edit", None, "thanks"), (1, 13, 5, "delta", None, "!"),
        (2, 1, 1, "message", None, None), (None, None, None, None, None, None),
    ]
    random.Random(1).shuffle(log)
    got = {r["conv_id"]: [(m["role"], m["text"]) for m in r["messages"]]
           for r in chat.reconstruct(spark.createDataFrame(log, LOG).repartition(3)).collect()}
    assert got[1] == [("user", "hi"), ("assistant", "Good day"), ("user", "thanks!")]
    assert got[2] == [("", "")] and got[None] == [("", "")]


def test_round_trip_of_any_text(spark, hard_texts):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "\\|", "<\\|", "<|", "<<||", "\\n", "a\nb", "<|im_end|>\n<|im_start|>", "\\\\<|x\\<|", ""]
    rows = [(c, k, ("assistant", "user", "system", None, "we ird\n<|role|>\\")[k % 5], t) for c in range(3) for k, t in enumerate(nasty + hard_texts)]
    rows += [(0, 0, "assistant", "tie"), (0, 0, "assistant", "tie"), (None, None, None, None), (9, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    rendered = chat.render(chat.reconstruct(chat.log_of(df)))
    got = {r["conv_id"]: r for r in chat.report(rendered).collect()}
    by = defaultdict(list)
    for c, k, role, t in rows:
        by[c].append((k is not None, k or 0, role is not None, role or "", t is not None, t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = [(x[3], x[5]) for x in turns]
        learnt = "".join(t for r, t in said if r == "assistant")
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == brute.sha("".join(f"{r}\n{t}\n" for r, t in said))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), brute.sha(learnt))
    text = {r["conv_id"]: r["formatted"] for r in rendered.collect()}
    assert all(t.count("<|im_start|>") == t.count("<|im_end|>") == len(by[c]) for c, t in text.items())
    assert chat.reconstruct(spark.createDataFrame([], LOG)).count() == 0


# -- fixity -----------------------------------------------------------------------------

def _replica(spark, rows):
    return spark.createDataFrame(rows, "archive bigint, offset bigint, bytes bigint, sha256 string, extra string").repartition(3)


@pytest.mark.parametrize("size,fanout", [(1 << 20, 64), (64, 2), (40, 3)])
def test_damage_is_located(spark, monkeypatch, size, fanout):
    monkeypatch.setattr(fixity, "RANGE", size)
    monkeypatch.setattr(fixity, "FANOUT", fanout)
    good = [(a, o * 10, 10, hashlib.sha256(f"{a}{o}".encode()).hexdigest(), None) for a in range(4) for o in range(60)]
    bad = [r for r in good if (r[0], r[1]) != (1, 590)]  # lost at the end of an archive
    bad[5] = (*bad[5][:3], "other", None)
    bad[200] = (*bad[200][:2], 9, *bad[200][3:])  # only the length differs
    bad.append((7, 0, 10, "whole archive", None))
    damage, roots = fixity.audit(_replica(spark, good), _replica(spark, bad))
    got = {(r["archive"], r["offset"]): r["status"] for r in damage.collect()}
    assert got == {(0, 50): "changed", bad[200][:2]: "changed", (1, 590): "missing", (7, 0): "extra"}
    assert roots.count() == 4
    assert fixity.audit(_replica(spark, good), _replica(spark, good))[0].count() == 0
    assert fixity.audit(_replica(spark, []), _replica(spark, []))[0].count() == 0
    # the first replica's root changes with any record
    changed = {r["archive"]: r["hash"] for r in fixity.audit(_replica(spark, bad), _replica(spark, good))[1].collect()}
    assert [changed[r["archive"]] == r["hash"] for r in roots.orderBy("archive").collect()] == [False, False, True, bad[200][0] != 3]


def test_pages_with_nulls_and_repeated_numbers(spark):
    rows = [(i, f"u{i}", "h" * i) for i in range(12)] + [(5, "u5", "hhhhh"), (5, None, None), (None, None, None), (None, "x", ""), (6, "é", "日本")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    out = fixity.report(*fixity.replicas_of(pages)).collect()
    assert len(out) == len(rows)
    assert Counter(r["status"] for r in out) == {"changed": 3, "missing": 1, "ok": 13}
    ends = sorted((r["archive"], r["record_offset"], r["record_bytes"]) for r in out)
    assert all(b[0] != a[0] or b[1] == a[1] + a[2] for a, b in zip(ends, ends[1:]))
    assert fixity.report(*fixity.replicas_of(pages.limit(0))).count() == 0


# -- toxicity ---------------------------------------------------------------------------

def _speech(n, rude, seed):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in "aeiou"]
    out = []
    for _ in range(n):
        w = r.choices(words, k=r.randrange(20, 120))
        for _ in range(rude and r.randrange(1, 9)):
            w.insert(r.randrange(len(w)), r.choice(["vile", "rotten", "wretched", "foul"]))
        out.append(" ".join(w))
    return out


def test_ordinal_model_on_held_out_texts(spark):
    rows = [(t, 1) for t in _speech(250, 1, 1)] + [(t, 0) for t in _speech(250, 0, 2)]
    rows += [(_speech(1, 0, 3)[0] + " copied passage with its own vocabulary", 1)] * 60  # copies teach nothing about their words
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(0, None), (None, 1), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    assert {"vile", "rotten", "wretched", "foul"} <= set(model.weights) and "vocabulary" not in model.weights
    held = _speech(100, 1, 8) + _speech(100, 0, 9) + [None, "", "..."]
    scored = toxicity.score(spark.createDataFrame([(i, t, "x") for i, t in enumerate(held)], "doc_id bigint, text string, Toxic string"), model)
    assert scored.columns == ["doc_id", "text", "severity", "p_toxic", "toxic"]
    got = {r["doc_id"]: r for r in scored.collect()}
    assert sum(got[i]["toxic"] for i in range(100)) >= 97 and not any(got[i]["toxic"] for i in range(100, 203))
    worst = "vile rotten foul wretched " * 3
    assert model.shares(worst)[2] > model.shares("ba be vile")[2]
    assert sum(model.shares(worst)) > sum(model.shares("ba vile")) > sum(model.shares("ba be"))


def _inflected(n, rude, seed):
    """Rude texts hold stems with one of 600 endings each, so hardly a form comes twice."""
    r = random.Random(seed)
    words = [f"{a}{b}{c}ol" for a in "bcdfghklm" for b in "aeiou" for c in "lmnrst"]
    endings = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrstvxyz"]
    out = []
    for _ in range(n):
        w = r.choices(words, k=r.randrange(40, 120))
        for _ in range(rude and r.randrange(3, 8)):
            w.insert(r.randrange(len(w)), r.choice(["achlich", "réeux", "bomente"]) + r.choice(endings))
        out.append(" ".join(w))
    return out


def test_inflected_forms_share_their_evidence(spark):
    rows = [(t, 1) for t in _inflected(120, 1, 31)] + [(t, 0) for t in _inflected(600, 0, 32)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    for limit in (toxicity.SAMPLE_ROWS, 150):  # fewer clean texts in the fit than there are
        model = toxicity.train(docs, labels, rows=limit)
        held = [model.shares(t)[0] >= toxicity.CUT for t in _inflected(100, 1, 33) + _inflected(300, 0, 34)]
        assert sum(held[:100]) >= (95 if limit > 600 else 70) and not any(held[100:])


def test_many_more_labels_than_rows(spark):
    rows = [(t, 1) for t in _speech(600, 1, 41)] + [(t, 0) for t in _speech(5_400, 0, 42)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, rows=600)
    held = [model.shares(t)[0] >= model.cut for t in _speech(100, 1, 43) + _speech(400, 0, 44)]
    assert sum(held[:100]) >= 90 and sum(held[100:]) < 8
    assert toxicity.LEAST_CUT <= model.cut <= toxicity.CUT


def test_fit_ends_where_the_loss_is_least():
    """The derivative of the loss, written out over whole texts, vanishes at the fitted weights."""
    r = random.Random(9)
    texts = [(" ".join(r.choices("ab cd ef gh ij kl mn".split(), k=r.randrange(1, 9))), int(r.random() < 0.4)) for _ in range(60)]
    model = toxicity.fit(texts, ridge=2.0, rounds=500, tolerance=1e-7)

    def loss(weights):
        m = toxicity.Ordinal(weights, model.thresholds, model.stems)
        total = sum(2.0 * w * w / 2 for w in weights.values())
        for t, y in texts:
            p = m.shares(t)
            total -= math.log(p[0] - p[1] if y else 1 - p[0])
        return total

    for word in model.weights:
        up, down = (loss({**model.weights, word: model.weights[word] + d}) for d in (1e-4, -1e-4))
        assert abs(up - down) / 2e-4 < 1e-3, word


def test_least_point_of_a_quadratic():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 20))
    h, b = a.T @ a + np.eye(20), rng.normal(size=20)
    x = toxicity.minimum(lambda v: (0.5 * v @ h @ v - b @ v, h @ v - b), np.zeros(20), 300, 1e-9)
    assert np.allclose(x, np.linalg.solve(h, b), atol=1e-6)


def test_no_labels_and_no_documents(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(hard_docs, labels)
    assert toxicity.score(hard_docs, model).filter("toxic").count() == 0
    assert toxicity.score(no_docs, model).count() == 0


# -- queries and pipeline ---------------------------------------------------------------

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted copies, passages and insults."""
    path = str(tmp_path_factory.mktemp("corpus"))
    r = random.Random(21)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnrst"]
    text = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, text(25)) for i in range(6)]
    clean = [text(r.randrange(60, 200)) for _ in range(150)]
    rude = [text(60) + " vile " + text(10) + " rotten foul " + text(5) for _ in range(60)]
    leaks = [f"{text(40)} {items[i % 6][1]} {text(40)}" for i in range(12)]
    near = [clean[i].replace(clean[i].split()[30], "changed", 1) for i in range(10)]
    groups = [("clean", clean), ("rude", rude), ("leak", leaks), ("near", near), ("copy", clean[10:20])]
    rows, kind = [], {}
    for name, texts in groups:
        for t in texts:
            kind[len(rows)] = name
            rows.append((len(rows), t, "en", f"src{len(rows) % 3}", len(t)))
    labels = [(i, 1, int(kind[i] == "rude")) for i in range(len(rows)) if i % 4]
    pages = [(i, f"http://x/{i}", "<p>" + t + "</p>") for i, t in enumerate(clean)]
    chats = [(i // 3, i % 3, ("system", "user", "assistant")[i % 3], t) for i, t in enumerate(clean)]
    for name, data, schema in (
            ("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
            ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", items, "item_id bigint, text string"),
            ("pages", pages, "page_id bigint, url string, html string"),
            ("conversations", chats, "conv_id bigint, turn bigint, role string, text string")):
        spark.createDataFrame(data, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    return path, dict(enumerate(rows)), kind, items


def test_queries_equal_their_sql(spark, folder):
    from fettle.llm.queries import ORACLES, QUERIES

    db = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder[0]}/{name}.parquet/*.parquet'")
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, folder[0])
        want = db.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns), name
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall())), name


def test_other_queries_equal_brute_force(spark, folder):
    from fettle.llm.queries import QUERIES

    path, rows, kind, items = folder
    for name, columns, f in (
            ("op1_secret_scan", ("n_assign", "n_access", "n_hex", "base_sha256"), brute.secret_spans),
            ("op4_personal_data", ("n_email", "n_ip", "n_card", "n_phone", "base_sha256"), brute.personal_spans),
            ("op5_benchmark_passages", ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"), lambda t: brute.passages([t], items)[0])):
        got = {r["doc_id"]: r for r in QUERIES[name](spark, path).collect()}
        assert {i: tuple(got[i][c] for c in columns) for i in got} == {i: f(r[1]) for i, r in rows.items()}, name
    toxic = {r["doc_id"] for r in QUERIES["op9_ordinal_toxicity"](spark, path).filter("toxic").collect()}
    assert toxic == {i for i, k in kind.items() if k == "rude"}
    assert QUERIES["op2_two_pass_sharding"](spark, path).count() == len(rows)


def test_pipeline_stage_by_stage(spark, folder, tmp_path):
    import corpus_pipeline as P

    path, rows, kind, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    assert [n for n, _ in P.STAGES] == names
    left = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, path)
        assert name == "sharding" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = docs.collect()
    ids = lambda name: {r["doc_id"] for r in left[name]}
    assert ids("toxicity") == {i for i, k in kind.items() if k != "rude"}
    assert ids("simhash_near_dedup") == {i for i, k in kind.items() if k in ("clean", "leak")}
    cut = {r["doc_id"]: r for r in left["benchmark_decontamination"]}
    assert set(cut) == ids("simhash_near_dedup")
    for i, r in cut.items():
        assert brute.passages([r["text"]], items)[0][1] == 0 and r["n_chars"] == len(r["text"])
        assert (r["text"] == rows[i][1]) == (kind[i] != "leak")
    assert ids("source_mixing") <= set(cut)
    assert Counter(r["doc_id"] for r in left["sharding"]) == Counter(r["doc_id"] for r in left["source_mixing"])
    sizes = Counter(r["shard"] for r in left["sharding"])
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert P.run(spark, path).count() == len(left["sharding"])


def test_pipeline_on_hard_documents(spark, folder, hard_docs, no_docs, tmp_path):
    import corpus_pipeline as P

    odd = hard_docs.withColumns({c: F.lit("mine") for c in ("toxic", "shard", "row", "body", "copy", "bucket", "clean", "id")})
    for docs in (odd, no_docs):
        for k, (name, stage) in enumerate(P.STAGES[:-1]):
            out = stage(spark, docs, folder[0])
            assert out.columns == docs.columns, name
            out.write.parquet(target := f"{tmp_path}/{len(docs.columns)}-{k}")
            docs = spark.read.parquet(target)
        P.STAGES[-1][1](spark, docs, folder[0]).collect()
