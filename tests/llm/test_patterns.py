"""Secrets and personal data: spans of the whole texts against plain Python."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from fettle.llm import personal, secrets


def _by_text(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)


def test_secret_spans_equal_brute_force(spark, hard_texts):
    got = {r["doc_id"]: r for r in secrets.report(secrets.find_secrets(_by_text(spark, hard_texts))).collect()}
    assert len(got) == len(hard_texts)
    for i, t in enumerate(hard_texts):
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.secret_spans(t), t and t[:60]


def test_personal_spans_equal_brute_force(spark, hard_texts):
    got = {r["doc_id"]: r for r in personal.report(personal.find_personal(_by_text(spark, hard_texts))).collect()}
    assert len(got) == len(hard_texts)
    for i, t in enumerate(hard_texts):
        r = got[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == brute.personal_spans(t), t and t[:60]


@pytest.mark.parametrize("alphabet", ["aA0+/=:.token ", "0a. @-+(1", "token=:\"' sAKIA09", "+1 ().-23"])
def test_random_texts_equal_brute_force(spark, alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(120))) for _ in range(150)]
    df = _by_text(spark, texts)
    a = {r["doc_id"]: r for r in secrets.report(secrets.find_secrets(df)).collect()}
    b = {r["doc_id"]: r for r in personal.report(personal.find_personal(df)).collect()}
    for i, t in enumerate(texts):
        assert tuple(a[i][c] for c in ("n_assign", "n_access", "n_hex", "base_sha256")) == brute.secret_spans(t), t
        assert tuple(b[i][c] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == brute.personal_spans(t), t


def test_battery_tells_random_tokens_from_ordinary_ones(spark):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_tokens = ["".join(rng.choices(letters, k=48)) + "7" for _ in range(40)]
    ordinary = [f"authentication-handler-configuration-{i}-version" for i in range(40)] + [f"{'0' * 30}{i:010d}" for i in range(20)]
    df = _by_text(spark, [f"see {t} here" for t in random_tokens + ordinary])
    got = {r["key"]: r for r in secrets.find_secrets(df).collect()}
    caught = [i for i in range(100) if got[i]["added"]]
    assert len([i for i in caught if i < 40]) >= 36
    assert not [i for i in caught if i >= 40]
    span = got[caught[0]]["added"][0]
    assert f"see {random_tokens[caught[0]]} here"[span["start"]:span["end"]] == random_tokens[caught[0]]


def test_lone_characters_beside_padding_are_tested(spark):
    rules = ["1" + "=" * 20, "=" * 10 + "2" + "=" * 10, "x" + "=" * 30 + " a1" + "=" * 25, "7" + "-" * 30]
    got = {r["doc_id"]: r for r in secrets.report(secrets.find_secrets(_by_text(spark, rules + ["token=abcdef12"]))).collect()}
    assert [got[i]["n_random"] for i in range(5)] == [0] * 5 and got[4]["n_assign"] == 1


def test_few_random_tokens_among_many_ordinary_ones(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(letters, k=87)) + "7" for _ in range(8)]
    ordinary = [f"authentication-handler-configuration-of-the-service-account-manager-number-{i}" for i in range(8000)]
    texts = [f"see {k} here" for k in keys] + [" ".join(ordinary[i:i + 400]) for i in range(0, 8000, 400)]
    got = {r["key"]: [(s["start"], s["end"]) for s in r["added"]] for r in secrets.find_secrets(_by_text(spark, texts)).collect()}
    assert sum(got[i] == [(4, 92)] for i in range(8)) >= 7  # 0.1 % of the candidates of their band
    assert not any(got[i] for i in range(8, len(texts)))


def test_grid_steps_keep_small_p_values_apart(spark):
    p = [1.0, 0.5, 0.05, 1 / 4096, 1e-6, 1.02e-6, 8e-20, 1e-299, 0.0]
    step = [r["s"] for r in spark.createDataFrame([(x,) for x in p], "p double").select(secrets.step_of(F.col("p")).alias("s")).collect()]
    for x, s in zip(p[:-1], step):
        assert x * (1 - 1e-9) <= 2.0 ** (-s / secrets.GRID) <= 1.011 * x
    assert len(set(step)) == len(step)


def test_added_spans_never_touch_base_spans(spark, hard_docs):
    for found in (secrets.find_secrets(hard_docs), personal.find_personal(hard_docs)):
        clash = found.filter(F.exists("added", lambda a: F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))))
        assert clash.count() == 0


def test_boosted_trees_learn_and_calibrate():
    cells = [({"form": f, "digits": d, "cue": c}, 80 if (c and d > 2) else 1, 2 if (c and d > 2) else 60)
             for f in (0, 1) for d in range(6) for c in (0, 1)]
    model = personal.boost(cells)
    cut = personal.cut_for(model, cells, 0.95)
    accepted = [f for f, _, _ in cells if personal.score_of(model, f) >= cut]
    assert accepted and all(f["cue"] and f["digits"] > 2 for f in accepted)
    assert personal.cut_for(model, [(f, 0, 9) for f, _, _ in cells], 0.95) == float("inf")


def test_trees_as_columns_equal_trees(spark):
    cells = [({"a": i, "b": j}, i * j, 5) for i in range(4) for j in range(3)]
    start, trees = personal.boost(cells, trees=4)
    df = spark.createDataFrame([(f["a"], f["b"]) for f, _, _ in cells], "a int, b int").select(F.struct("a", "b").alias("f"))
    column = sum((personal.tree_column(t, F.col("f")) for t in trees), F.lit(start))
    for r in df.select("f", column.alias("s")).collect():
        assert abs(r["s"] - personal.score_of((start, trees), r["f"].asDict())) < 1e-9


def test_candidates_are_redacted_in_the_company_of_confirmed_ones(spark):
    lines = [f"phone: +1 (555) 010-{i:04d} ok" for i in range(60)] + [f"see page {i:04d} 1{i:03d} 20 of 3{i:04d}" for i in range(60)]
    lines += [f"phone: 1 (555) 010-{i:04d} ok" for i in range(3)]
    got = {r["key"]: r for r in personal.find_personal(_by_text(spark, lines), precision=0.8).collect()}
    assert all(not got[i]["added"] for i in range(60, 120))
    assert all(got[i]["added"] for i in range(120, 123))


def test_open_forms_are_redacted_by_announced_evidence(spark):
    """No base pattern confirms these; announced ones teach the form, plain numbers and phrases stay."""
    national = [f"please call (0{i % 7 + 20}) 555-{i:04d} today" for i in range(150)]
    spelt = [f"write to jo{i}.smith (at) mail{i % 9} (dot) org for it" for i in range(150)]
    silent = [f"ask for it (0{i % 7 + 20}) 555-{i:04d}" for i in range(3)] + [f"from ann{i} [at] mail [dot] net" for i in range(3)]
    plain = [f"order {i:04d}{7919 * i % 10000:04d} of the hotel {i:03d} 44 1{i:03d} was at the. Of" for i in range(200)]
    texts = national + spelt + silent + plain
    got = {r["key"]: r for r in personal.find_personal(_by_text(spark, texts)).collect()}
    first, last = len(national) + len(spelt), len(national) + len(spelt) + len(silent)
    assert sum(bool(got[i]["added"]) for i in range(first)) >= 0.99 * first
    assert all(got[i]["added"] for i in range(first, last))
    assert not any(got[i]["added"] for i in range(last, len(texts)))
    spans = {texts[i][s["start"]:s["end"]] for i in range(first, last) for s in got[i]["added"]}
    assert {"(020) 555-0000", "ann0 [at] mail [dot] net"} <= spans
    for i, t in enumerate(texts):
        assert not got[i]["base"] and brute.personal_spans(t)[:4] == (0, 0, 0, 0)


def test_cues_are_words(spark):
    rows = [("tel: ", "030 1234567", 1, True), ("hotel ", "030 1234567", 1, False), ("fax no. ", "030 1234567", 1, True),
            ("call ", "12 34 5", 1, False), ("", "030 1234567", 1, False), ("", "a (at) b.de", 0, True), ("at ", "from at and. Of", 0, False),
            ("e-mail ", "a at b.de", 0, True)]
    df = spark.createDataFrame(rows, "before string, found string, form int, want boolean")
    c = F.struct("before", "found", "form")
    assert df.filter(personal.announced(c) != F.col("want")).count() == 0


def test_empty_tables(spark, no_docs):
    assert secrets.report(secrets.find_secrets(no_docs)).count() == 0
    assert personal.report(personal.find_personal(no_docs)).count() == 0
