"""Order-dependent operators against brute force, with one key holding most rows."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.operators import acoustic, booking, cleaning, explain, ratings, scoring, spread


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", round(rng.gauss(0, 5), 1), i) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, v double, i long").repartition(6), pd.DataFrame(rows, columns=["k", "v", "i"])


def test_running_totals_match_window(skewed):
    df, pdf = skewed
    got = spread.numbered(df, ["k"], ["v", "i"]).toPandas().set_index("i")["position"]
    want = pdf.sort_values(["v", "i"]).groupby("k").cumcount() + 1
    assert (got.sort_index() == want.set_axis(pdf.sort_values(["v", "i"])["i"]).sort_index()).all()


def test_exact_quantiles(skewed):
    df, pdf = skewed
    got = spread.exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert got.loc[k, "a"] == pytest.approx(np.percentile(g.v, 25))
        assert got.loc[k, "b"] == pytest.approx(np.median(g.v))


def test_quantiles_of_one_repeated_value(spark):
    df = spark.range(500).select(F.lit("x").alias("k"), F.lit(4.0).alias("v"))
    assert spread.exact_quantiles(df, ["k"], "v", {"m": 0.5}).first().m == 4.0


def test_hot_slice_is_split(skewed):
    df, _ = skewed
    sliced = df.repartitionByRange(4, "k", "v", "i").withColumn("s", F.spark_partition_id())
    hot = sliced.filter("k = 'hot'").select("s").distinct().count()
    assert hot > 1


def test_tied_ranks(skewed):
    df, pdf = skewed
    got = spread.tied_ranks(df, "v", "r").toPandas().set_index("v")["r"]
    want = pdf.assign(r=pdf.v.rank(method="average")).drop_duplicates("v").set_index("v")["r"]
    assert np.allclose(got.sort_index(), want.sort_index())


def test_agreement_of_a_large_panel_in_parts(spark):
    """A profile that everyone rates is cut into parts; the agreement is that of all its pairs."""
    rng = random.Random(8)
    rows = [(f"r{i:02d}", "everyone", rng.randint(1, 4)) for i in range(40)]
    rows += [(f"r{i:02d}", f"p{k}", rng.randint(1, 4)) for i in range(40) for k in range(6) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "rater_id string, profile_id string, rating int")
    want = {}
    by_rater = {r: {p: x for who, p, x in rows if who == r} for r, _, _ in rows}
    for a, b in itertools.combinations(sorted(by_rater), 2):
        both = sorted(set(by_rater[a]) & set(by_rater[b]))
        x, y = (pd.Series([by_rater[r][p] for p in both], dtype=float) for r in (a, b))
        if len(both) >= 3 and x.nunique() > 1 and y.nunique() > 1:
            want[a, b] = (len(both), x.rank().corr(y.rank()))
    for cell in (5, 512):
        got = {(r.rater_a, r.rater_b): (r.n, r.rho) for r in ratings.inter_rater(df, cell=cell).collect()}
        assert got.keys() == want.keys() and len(want) > 100
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_spearman_and_degenerate(spark, skewed):
    _, pdf = skewed
    y = (pdf.v + pdf.i % 5).round(0)
    df = spark.createDataFrame(list(zip(pdf.v.tolist(), y.tolist())), "x double, y double")
    want = pdf.v.rank().corr(y.rank())
    assert ratings.spearman(df, "x", "y").first().rho == pytest.approx(want)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert ratings.spearman(flat, "x", "y").first().rho is None
    same = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 9.0)], "x double, y double")
    assert ratings.spearman(same, "x", "y").first().rho == pytest.approx(1.0)


def test_systematic_sample_positions(spark):
    for n, count in ((13, 5), (50, 50), (7, 20), (101, 10)):
        df = spark.createDataFrame([(f"p{i:03d}", float(i)) for i in range(n)], "pseudonym_id string, welfare_risk_score double")
        got = sorted(int(r.welfare_risk_score) for r in ratings.systematic_sample(df, count).collect())
        want = list(range(n)) if count >= n else [int(i * (n / count)) for i in range(count)]
        assert got == want


def test_calibration_is_that_order_statistic(spark):
    rng = random.Random(1)
    rows = [(f"p{i}", rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "p string, y double, f double")
    got = scoring.calibrate(df, "y", "f", "p").first()
    want = sorted(abs(y - f) for _, y, f in rows)[math.ceil(201 * 0.9) - 1]
    assert got.half_width == pytest.approx(want) and got.quantile_rank == math.ceil(201 * 0.9)
    inside = scoring.empirical_coverage(df, "y", "f", scoring.calibrate(df, "y", "f", "p")).first().coverage
    assert inside >= 0.9


def test_shapley_equals_definition(spark):
    names = P.SIGNALS[:4]
    rng = random.Random(5)
    case = {c: rng.uniform(0, 100) for c in names}
    refs = [{c: rng.uniform(0, 100) for c in names} for _ in range(6)]

    def f(x):
        return x[names[0]] * 0.3 + x[names[1]] * x[names[2]] / 100 + max(x[names[3]], 50)

    def scorer(c):
        return (c[names[0]] * 0.3 + c[names[1]] * c[names[2]] / 100 + F.greatest(c[names[3]], F.lit(50.0)))

    def value(s):
        return np.mean([f({c: case[c] if c in s else r[c] for c in names}) for r in refs])

    want = {}
    for c in names:
        rest = [o for o in names if o != c]
        want[c] = sum(
            math.factorial(k) * math.factorial(3 - k) / 24 * (value({*s, c}) - value(set(s)))
            for k in range(4) for s in itertools.combinations(rest, k))
    cases = spark.createDataFrame([("a", *case.values())], "pseudonym_id string, " + ", ".join(f"{c} double" for c in names))
    ref = spark.createDataFrame([tuple(r.values()) for r in refs], ", ".join(f"{c} double" for c in names))
    got = explain.shapley(cases, ref, names, scorer).first()
    for c in names:
        assert got[c] == pytest.approx(want[c])
    assert sum(got[c] for c in names) == pytest.approx(got.prediction - got.base_value)
    model = explain.shapley_by_model(
        cases.withColumn("still", F.lit(1.0)), ref.withColumn("still", F.lit(1.0)),
        lambda d: d.withColumn("s", scorer({c: F.col(c) for c in names})), "s", [*names, "still"]).first()
    assert model["still"] == 0.0
    assert all(model[c] == pytest.approx(want[c]) for c in names)


def test_scores_as_arrays_equal_scores_as_rows(spark):
    rng = random.Random(8)
    cols = ", ".join(f"{c} double" for c in P.SIGNALS)
    draw = lambda: [rng.uniform(0, 100) for _ in P.SIGNALS]
    cases = [("a", *draw()), ("b", *draw()), ("b", *draw()), (None, *draw()), ("full", *[100.0] * 9),
             ("gap", None, *draw()[1:]), ("nan", float("nan"), *draw()[1:]), ("both", *draw()), ("both", None, *draw()[1:])]
    cases = spark.createDataFrame(cases, f"pseudonym_id string, {cols}")
    plain = [draw() for _ in range(4)] + [[100.0] * 9]
    for refs in (plain, [*plain, [None, *draw()[1:]]]):
        ref = spark.createDataFrame(refs, cols)
        read = lambda df: {r[0]: r[1:] for r in df.collect()}
        want = read(explain._by_rows(cases, ref, P.SIGNALS, explain.signal_index, "pseudonym_id"))
        found = explain.shapley(cases, ref)
        got = read(found)
        assert got.keys() == want.keys() and len(got) == 7
        for key, row in want.items():
            assert got[key] == pytest.approx(row, abs=1e-9, nan_ok=True)
        if refs is plain:  # whole cases do not expand to a row per coalition and reference row
            assert "MapInPandas" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1_200, 100_000])
def test_scanned_baselines_equal_one_long_fold(spark, n):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(5, 1, (n, 7)), columns=P.ACOUSTIC_FEATURES)
    pdf.loc[n // 2:, "pause_ratio"] *= 1e-3  # the floor of the scale takes hold and lets go
    pdf.loc[::97, "pause_ratio"] = 5.0
    if n > 5_000:
        pdf = pdf.assign(**{c: np.nan for c in P.ACOUSTIC_FEATURES if c != "pause_ratio"})
    pdf["sample_id"] = [f"s{i:06d}" for i in range(n)]
    pdf["sample_date"] = pd.Timestamp("2026-01-01").date()
    pdf["pseudonym_id"] = "a"
    got = acoustic.ema_fold(spark.createDataFrame(pdf)).filter("feature = 'pause_ratio'").toPandas()
    got = got.sort_values("sample_id").reset_index(drop=True)
    x = pdf["pause_ratio"].to_numpy()
    centre = float(np.median(x[:3]))
    scale = max((np.percentile(x[:3], 75) - np.percentile(x[:3], 25)) / P.IQR_TO_SD, abs(centre) * 0.02)
    want = []
    for v in x[3:]:
        centre, scale = acoustic.ema_step(centre, scale, v)
        want.append((centre, scale))
    assert len(got) == n - 3
    assert np.allclose(got[["centre", "scale"]].to_numpy(), np.array(want), rtol=1e-11)
    assert np.allclose(got[["prior_centre", "prior_scale"]].to_numpy()[1:], np.array(want)[:-1], rtol=1e-11)


def test_histories_that_begin_without_centre_or_scale(spark):
    values = {"a": [None, None, None, 4.0, 5.0], "b": [2.0, None, None, 3.0, 9.0], "c": [1.0, 2.0, 4.0], "d": [3.0, 3.0, 3.0, 3.0, None, 8.0]}
    rows = [(who, f"{who}{i}", i, v) for who, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "pseudonym_id string, sample_id string, day int, pause_ratio double").withColumn(
        "sample_date", F.date_add(F.lit("2026-01-01").cast("date"), F.col("day")))
    df = df.select("*", *[F.lit(None).cast("double").alias(c) for c in P.ACOUSTIC_FEATURES if c != "pause_ratio"]).repartition(3)
    got = {r["sample_id"]: (r["prior_centre"], r["prior_scale"], r["centre"], r["scale"]) for r in acoustic.ema_fold(df).collect()}
    want = {}
    for who, vs in values.items():
        early = [v for v in vs[:3] if v is not None]
        centre = float(np.median(early)) if early else np.nan
        scale = max((np.percentile(early, 75) - np.percentile(early, 25)) / P.IQR_TO_SD, abs(centre) * 0.02) if len(early) > 1 else np.nan
        for i, v in enumerate(vs[3:], 3):
            if v is not None:
                before = (centre, scale)
                centre, scale = acoustic.ema_step(centre, scale, v)
                want[f"{who}{i}"] = (*before, centre, scale)
    assert got.keys() == want.keys()
    for k, expected in want.items():
        assert np.allclose([np.nan if x is None else x for x in got[k]], expected, rtol=1e-12, equal_nan=True), k


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.3, 0.7, 1.0]), st.floats(-5, 5), st.floats(-5, 5)), min_size=1, max_size=70), st.floats(-9, 9))
def test_scan_composes_max_affine_maps(maps, x):
    a, b, c = acoustic.scan(*(np.array(v, float) for v in zip(*maps)))
    state = x
    for i, (p, q, r) in enumerate(maps):
        state = max(p * state + q, r)
        assert max(a[i] * x + b[i], c[i]) == pytest.approx(state, abs=1e-9)


def test_peaks_by_distance_and_prominence():
    e = np.array([0, 3, 0, 2, 0, 0, 0, 5, 4.9, 5.0, 0], dtype=float)
    assert acoustic.peaks_in(e, 1, 0.5) == 4  # the equal 5.0 tops are both prominent
    assert acoustic.peaks_in(e, 3, 0.5) == 2
    assert acoustic.peaks_in(np.array([0, 1, 1, 1, 0.0]), 1, 0.5) == 1


def test_keep_first_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    kept = cleaning.keep_first(df, ["k"], ["o"])
    assert sorted((r.k, r.v) for r in kept.collect()) == [("a", "y"), ("b", "z")]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_one_winner_per_slot(spark):
    slots = spark.createDataFrame([("s", "d", "t")], "slot_id string, doctor_id string, starts_at string")
    req = spark.createDataFrame(
        [("r1", "s", "p1", 2, "", True, "n"), ("r2", "s", "p2", 1, "", False, "secret"), ("r3", "zz", "p3", 1, "", False, ""),
         ("r4", "s", "p4", 0, "x" * 501, False, "")],
        "request_id string, slot_id string, personnel_id string, requested_at int, reason string, shared_context boolean, context_note string")
    out = {r.request_id: r.outcome for r in booking.claim_outcomes(req, slots).collect()}
    assert out == {"r1": "taken", "r2": "booked", "r3": "unknown slot", "r4": "refused"}
    won = booking.winners(req, slots).first()
    assert won.personnel_id == "p2" and won.context_note == ""
