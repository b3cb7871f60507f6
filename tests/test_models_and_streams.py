"""Fitted models, versioned storage, and each streaming job against its batch twin."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions.keyed_hash import pseudonym
from fettle.operators import acoustic, models, scoring
from fettle.plans.workload import Workload
from fettle.sources import adapter, library
from fettle.streaming import jobs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.uniform(0, 100, (n, len(P.MODEL_INPUTS)))
    y = np.clip(0.4 * x[:, 0] + 0.3 * x[:, 1] + 10 + rng.normal(0, 2, n), 0, 100)
    data = [(f"p{i // 4}", f"p{i // 4}", *map(float, x[i]), float(y[i])) for i in range(n)]
    cols = ", ".join(f"{c} double" for c in P.MODEL_INPUTS)
    df = spark.createDataFrame(data, f"pseudonym_id string, personnel_id string, {cols}, label double")
    return scoring.with_split(df, "personnel_id").cache()


def test_split_is_person_disjoint(rows):
    per = rows.groupBy("personnel_id").agg(F.countDistinct("split").alias("n"))
    assert per.filter("n > 1").isEmpty() and rows.select("split").distinct().count() == 3


def test_linear_candidates_recover_the_plane(rows):
    got = models.compare(rows, [models.linear()]).first()
    assert got.r2 > 0.95 and got.mae < 3


def test_penalty_from_moments_matches_direct_fit(rows):
    folds = [models._moment_matrix(r, 13) for r in models.fold_moments(models.with_fold(rows)).collect()]
    whole = sum(folds)
    _, w = models._solve(whole, 0.0, l1=False)
    fitted, _ = models.fit(rows, models.linear())
    scale = fitted.stages[1].std.toArray()
    direct = fitted.stages[2].coefficients.toArray() / scale
    assert np.allclose(w, direct, atol=1e-6)
    best, errors = models.choose_penalty(rows, l1=True)
    assert best > 0 and len(errors) == 100


def test_missing_input_is_an_error_and_missing_value_is_zero(rows):
    model, _ = models.fit(rows, models.linear())
    with pytest.raises(KeyError):
        models.predict(model, rows.drop(P.SIGNALS[0]))
    gap = rows.limit(1).withColumn(P.SIGNALS[0], F.lit(None).cast("double"))
    zero = rows.limit(1).withColumn(P.SIGNALS[0], F.lit(0.0))
    assert models.predict(model, gap).first().predicted == models.predict(model, zero).first().predicted


def test_versions_pointer_and_refusals(spark, rows, tmp_path):
    model, _ = models.fit(rows, models.linear())
    with pytest.raises(ValueError):
        models.save(model, str(tmp_path), {"label_provenance": " "})
    first = models.save(model, str(tmp_path), {"label_provenance": "index"})
    second = models.save(model, str(tmp_path), {"label_provenance": "index"}, mark_current=False)
    assert models.versions(str(tmp_path)) == sorted([first, second])
    assert models.current_version(str(tmp_path)) == first
    models.save(model, str(tmp_path), {"label_provenance": "index", "feature_names": ["other"]})
    with pytest.raises(ValueError):
        models.load(str(tmp_path))


def test_selection_rule(spark):
    def pick(tree, other):
        df = spark.createDataFrame([("t", True, tree), ("o", False, other)], "model_name string, is_tree boolean, r2 double")
        return scoring.select_model(df).first().selected

    assert pick(0.70, 0.715) == "t" and pick(0.70, 0.73) == "o"
    only = spark.createDataFrame([("o", False, 0.1)], "model_name string, is_tree boolean, r2 double")
    assert scoring.select_model(only).first().selected == "o"


# --- streams --------------------------------------------------------------------
def same(a, b):
    cols = sorted(a.columns)
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert key(a.select(*cols).collect()) == key(b.select(*cols).collect())


@pytest.fixture(scope="module")
def w(spark):
    return Workload(spark, SMALL, b"test key")


def in_files(df, tmp_path, name, files=5):
    """The table as a folder of several files, rows shuffled over them."""
    df.orderBy(F.rand(3)).repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def streamed(spark, folder, name, partial, tmp_path, one_by_one=1):
    """Partial rows of a folder table read in micro-batches of one file."""
    like = spark.read.parquet(f"{folder}/{name}.parquet")
    out = f"{tmp_path}/{uuid.uuid4().hex}"
    jobs.run_to_end(jobs.merging(jobs.stream_of(spark, folder, name, like, one_by_one), partial, out, name))
    parts = spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data")
    assert parts.select("batch").distinct().count() > 1
    return parts


@pytest.fixture(scope="module")
def log(w, tmp_path_factory):
    return in_files(w.access_log, tmp_path_factory.mktemp("log"), "log")


def test_daily_access_equals_the_whole_batch(spark, w, log, tmp_path):
    same(jobs.merged_access(streamed(spark, log, "log", jobs.daily_access, tmp_path)), jobs.daily_access(w.access_log))


def test_sessions_equal_the_whole_batch(spark, w, log, tmp_path):
    got = jobs.merged_sessions(streamed(spark, log, "log", jobs.actor_sessions, tmp_path))
    same(got, jobs.actor_sessions(w.access_log))


def test_sessions_that_touch(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 06:00:00", "2024-01-01 13:00:00", "2024-01-01 12:00:00"]
    log = spark.createDataFrame([(t, "a", "granted") for t in times], "at string, actor_subject string, outcome string").withColumn(
        "at", F.col("at").cast("timestamp"))
    parts = jobs.actor_sessions(log.filter("hour(at) in (0, 12)")).unionByName(jobs.actor_sessions(log.filter("hour(at) in (6, 13)")))
    same(jobs.merged_sessions(parts), jobs.actor_sessions(log))


def test_sessions_of_a_hot_actor_span_slices(spark):
    """One actor with a third of the rows, one without a name, partial sessions in nine random batches."""
    at = F.timestamp_seconds(F.lit(1700000000) + F.floor(F.rand(5) * 3000) * 7200)
    who = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("a"), F.col("id") % 50))
    rows = spark.range(4000).select("id", at.alias("at"), who.alias("actor_subject"), F.when(F.col("id") % 4 == 0, "refused").otherwise("granted").alias("outcome"))
    log = spark.createDataFrame(rows.drop("id").collect(), "at timestamp, actor_subject string, outcome string")
    parts = [jobs.actor_sessions(log.filter(F.pmod(F.xxhash64("at", "actor_subject", "outcome"), F.lit(9)) == k)) for k in range(9)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    same(jobs.merged_sessions(whole), jobs.actor_sessions(log))


def test_trailing_sums_equal_brute_force(spark, w, tmp_path):
    values = w.events.select(F.col("ts").alias("at"), F.floor("value").cast("double").alias("value"), F.col("user_id").cast("string").alias("pseudonym_id"))
    parts = streamed(spark, in_files(values, tmp_path, "values"), "values", jobs.day_sums, tmp_path)
    rows = values.toPandas()
    rows["day"] = rows["at"].dt.date
    got = {(r.pseudonym_id, r.day): (r.total, r.n) for r in jobs.trailing_sums(parts, 7).collect()}
    assert len(got) == len(rows.groupby(["pseudonym_id", "day"]))
    for (person, day), (total, n) in list(got.items())[::17]:
        back = rows[(rows.pseudonym_id == person) & (rows.day <= day) & (rows.day > day - pd.Timedelta(days=7))]
        assert (total, n) == (back["value"].sum(), len(back))


def test_first_claims_are_the_earliest_of_all_files(spark, w, tmp_path):
    requests = w.table("lineitem").select(F.col("l_partkey").cast("string").alias("slot_id"), F.col("l_shipdate").alias("requested_at"),
                                          F.concat_ws("-", "l_orderkey", "l_linenumber").alias("request_id"))
    folder, out = in_files(requests.unionByName(requests.limit(50)), tmp_path, "requests"), f"{tmp_path}/claims"
    before = spark.conf.get(jobs.STATE_STORE)
    query = jobs.updating(jobs.first_claims(jobs.stream_of(spark, folder, "requests", requests, 1)), out, "claims")
    jobs.run_to_end(query)
    assert spark.conf.get(jobs.STATE_STORE) == before
    parts = spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data")
    same(jobs.newest_claims(parts), jobs.first_claims(requests))
    slots = requests.select("slot_id").distinct().count()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == slots  # one row a slot, however many requests
    corrected = parts.groupBy("slot_id").agg(F.count_distinct("requested_at", "request_id").alias("n")).filter("n > 1")
    assert corrected.count() > 0  # earlier requests did arrive late


def test_keyed_baselines_equal_batch_fold(spark, w, tmp_path):
    emb = jobs.stream_of(spark, SMALL, "embeddings", w.table("embeddings"))
    samples = adapter.shape_samples(emb).filter(F.trim("consent_version") != "").withColumn(
        "pseudonym_id", pseudonym(F.col("personnel_id"), w.key))
    jobs.run_to_end(jobs.append(jobs.keyed_baselines(samples), f"{tmp_path}/t05", "t05"))
    got = jobs.newest_scores(spark.read.parquet(f"{tmp_path}/t05/data")).toPandas().set_index("sample_id").sort_index()
    want = acoustic.stress_signals(w.samples).toPandas().set_index("sample_id").sort_index()
    assert (got.is_reliable == want.is_reliable).all()
    assert np.allclose(got.voice_stress_signal.astype(float), want.voice_stress_signal.astype(float), equal_nan=True)


def shuffled_checkins(spark, tmp_path, rows):
    """Check-ins of two people, one with most of them, dealt over five files without regard to their dates."""
    rng = np.random.default_rng(11)
    days = [(("hot" if i % 6 else "b"), f"s{i:04d}", pd.Timestamp("2026-01-01") + pd.Timedelta(days=i // 3)) for i in range(rows)]
    pdf = pd.DataFrame([(p, s, d.date(), *rng.normal(5, 1, 7)) for p, s, d in days], columns=["pseudonym_id", "sample_id", "sample_date", *acoustic.FEATURES])
    df = spark.createDataFrame(pdf)
    return df, in_files(df, tmp_path, "checkins")


def test_baselines_follow_dates_across_shuffled_files(spark, tmp_path):
    df, folder = shuffled_checkins(spark, tmp_path, 240)
    stream = jobs.stream_of(spark, folder, "checkins", df, 1)
    jobs.run_to_end(jobs.append(jobs.keyed_baselines(stream), f"{tmp_path}/out", "shuffled"))
    parts = spark.read.parquet(f"{tmp_path}/out/data")
    assert parts.agg(F.max("revision")).first()[0] == 5 and parts.filter("late").isEmpty()
    got = jobs.newest_scores(parts).toPandas().set_index("sample_id").sort_index()
    want = acoustic.stress_signals(df).toPandas().set_index("sample_id").sort_index()
    assert len(got) == 240 and (got.is_reliable == want.is_reliable).all()
    assert np.allclose(got.voice_stress_signal.astype(float), want.voice_stress_signal.astype(float), equal_nan=True)


def test_settled_time_keeps_the_state_small_and_late_rows_marked(spark, tmp_path):
    df, folder = shuffled_checkins(spark, tmp_path, 120)
    stream = jobs.stream_of(spark, folder, "checkins", df, 1)
    jobs.run_to_end(jobs.append(jobs.keyed_baselines(stream, keep_days=10), f"{tmp_path}/out", "settled"))
    parts = spark.read.parquet(f"{tmp_path}/out/data")
    late, kept = parts.filter("late").count(), jobs.newest_scores(parts).count()
    assert late > 0 and late + kept == 120  # nothing is lost


def test_checkins_judged_once_and_replay_is_idempotent(spark, w, tmp_path):
    src, out, q = f"{tmp_path}/in", f"{tmp_path}/out", library.questions(spark)
    sent = w.checkins.select("pseudonym_id", F.col("submitted_at").cast("string").alias("submitted_at"), "answers")
    doubled = sent.withColumn("answers", F.array_append("answers", F.col("answers")[0])).withColumn("pseudonym_id", F.lit("twice"))
    for part in (sent, sent.limit(20), doubled):  # delivered again in another file
        part.write.mode("append").json(src)
    jobs.run_to_end(jobs.ingest_checkins(jobs.checkin_stream(spark, src), q, out))
    rows = lambda: jobs.judged(spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data"))
    once = sent.distinct().count()
    assert rows().filter("problem is null").count() == once
    assert rows().filter("problem = 'answered twice'").count() == doubled.distinct().count()
    jobs.run_to_end(jobs.ingest_checkins(jobs.checkin_stream(spark, src), q, out))
    assert rows().filter("problem is null").count() == once


def test_marking_an_older_version_rolls_back(spark, rows, tmp_path):
    model, _ = models.fit(rows, models.linear())
    one, two = (models.save(model, str(tmp_path), {"label_provenance": "index"}) for _ in range(2))
    assert models.current_version(str(tmp_path)) == two
    models.mark(str(tmp_path), one)
    assert models.current_version(str(tmp_path)) == one
    with pytest.raises(FileNotFoundError):
        models.mark(str(tmp_path), "v0")


def test_training_selects_calibrates_and_scores(spark, rows):
    run = models.train(rows, [models.linear(), models.boosting(rounds=5)])
    assert run.selected == "linear_regression" and run.measured.count() == 2
    scored = scoring.with_interval(models.scorer(run.model)(rows), run.calibration, scoring.SCORE)
    assert scored.filter("welfare_risk_score < interval_low or welfare_risk_score > interval_high").count() == 0


def test_candidates_are_fitted_when_asked_for_and_once(spark, rows):
    run = models.Comparison(rows, [models.linear(), models.boosting(rounds=2)])
    assert run.measured(["linear_regression"]).count() == 1 and set(run.made) == {"linear_regression"}
    line = run.fitted("linear_regression")
    whole = models.train_compared(run)
    assert whole.measured.count() == 2 and whole.fitted["linear_regression"] is line


def test_walk_through_exported_nodes_meets_the_forest(spark, rows):
    from fettle.plans.queries_models import leaf_gap

    assert leaf_gap(models.fit(rows, models.forest(trees=7))[0], rows) < 1e-9


def test_wide_service_numbers_are_identities(spark):
    from fettle.operators.privacy import namespace
    got = spark.createDataFrame([("P00001",), ("P123456",), ("P12",), ("PSN0123456789abcdef",)], "s string").select(namespace(F.col("s"))).collect()
    assert [r[0] for r in got] == ["service_identity", "service_identity", "unknown", "pseudonym"]


def test_sentences_round_ties_to_even(spark):
    from fettle.operators.analytics import with_proximity
    rows = spark.createDataFrame([(65.25,), (37.75,)], "welfare_risk_score double")
    notes = [r["proximity_note"] for r in with_proximity(rows).collect()]
    assert "0.2 points above" in notes[0] and "2.2 points below" in notes[1]
