"""The whole chain over one data folder, each stage a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions.keyed_hash import pseudonym
from fettle.functions.scales import code
from fettle.operators import (
    acoustic, alerts, analytics, cleaning, explain, features, models, privacy, recommend, results, scoring, signals,
    spread, tree_shapley, units,
)
from fettle.sources import adapter, ingest, library
from fettle.sources.tables import read_table

#: for checks and tests alone; a run names its own key
DEVELOPMENT_KEY = b"fettle-development-key"


# fixed values: the tables a run starts from
RAW_TABLES = ("unit_capacity", "personnel", "leave_records", "deployment_history", "duty_logs", "transfer_records", "training_records")


class Workload:
    """Stages are built once per instance and stay lazy until a result is used.

    With ``settled`` the stages that feed many results (roster, feature matrix,
    scored rows, unit statistics, calibration, Shapley values) are written once to the shared
    folder; recomputing them for every result would rescan the events each time.

    ``scorer`` maps the signal rows to rows with a score, such as a fitted model
    (``models.scorer``); without it the closed-form index scores.
    """

    def __init__(self, spark: SparkSession, folder: str, key: bytes, settled: bool = False,
                 scorer: Callable[[DataFrame], DataFrame] | None = None):
        if not key:
            raise ValueError("a pseudonym key is required")
        self.spark, self.folder, self.key = spark, folder, key
        self.settled, self.scorer = settled, scorer
        self.model = None  # the fitted pipeline behind ``scorer``, if it is one
        self.snapshots = P.snapshots()

    @classmethod
    def loaded(cls, spark: SparkSession, folder: str, key: bytes, settled: bool = True, strict: bool = True) -> "Workload":
        """A run over the CSV tables of a folder; with ``strict``, tables that fail validation stop it before anything is derived."""
        run = cls(spark, folder, key, settled)
        run.__dict__["raw"], run.reports = ingest.load_tables(spark, folder, RAW_TABLES, strict)
        return run

    def _keep(self, df: DataFrame) -> DataFrame:
        return spread.settle(df) if self.settled else df

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def events(self) -> DataFrame:
        return adapter.events(self.spark, self.folder)

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        roster = self._keep(adapter.personnel(self.spark, self.folder))
        return adapter.raw_tables(self.events, roster)

    @cached_property
    def clean(self) -> dict[str, DataFrame]:
        return cleaning.clean_all(self.raw, self._keep(cleaning.clean_roster(self.raw["personnel"])))

    @cached_property
    def private(self) -> dict[str, DataFrame]:
        return privacy.pseudonymise_all(self.clean, self.key)

    @cached_property
    def matrix(self) -> DataFrame:
        """Features, signals and score side by side: the one wide table the rest reads."""
        wide = privacy.assert_absent(features.feature_matrix(self.private, self.snapshots))
        for name, (build, _) in signals.REGISTRY.items():
            wide = wide.withColumn(name, build())
        return self._keep(wide.withColumn(scoring.SCORE, scoring.signal_index()))

    @cached_property
    def features(self) -> DataFrame:
        return self.matrix.drop(*P.SIGNALS, scoring.SCORE)

    @cached_property
    def samples(self) -> DataFrame:
        """Check-ins with consent and of sufficient length."""
        usable = ingest.usable_samples(adapter.acoustic_samples(self.spark, self.folder), rate=adapter.WAVEFORM_RATE)
        return usable.withColumn("pseudonym_id", pseudonym(F.col("personnel_id"), self.key)).drop("personnel_id")

    @cached_property
    def voice(self) -> DataFrame:
        return self._keep(acoustic.align_to_snapshots(acoustic.stress_signals(self.samples), self.snapshots))

    @cached_property
    def behaviour(self) -> DataFrame:
        """Nine signals and the voice pair: neutral 0 for those who did not check in."""
        return signals.with_voice(self.matrix.select(*features.KEYS, *signals.CARRIED, *P.SIGNALS), self.voice)

    @cached_property
    def labels(self) -> DataFrame:
        return scoring.labels(self.features, self.private["personnel"])

    @cached_property
    def roster_keys(self) -> DataFrame:
        return self.clean["personnel"].select(
            "personnel_id", pseudonym(F.col("personnel_id"), self.key).alias("pseudonym_id"))

    @cached_property
    def scored(self) -> DataFrame:
        out = signals.with_voice(
            self.matrix.select(*features.KEYS, *signals.CARRIED, *P.SIGNALS, scoring.SCORE), self.voice)
        if self.scorer is not None:
            out = self.scorer(out.drop(scoring.SCORE))
        return self._keep(analytics.with_level(analytics.with_confidence(out)))

    @cached_property
    def modelling(self) -> DataFrame:
        """Score, label and the person-disjoint split per (person, snapshot)."""
        rows = scoring.modelling_set(self.scored, self.labels)
        return scoring.with_split(rows.join(self.roster_keys, "pseudonym_id"), "personnel_id")

    @cached_property
    def training(self) -> models.Training:
        """Every candidate fitted once at full size, the selected one deployed."""
        return models.train_compared(self.comparison)

    @cached_property
    def comparison(self) -> models.Comparison:
        """The candidates of the training run, each fitted when first asked for."""
        return models.Comparison(spread.settle(self.modelling.drop("risk_level", "confidence_level")))

    @cached_property
    def deployed(self) -> "Workload":
        """The same run scored, calibrated and explained by the selected model."""
        run = Workload(self.spark, self.folder, self.key, self.settled, models.scorer(self.training.model))
        for stage in ("raw", "clean", "private", "matrix", "voice"):
            run.__dict__[stage] = getattr(self, stage)
        run.__dict__["calibration"] = self.training.calibration
        run.model = self.training.model
        return run

    @cached_property
    def calibration(self) -> DataFrame:
        rows = self.modelling.filter(F.col("split") == "calibration")
        return self._keep(scoring.calibrate(rows, "label", scoring.SCORE, "pseudonym_id"))

    @cached_property
    def unit_stats(self) -> DataFrame:
        return self._keep(analytics.unit_aggregates(self.scored))

    @cached_property
    def classified(self) -> DataFrame:
        """Scored rows with attribution, interval, certainty and cutoff proximity."""
        out = analytics.with_attribution(self.scored, self.unit_stats)
        out = scoring.with_interval(out, self.calibration)
        return analytics.with_proximity(analytics.with_certainty(out))

    @cached_property
    def trends(self) -> DataFrame:
        return analytics.trends(self.scored)

    @cached_property
    def conditions(self) -> DataFrame:
        return units.evaluate_conditions(self.behaviour, self.raw["unit_capacity"])

    @cached_property
    def findings(self) -> DataFrame:
        return units.detect(self.conditions)

    @cached_property
    def pressure(self) -> DataFrame:
        return units.published_pressure(units.pressure(self.conditions))

    @cached_property
    def cases(self) -> DataFrame:
        return self._keep(
            results.assemble_cases(analytics.latest_rows(self.classified), self.trends, self.findings))

    @cached_property
    def latest_signals(self) -> DataFrame:
        return analytics.latest_rows(self.scored)

    @cached_property
    def shapley(self) -> DataFrame:
        """Exact values: over the nine signals of the index, or over all eleven inputs of a fitted scorer.

        A fitted pipeline is explained leaf by leaf (before the score is clipped), any other scorer by coalitions.
        """
        if self.scorer is None:
            return self._keep(explain.shapley(self.latest_signals, explain.background(self.behaviour)))
        reference = explain.background(self.behaviour, inputs=P.MODEL_INPUTS)
        if self.model is not None:
            return self._keep(tree_shapley.model_shapley(self.latest_signals, reference, self.model))
        return self._keep(explain.shapley_by_model(
            self.latest_signals.drop(scoring.SCORE), reference, self.scorer, scoring.SCORE))

    @cached_property
    def factors(self) -> DataFrame:
        return explain.top_factors(explain.contributions(self.shapley, self.latest_signals))

    @cached_property
    def medians(self) -> DataFrame:
        return explain.population_medians(self.latest_signals)

    @cached_property
    def questions(self) -> DataFrame:
        return library.questions(self.spark)

    @cached_property
    def interventions(self) -> DataFrame:
        return library.interventions(self.spark)

    @cached_property
    def recommendations(self) -> DataFrame:
        named = self.factors.groupBy("pseudonym_id").agg(
            F.collect_list("signal_name").alias("_factors"))  # at most three per case
        rows = self.cases.join(named, "pseudonym_id", "left").withColumn(
            "top_signals", recommend.top_signals(F.col("_factors")))
        return recommend.recommend(rows, self.interventions)

    @cached_property
    def alerts(self) -> DataFrame:
        return alerts.batch(self.cases, self.findings)

    @cached_property
    def checkins(self) -> DataFrame:
        """View events as submissions of three answers each."""
        ev = self.events.filter(F.col("event_type") == "view").join(
            self.roster_keys.withColumn("user_id", F.substring("personnel_id", 2, 12).cast("long")), "user_id")
        bank = F.array(*[F.lit(q[0]) for q in library.QUESTIONS])
        size = len(library.QUESTIONS)
        picks = [F.element_at(bank, (F.pmod(F.col("event_id") * m + s, F.lit(size)) + 1).cast("int"))
                 for m, s in ((1, 0), (1, 7), (1, 14))]
        answers = F.array(*[
            F.struct(q.alias("question_id"), ((F.col("k") + i) % 5).cast("int").alias("value"),
                     F.when(q.isin("GEN03", "LVE01"), F.lit("note")).alias("text"))
            for i, q in enumerate(picks)])
        return ev.select(
            "pseudonym_id", F.col("event_id").alias("submission_id"), F.col("ts").alias("submitted_at"),
            answers.alias("answers"))

    @cached_property
    def compared(self) -> DataFrame:
        return analytics.self_report(self.checkins, self.questions, self.latest_signals)

    @cached_property
    def access_log(self) -> DataFrame:
        """Every event as one access decision on the person's record."""
        role = F.when(F.col("event_type") == "click", P.ROLE_PERSONNEL).when(
            F.col("event_type") == "error", P.ROLE_COMMANDER).otherwise(P.ROLE_OFFICER)
        key = pseudonym(adapter.person_key(F.col("user_id")), self.key)
        return self.events.select(
            F.col("event_id").alias("id"), F.col("ts").alias("at"), role.alias("actor_role"),
            code("S", F.col("k"), 3).alias("actor_subject"), F.col("event_type").alias("action"),
            key.alias("pseudonym_id"), F.when(F.col("k") < 80, "granted").otherwise("refused").alias("outcome"))

    @cached_property
    def action_log(self) -> DataFrame:
        """Purchase and signup events as recorded welfare actions, some of them invalid."""
        ids = F.array(*[F.lit(i[0]) for i in library.INTERVENTIONS], F.lit("not_in_library"))
        status = F.array(*[F.lit(s) for s in (*P.ACTION_STATUSES, "unheard_of")])
        key = pseudonym(adapter.person_key(F.col("user_id")), self.key)
        return self.events.filter(F.col("event_type").isin("purchase", "signup")).select(
            F.col("event_id").alias("id"), F.col("ts").alias("at"), key.alias("pseudonym_id"),
            F.element_at(ids, (F.col("k") % 11 + 1).cast("int")).alias("intervention_id"),
            F.element_at(status, (F.col("event_id") % 5 + 1).cast("int")).alias("status"),
            F.lit(P.ROLE_OFFICER).alias("actor_role"),
            F.repeat(F.lit("x"), (F.col("value") * 5).cast("int")).alias("note"))

    @cached_property
    def actions(self) -> DataFrame:
        from fettle.operators import logs

        return logs.check_actions(self.action_log, self.interventions).filter(F.col("problem").isNull()).drop("problem")

    def results(self) -> dict[str, DataFrame]:
        """The seven result datasets."""
        medians = self.medians
        return {
            "cases": results.nested_cases(self.cases, self.factors, self.recommendations),
            "history": results.history(self.classified),
            "units": results.unit_payload(self.unit_stats, self.pressure, self.findings),
            "near_misses": self.findings,
            "explanations": self.shapley,
            "meta": results.run_metadata(self.classified, self.cases, medians),
            "alerts": self.alerts,
        }
