"""The streaming jobs run to the end of the given tables; their merged results equal the whole batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.plans.catalog import query
from fettle.plans.oracle_views import hmac
from fettle.plans.queries_data import scratch
from fettle.plans.queries_results import b_requests
from fettle.plans.workload import Workload
from fettle.sources import adapter
from fettle.streaming import jobs


class Streamed(Workload):
    """The same derivations with one driver table read as a stream."""

    def __init__(self, w: Workload, streamed: str):
        super().__init__(w.spark, w.folder, w.key)
        self.streamed, self.whole = streamed, w

    def table(self, name: str) -> DataFrame:
        if name != self.streamed:
            return super().table(name)
        return jobs.stream_of(self.spark, self.folder, name, self.whole.table(name))


def event_stream(w: Workload) -> Streamed:
    s = Streamed(w, "events")
    s.__dict__["events"] = adapter.shape_events(s.table("events"))
    return s


def value_stream(w: Workload) -> DataFrame:
    from fettle.functions.keyed_hash import pseudonym
    return event_stream(w).events.select(
        F.col("ts").alias("at"), "value", pseudonym(adapter.person_key(F.col("user_id")), w.key).alias("pseudonym_id"))


def _merged(w: Workload, stream: DataFrame, partial, name: str) -> DataFrame:
    out = scratch(w, name)
    jobs.run_to_end(jobs.merging(stream, partial, out, name))
    return w.spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data")


def arrivals(w: Workload) -> DataFrame:
    """Check-ins as they might arrive: some repeated, empty, with an answer too many or to an unknown question."""
    n, answers = F.col("submission_id"), F.col("answers")
    unknown = F.struct(F.lit("ZZZ99").alias("question_id"), F.lit(1).alias("value"), F.lit(None).cast("string").alias("text"))
    sent = w.checkins.withColumn("answers", F.when(n % 11 == 0, F.slice(answers, 1, 0)).when(
        n % 7 == 0, F.array_append(answers, unknown)).when(n % 5 == 0, F.array_append(answers, answers[0])).when(
        n % 17 == 0, F.flatten(F.array_repeat(answers, 7))).otherwise(answers))
    copies = F.explode(F.sequence(F.lit(1), F.when(n % 13 == 0, 2).otherwise(1)))
    return sent.withColumn("copy", copies).select(
        "pseudonym_id", F.concat_ws(" ", F.col("submitted_at").cast("string"), n).alias("submitted_at"), "answers")


@query("checkins_validated_on_arrival_t01", "pseudonym_id problem n#", """
SELECT pseudonym_id, problem, count(*) AS n FROM (
  SELECT DISTINCT pseudonym_id, submission_id, CASE WHEN submission_id % 11 = 0 THEN 'no answers'
    WHEN submission_id % 7 = 0 THEN 'bad answer' WHEN submission_id % 5 = 0 THEN 'answered twice'
    WHEN submission_id % 17 = 0 THEN 'too many answers' ELSE 'none' END AS problem FROM v_checkins)
GROUP BY pseudonym_id, problem""")
def t01(w):
    folder, out = scratch(w, "arrivals"), scratch(w, "judged")
    arrivals(w).write.json(folder)
    jobs.run_to_end(jobs.ingest_checkins(jobs.checkin_stream(w.spark, folder), w.questions, out))
    rows = jobs.judged(w.spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data"))
    return rows.groupBy("pseudonym_id", F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("daily_access_stream_t02", "day pseudonym_id actor_role granted# refused#", """
SELECT CAST("at" AS DATE) AS day, pseudonym_id, actor_role, count(*) FILTER (outcome = 'granted') AS granted,
       count(*) FILTER (outcome = 'refused') AS refused FROM v_access GROUP BY ALL""")
def t02(w):
    return jobs.merged_access(_merged(w, event_stream(w).access_log, jobs.daily_access, "daily_access"))


@query("trailing_sums_stream_t03", "pseudonym_id day days# total* n#", " UNION ALL ".join(f"""
SELECT pseudonym_id, day, {days} AS days, sum(total) OVER back AS total, sum(n) OVER back AS n
FROM (SELECT {hmac('personnel_id')} AS pseudonym_id, CAST(ts AS DATE) AS day, sum(value) AS total, count(*) AS n
      FROM v_ev GROUP BY ALL)
WINDOW back AS (PARTITION BY pseudonym_id ORDER BY day RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND CURRENT ROW)"""
                                                                       for days in P.WINDOW_DAYS))
def t03(w):
    parts = _merged(w, value_stream(w), jobs.day_sums, "day_sums")
    return reduce(DataFrame.unionByName, [jobs.trailing_sums(parts, days) for days in P.WINDOW_DAYS])


@query("first_claims_stream_t04", "slot_id requested_at request_id", """
SELECT slot_id, min(requested_at) AS requested_at, arg_min(request_id, (requested_at, request_id)) AS request_id
FROM v_breq GROUP BY slot_id""")
def t04(w):
    claims = b_requests(Streamed(w, "lineitem")).select("slot_id", "requested_at", "request_id")
    out = scratch(w, "claims")
    jobs.run_to_end(jobs.updating(jobs.first_claims(claims), out, "claims"))
    return jobs.newest_claims(w.spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data"))


@query("keyed_baselines_stream_t05", "pseudonym_id sample_id is_reliable voice_stress_signal*", "SELECT * FROM v_stress")
def t05(w):
    from fettle.functions.keyed_hash import pseudonym
    emb = Streamed(w, "embeddings").table("embeddings")
    samples = adapter.shape_samples(emb).filter(F.trim("consent_version") != "").withColumn(
        "pseudonym_id", pseudonym(F.col("personnel_id"), w.key))
    out = scratch(w, "baselines")
    jobs.run_to_end(jobs.append(jobs.keyed_baselines(samples), out, "baselines"))
    return jobs.newest_scores(w.spark.read.parquet(f"{out}/data"))


@query("actor_sessions_stream_t06", "session_start session_end actor_subject accesses# refused#", """
SELECT min("at") AS session_start, max("at") + INTERVAL 6 HOUR AS session_end, actor_subject, count(*) AS accesses,
       count(*) FILTER (outcome = 'refused') AS refused
FROM (SELECT *, sum(opens) OVER (PARTITION BY actor_subject ORDER BY "at", id) AS s FROM (
        SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY actor_subject ORDER BY "at", id) <= INTERVAL 6 HOUR
                       THEN 0 ELSE 1 END AS opens FROM v_access))
GROUP BY actor_subject, s""")
def t06(w):
    return jobs.merged_sessions(_merged(w, event_stream(w).access_log, jobs.actor_sessions, "sessions"))
