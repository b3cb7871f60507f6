"""Structured Streaming jobs over the append-only logs, each with a batch twin.

Counts, sums, minima and sessions can be merged, so a micro-batch is reduced to partial
rows and written under its batch number (``merging``); reading merges them. Late and
repeated batches cost nothing, no row is ever dropped as too late, no state grows, and the
result is that of the whole log at any time. First claims (T04) and what depends on order
(T05) keep keyed state and send corrections.

Sinks are parquet folders with a checkpoint beside them in a shared place, so a
restarted job continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fettle import policy as P
from fettle.operators.acoustic import FEATURES, ema_step
from fettle.operators.analytics import answer_problem
from fettle.operators.spread import running_totals
from fettle.sources.ingest import CHECKIN_SCHEMA

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, folder: str, name: str, like: DataFrame, batch_bytes: int = 256 << 20) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream with a known schema.

    ``batch_bytes`` bounds what one micro-batch reads (one file at least).
    """
    # a pattern that matches this name alone: as a plain path a stream would insist on a folder
    return (
        spark.readStream.schema(like.schema).option("maxBytesPerTrigger", str(batch_bytes))
        .parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet"))


def append(stream: DataFrame, out: str, name: str) -> StreamingQuery:
    """Append to parquet until the input is used up."""
    return (
        stream.writeStream.queryName(name).format("parquet").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start())


def merging(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], out: str, name: str) -> StreamingQuery:
    """Partial rows of every micro-batch under its number; a replayed batch overwrites itself."""
    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    return (stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True).start())


def updating(totals: DataFrame, out: str, name: str) -> StreamingQuery:
    """Rows of a stateful aggregate that a micro-batch changed, under its number; the newest row of a key holds.

    The state is one row per key, on disk (RocksDB), and rows are aggregated before they
    reach it, so a hot key costs each task one row.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    conf, before = totals.sparkSession.conf, totals.sparkSession.conf.get(STATE_STORE)
    conf.set(STATE_STORE, ROCKSDB)
    try:  # a query keeps the settings it was started with
        return (totals.writeStream.queryName(name).outputMode("update").foreachBatch(write)
                .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    finally:
        conf.set(STATE_STORE, before)


def run_to_end(query: StreamingQuery) -> None:
    """Wait until the input is used up, however long that takes."""
    query.awaitTermination()


# --- T01: check-ins validated as they arrive ------------------------------------

def checkin_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CHECKIN_SCHEMA).option("mode", "DROPMALFORMED").json(folder)


def judge_checkins(checkins: DataFrame, questions: DataFrame) -> DataFrame:
    """Every submission once, with its verdict, judged inside its row.

    A submission delivered twice (same person, time and answers) counts once.
    """
    bank = questions.agg(F.map_from_entries(F.collect_list(F.struct("question_id", "kind"))).alias("_kinds"))
    rows = checkins.dropDuplicates(["pseudonym_id", "submitted_at", "answers"]).crossJoin(F.broadcast(bank))
    answers = F.transform("answers", lambda a: F.struct(
        F.trim(F.coalesce(a["question_id"], F.lit(""))).alias("question_id"), a["value"].cast("string").alias("value"), a["text"].alias("text")))
    rows = rows.withColumn("_answers", F.coalesce(answers, F.array().cast(
        "array<struct<question_id:string,value:string,text:string>>")))
    bad = F.exists("_answers", lambda a: answer_problem(
        F.col("_kinds")[a["question_id"]], a["question_id"], a["value"], a["text"]).isNotNull())
    names = F.transform("_answers", lambda a: a["question_id"])
    problem = (
        F.when(F.size("_answers") == 0, "no answers").when(F.size("_answers") > P.MAX_ANSWERS, "too many answers")
        .when(bad, "bad answer").when(F.size(F.array_distinct(names)) < F.size(names), "answered twice"))
    return rows.withColumn("problem", problem).drop("_kinds", "_answers")


def ingest_checkins(stream: DataFrame, questions: DataFrame, out: str) -> StreamingQuery:
    return merging(stream, lambda batch: judge_checkins(batch, questions), out, "checkins")


def judged(parts: DataFrame) -> DataFrame:
    """A submission that came in several batches counts once."""
    return parts.drop("batch").dropDuplicates(["pseudonym_id", "submitted_at", "answers"])


# --- T02: access counts per person, role and day --------------------------------

def daily_access(log: DataFrame) -> DataFrame:
    """Batch form, and the partial rows of a micro-batch."""
    return log.groupBy(F.to_date("at").alias("day"), "pseudonym_id", "actor_role").agg(
        F.count_if(F.col("outcome") == "granted").alias("granted"),
        F.count_if(F.col("outcome") == "refused").alias("refused"))


def merged_access(parts: DataFrame) -> DataFrame:
    return parts.groupBy("day", "pseudonym_id", "actor_role").agg(
        F.sum("granted").alias("granted"), F.sum("refused").alias("refused"))


# --- T03: trailing sums -----------------------------------------------------------

def day_sums(values: DataFrame) -> DataFrame:
    """Sum and count per person and day: the partial rows of a micro-batch."""
    return values.groupBy("pseudonym_id", F.to_date("at").alias("day")).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def trailing_sums(parts: DataFrame, days: int) -> DataFrame:
    """Sum of the ``days`` days up to each day with an event, from day rows (one per person and day at most)."""
    daily = parts.groupBy("pseudonym_id", "day").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    back = Window.partitionBy("pseudonym_id").orderBy(number).rangeBetween(1 - days, 0)
    return daily.select("pseudonym_id", "day", F.lit(days).alias("days"), F.sum("total").over(back).alias("total"),
                        F.sum("n").over(back).alias("n"))


# --- T04: first claim per slot --------------------------------------------------

def first_claims(requests: DataFrame) -> DataFrame:
    """Earliest request per slot, ties to the smallest id: the batch form, and as a stream the state per slot."""
    first = F.min(F.struct("requested_at", "request_id")).alias("first")
    return requests.groupBy("slot_id").agg(first).select("slot_id", "first.requested_at", "first.request_id")


def newest_claims(parts: DataFrame) -> DataFrame:
    """The winner as the last micro-batch that touched a slot knew it: an earlier request that came late corrects it."""
    value = F.struct("requested_at", "request_id")
    return parts.groupBy("slot_id").agg(F.max_by(value, "batch").alias("v")).select("slot_id", "v.*")


# --- T05: acoustic baselines as keyed state -------------------------------------

SIGNAL_DDL = ("pseudonym_id string, sample_id string, sample_date date, voice_stress_signal double, "
              "is_reliable boolean, available_weight double, revision int, late boolean")
STATE_DDL = ("seen int, first array<double>, centre array<double>, scale array<double>, upto string, tail array<string>, "
             "measured array<double>, revision int")
_WEIGHTS = np.array([P.ACOUSTIC_WEIGHTS[f] for f in FEATURES])
_WAYS = np.array([P.ACOUSTIC_DIRECTIONS[f] for f in FEATURES], dtype=float)


def start_baseline(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and IQR scale per feature of the first check-ins (rows x features)."""
    centre, scale = np.full(values.shape[1], np.nan), np.full(values.shape[1], np.nan)
    for i in range(values.shape[1]):
        x = values[:, i][np.isfinite(values[:, i])]
        if len(x):
            centre[i] = np.median(x)
        if len(x) >= 2:
            iqr = np.percentile(x, 75) - np.percentile(x, 25)
            scale[i] = max(iqr / P.IQR_TO_SD, abs(centre[i]) * P.SCALE_FLOOR_FRACTION)
    return centre, scale


def score_checkin(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> tuple[float, float]:
    usable = np.isfinite(x) & np.isfinite(centre) & np.isfinite(scale) & (scale > 0)
    available = float(_WEIGHTS[usable].sum())
    if available < P.ACOUSTIC_MIN_WEIGHT - 1e-12:
        return np.nan, available
    z = _WAYS[usable] * (x[usable] - centre[usable]) / scale[usable]
    share = np.minimum(1.0, np.maximum(0.0, z) / P.ACOUSTIC_SATURATION_SD)
    return float(100.0 * (_WEIGHTS[usable] * share).sum() / available), available


def fold_checkin(state: tuple, x: np.ndarray) -> tuple[tuple, float, float]:
    """Score one check-in against (seen, first values, centre, scale), then fold it in: new state, signal (NaN if unreliable), weight."""
    seen, first, centre, scale = state
    signal, available = score_checkin(x, centre, scale) if seen >= P.ACOUSTIC_MIN_SAMPLES else (np.nan, 0.0)
    seen += 1
    if seen <= P.ACOUSTIC_MIN_SAMPLES:
        first = np.append(first, x)
        centre, scale = start_baseline(first.reshape(-1, len(FEATURES)))
    else:
        centre, scale = centre.copy(), scale.copy()
        for i in np.flatnonzero(np.isfinite(x)):
            centre[i], scale[i] = ema_step(centre[i], scale[i], x[i])
    return (seen, first, centre, scale), signal, available


def _updater(keep_days: int | None):
    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Put new check-ins into their place by date and fold again from the first one that changed."""
        if state.exists:
            seen, first, centre, scale, upto, tail, measured, revision = state.get
        else:
            seen, first, centre, scale, upto, tail, measured, revision = 0, [], [np.nan] * 7, [np.nan] * 7, "", [], [], 0
        prefix = (seen, np.array(first, float), np.array(centre, float), np.array(scale, float))
        values = dict(zip(tail, np.array(measured, float).reshape(-1, len(FEATURES))))
        new, late, revision = [], [], revision + 1
        for rows in chunks:
            for row in rows.itertuples(index=False):
                at = f"{row.sample_date}|{row.sample_id}"
                if at <= upto:
                    late.append(at)
                elif at not in values:
                    values[at] = np.array([getattr(row, f) for f in FEATURES], dtype=float)
                    new.append(at)
        out, order, changed = [], sorted(values), min(new, default=None)
        newest = order[-1].split("|")[0] if order else ""
        last = "" if keep_days is None or not order else str((pd.Timestamp(newest) - pd.Timedelta(days=keep_days)).date())
        folded = prefix
        for at in order:
            folded, signal, available = fold_checkin(folded, values[at])
            day, sample = at.split("|", 1)
            if changed is not None and at >= changed:
                reliable = not np.isnan(signal)
                out.append((key[0], sample, pd.Timestamp(day).date(), signal if reliable else None, reliable, available, revision, False))
            if day < last:  # old enough to be settled: kept only as folded
                prefix, upto = folded, at
                del values[at]
        out += [(key[0], at.split("|", 1)[1], pd.Timestamp(at.split("|")[0]).date(), None, False, 0.0, revision, True) for at in late]
        tail = sorted(values)
        state.update((prefix[0], prefix[1].tolist(), prefix[2].tolist(), prefix[3].tolist(), upto, tail,
                      np.concatenate([values[at] for at in tail]).tolist() if tail else [], revision))
        yield pd.DataFrame(out, columns=["pseudonym_id", "sample_id", "sample_date", "voice_stress_signal", "is_reliable",
                                         "available_weight", "revision", "late"])

    return update


def keyed_baselines(samples: DataFrame, keep_days: int | None = None) -> DataFrame:
    """Scores of a stream of (pseudonym_id, sample_id, sample_date, seven features), in date order whatever the order of arrival.

    The state holds the folded baseline up to a date and the check-ins after it. A check-in that arrives out of order
    goes to its place and the scores from there on are sent again with a higher ``revision``. Check-ins more than
    ``keep_days`` before a person's newest one are folded for good (never by default); what arrives for that time is
    sent on marked ``late``, without a score. A check-in delivered twice counts once.
    """
    return samples.select("pseudonym_id", "sample_id", "sample_date", *FEATURES).groupBy("pseudonym_id") \
        .applyInPandasWithState(_updater(keep_days), SIGNAL_DDL, STATE_DDL, "append", GroupStateTimeout.NoTimeout)


def newest_scores(parts: DataFrame) -> DataFrame:
    """The last revision of every check-in; late ones are left out."""
    value = F.struct("sample_date", "voice_stress_signal", "is_reliable", "available_weight")
    return parts.filter(~F.col("late")).groupBy("pseudonym_id", "sample_id").agg(F.max_by(value, "revision").alias("v")).select(
        "pseudonym_id", "sample_id", "v.*")


# --- T06: sessions of one actor -------------------------------------------------

def actor_sessions(log: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of a batch; of the whole log in the batch form, partial ones of a micro-batch."""
    return (
        log.groupBy(F.session_window("at", gap), "actor_subject")
        .agg(F.count(F.lit(1)).alias("accesses"), F.count_if(F.col("outcome") == "refused").alias("refused"))
        .select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"),
                "actor_subject", "accesses", "refused"))


def merged_sessions(parts: DataFrame) -> DataFrame:
    """Partial sessions that overlap or touch are one (their ends already hold the gap).

    A sweep over opening and ending marks: where as many have ended as have opened, a
    session is over. Both sums run over slices, so the history of one actor spans many tasks.
    """
    who = F.struct("actor_subject").alias("who")  # a missing actor is an actor, too
    opened = parts.select(who, F.col("session_start").alias("at"), F.lit(0).alias("ends"), F.lit(1).alias("open"), "accesses", "refused")
    ended = parts.select(who, F.col("session_end").alias("at"), F.lit(1).alias("ends"), F.lit(-1).alias("open"),
                         F.lit(0).alias("accesses"), F.lit(0).alias("refused"))
    order = ["at", "ends"]
    marks = opened.unionByName(ended).groupBy("who", *order).agg(
        F.sum("open").alias("open"), F.sum("accesses").alias("accesses"), F.sum("refused").alias("refused"))
    depth = running_totals(marks, ["who"], order, "open", "depth").withColumn("over", (F.col("depth") == 0).cast("long"))
    numbered = running_totals(depth, ["who"], order, "over", "upto")
    return numbered.groupBy("who", (F.col("upto") - F.col("over")).alias("number")).agg(
        F.min("at").alias("session_start"), F.max("at").alias("session_end"),
        F.sum("accesses").alias("accesses"), F.sum("refused").alias("refused")).select(
        "who.actor_subject", "session_start", "session_end", "accesses", "refused")
