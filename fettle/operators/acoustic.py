"""Personal acoustic baselines: frames inside the row, folds over bounded chunks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions.scales import lookup
from fettle.operators import spread
from fettle.operators.features import with_snapshots

FEATURES = P.ACOUSTIC_FEATURES


# --- frames of one recording (array in, array out; no shuffle) ----------------

def centred(waveform: Column) -> Column:
    """The recording with its mean removed."""
    doubles = F.transform(waveform, lambda x: x.cast("double"))
    mean = F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x) / F.size(waveform)
    return F.transform(doubles, lambda x: x - mean)


def frame_rms(signal: Column, length: int, hop: int) -> Column:
    """RMS of each full frame; shorter than one frame gives an empty array."""
    count = F.floor((F.size(signal) - F.lit(length)) / F.lit(hop)).cast("int")
    starts = F.when(F.size(signal) >= length, F.sequence(F.lit(0), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.sqrt(F.aggregate(
        F.slice(signal, i * hop + 1, length), F.lit(0.0), lambda a, x: a + x * x) / F.lit(float(length))))


def active_mask(rms: Column, fraction: float = P.SILENCE_FRACTION) -> Column:
    """Frames louder than a fraction of the recording's own peak."""
    peak = F.array_max(rms)
    return F.transform(rms, lambda r: (peak > 0) & (r > peak * F.lit(fraction)))


def trimmed(waveform: Column, mask: Column, length: int, hop: int) -> Column:
    """Leading and trailing silence removed, inner pauses kept."""
    at = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    first, last = F.array_min(at), F.array_max(at)
    end = F.least(F.size(waveform), last * hop + length)
    return F.when(F.size(at) == 0, waveform).otherwise(F.slice(waveform, first * hop + 1, end - first * hop))


def with_frames(samples: DataFrame, length: int, hop: int, waveform: str = "waveform") -> DataFrame:
    return (
        samples.withColumn("_signal", centred(F.col(waveform)))
        .withColumn("rms", frame_rms(F.col("_signal"), length, hop))
        .withColumn("active", active_mask(F.col("rms"))).drop("_signal"))


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))


def intensity(frames: DataFrame) -> DataFrame:
    """Pause ratio and loudness statistics over the active frames."""
    pairs = F.arrays_zip("rms", "active")
    loud = F.transform(F.filter(pairs, lambda p: p["active"]), lambda p: p["rms"])
    out = frames.withColumn("_loud", loud).withColumn("intensity_rms_mean", _mean(F.col("_loud")))
    mean, n = F.col("intensity_rms_mean"), F.size("_loud")
    squares = F.aggregate("_loud", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    out = out.withColumn("intensity_rms_sd", F.when(n > 1, F.sqrt(F.try_divide(squares, (n - 1).cast("double"))))
                         .when(n == 1, F.lit(0.0)))
    return (
        out.withColumn("intensity_rms_cv", F.when(mean > 0, F.try_divide(F.col("intensity_rms_sd"), mean)))
        .withColumn("pause_ratio", F.lit(1.0) - F.try_divide(n.cast("double"), F.size("rms").cast("double")))
        .drop("_loud"))


def active_runs(mask: Column, shortest: int = P.MIN_VOICED_RUN) -> Column:
    """(start, end) of every run of active frames, end exclusive, short runs left out."""
    n = F.size(mask)
    before = lambda i: F.when(i > 0, F.get(mask, i - 1)).otherwise(F.lit(False))
    after = lambda i: F.when(i < n - 1, F.get(mask, i + 1)).otherwise(F.lit(False))
    starts = F.filter(F.transform(mask, lambda m, i: F.when(m & ~before(i), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(mask, lambda m, i: F.when(m & ~after(i), i + 1)), lambda i: i.isNotNull())
    zipped = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    return F.filter(zipped, lambda r: r["end"] - r["start"] >= shortest)


def smoothed(rms: Column) -> Column:
    """Three-frame moving mean, zero beyond the edges."""
    n = F.size(rms)
    left = lambda i: F.when(i > 0, F.get(rms, i - 1)).otherwise(F.lit(0.0))
    right = lambda i: F.when(i < n - 1, F.get(rms, i + 1)).otherwise(F.lit(0.0))
    return F.transform(rms, lambda x, i: (left(i) + x + right(i)) / F.lit(3.0))


def peaks_in(envelope: np.ndarray, distance: int, prominence: float) -> int:
    """Local maxima, thinned by distance (tallest first), then by prominence."""
    n = len(envelope)
    tops, i = [], 1
    while i < n - 1:
        if envelope[i - 1] < envelope[i]:
            j = i
            while j < n - 1 and envelope[j + 1] == envelope[i]:
                j += 1
            if j < n - 1 and envelope[j + 1] < envelope[i]:
                tops.append((i + j) // 2)
            i = j
        i += 1
    kept: list[int] = []
    for p in sorted(tops, key=lambda t: (envelope[t], t), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    count = 0
    for p in kept:
        higher = np.flatnonzero(envelope > envelope[p])
        lo = higher[higher < p].max() + 1 if (higher < p).any() else 0
        hi = higher[higher > p].min() if (higher > p).any() else n
        base = max(envelope[lo:p + 1].min(), envelope[p:hi].min())
        count += envelope[p] - base >= prominence
    return count


def speaking_rate(frames: DataFrame, duration: Column, distance: int | None = None) -> DataFrame:
    """Envelope peaks per second; NULL for under three frames or a flat envelope."""
    gap = distance or max(1, round(P.SYLLABLE_GAP_MS / P.HOP_MS))

    @F.pandas_udf("int")
    def count(envelopes: pd.Series) -> pd.Series:
        def one(e):
            if e is None or len(e) < 3:
                return None
            e = np.asarray(e, dtype=float)
            span = e.max() - e.min()
            return None if span <= 0 else peaks_in(e, gap, span * P.SYLLABLE_PROMINENCE)

        return envelopes.map(one)

    return frames.withColumn("syllables", count(smoothed(F.col("rms")))).withColumn(
        "speaking_rate", F.when(duration > 0, F.col("syllables") / duration))


# --- baselines over check-ins -------------------------------------------------

def floor_scale(scale: Column, centre: Column) -> Column:
    floor = F.abs(centre) * F.lit(P.SCALE_FLOOR_FRACTION)
    return F.when(scale.isNotNull() & centre.isNotNull(), F.greatest(scale, floor)).otherwise(scale)


def long_form(samples: DataFrame) -> DataFrame:
    """One row per (check-in, feature) with a measured value."""
    return samples.select("pseudonym_id", "sample_date", "sample_id", *FEATURES).unpivot(
        ["pseudonym_id", "sample_date", "sample_id"], list(FEATURES), "feature", "value"
    ).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def first_samples(samples: DataFrame, count: int = P.ACOUSTIC_MIN_SAMPLES) -> DataFrame:
    """The oldest check-ins per person; the limit is applied before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("pseudonym_id").orderBy("sample_date", "sample_id")
    return samples.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= count).drop("_r")


def _baseline(stats: DataFrame) -> DataFrame:
    spread_ = (F.col("q75") - F.col("q25")) / F.lit(P.IQR_TO_SD)
    scale = F.when(F.col("observations") >= 2, spread_)
    return stats.select("pseudonym_id", "feature", "centre", floor_scale(scale, F.col("centre")).alias("scale"),
                        "observations")


def early_baseline(samples: DataFrame) -> DataFrame:
    """Median centre and IQR scale of the first check-ins (at most three values per group)."""
    values = long_form(first_samples(samples))
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = values.groupBy("pseudonym_id", "feature").agg(q.alias("q"), F.count("value").alias("observations"))
    return _baseline(stats.select("pseudonym_id", "feature", F.col("q")[1].alias("centre"), F.col("q")[0].alias("q25"),
                                  F.col("q")[2].alias("q75"), "observations"))


def full_baseline(samples: DataFrame) -> DataFrame:
    """The same over all check-ins of everybody: exact quantiles without gathering a person."""
    values = long_form(samples)
    key = ["pseudonym_id", "feature"]
    q = spread.exact_quantiles(values, key, "value", {"q25": 0.25, "centre": 0.5, "q75": 0.75})
    n = values.groupBy(*key).agg(F.count("value").alias("observations"))
    return _baseline(q.join(n, key))


def ema_step(centre: float, scale: float, value: float) -> tuple[float, float]:
    """Fold one value into (centre, scale); NaN means not known yet."""
    floor = P.SCALE_FLOOR_FRACTION
    if np.isnan(centre):
        return value, abs(value) * floor
    deviation = abs(value - centre)
    moved = (1.0 - P.ACOUSTIC_ALPHA) * centre + P.ACOUSTIC_ALPHA * value
    mad = deviation if np.isnan(scale) else (
        (1.0 - P.ACOUSTIC_ALPHA) * (scale / P.MAD_TO_SD) + P.ACOUSTIC_ALPHA * deviation)
    return moved, max(mad * P.MAD_TO_SD, abs(moved) * floor)


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running composition of the maps x -> max(a x + b, c), a >= 0: each with all before it.

    Such maps are closed under composition, so the passes double what is composed.
    """
    a, b, c, step = a.copy(), b.copy(), c.copy(), 1
    while step < len(a):
        later, before = slice(step, None), slice(None, -step)
        b_new, c_new = a[later] * b[before] + b[later], np.maximum(a[later] * c[before] + b[later], c[later])
        a[later] = a[later] * a[before]
        b[later], c[later] = b_new, c_new
        step *= 2
    return a, b, c


#: below any value, yet finite, so that 0 times it is 0
_NONE = -np.finfo(float).max / 4
_MAPS = "a double, b double, c double"


def _carried(slices: DataFrame) -> DataFrame:
    """Per slice the state that enters it: one row a slice, composed in their order."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        _, b, c = scan(*(rows[k].to_numpy(float) for k in "abc"))
        out = np.maximum(b, c)  # the first row of all is a constant map
        return pd.DataFrame({"slice": rows["slice"].to_numpy(), "carry": np.concatenate(([0.0], out[:-1]))})

    return slices.groupBy().applyInPandas(run, "slice int, carry double")


def _scanned(rows: DataFrame) -> DataFrame:
    """Rows of ``slice`` and ``at`` with maps a, b, c: the composed map of each row within its slice and that of the row before.

    A slice is a range partition of bounded size; both composed maps still wait for what enters the slice.
    """
    keep = [f for f in rows.schema.fields if f.name not in ("a", "b", "c")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        a, b, c = scan(*(part[k].to_numpy(float) for k in "abc"))
        last = np.arange(len(part)) == len(part) - 1
        return part[[f.name for f in keep]].assign(
            a=a, b=b, c=c, prior_a=np.append(1.0, a[:-1]), prior_b=np.append(0.0, b[:-1]), prior_c=np.append(_NONE, c[:-1]), last=last)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), _MAPS, "prior_a double, prior_b double, prior_c double, last boolean"])
    done = spread.settle(rows.groupBy("slice").applyInPandas(run, schema))
    carry = _carried(done.filter("last").select("slice", "a", "b", "c"))
    out = lambda p: F.greatest(F.col(f"{p}a") * F.col("carry") + F.col(f"{p}b"), F.col(f"{p}c"))
    return done.join(F.broadcast(carry), "slice").select(  # one row a slice
        *[f.name for f in keep], out("").alias("now"), out("prior_").alias("prior"))


def ema_fold(samples: DataFrame) -> DataFrame:
    """Running baseline per (person, feature) after the first three check-ins.

    The fold is sequential, but every step is a map x -> max(a x + b, c) of the state: the
    centre's is affine, the scale's has its floor. Values are range-partitioned on person,
    feature and date, so one history spans many slices; each slice composes its maps, the
    composed maps of the slices are composed in turn, and what enters a slice is put into
    its maps. The first value of a history has a constant map, which cuts off what came
    before. Centres first; they give the deviations and floors of the scales.
    """
    key = ["pseudonym_id", "feature"]
    values = long_form(samples)
    early = first_samples(samples).select("sample_id", F.lit(True).alias("_early"))
    later = values.join(early, "sample_id", "left_anti")
    begins = later.groupBy(*key).agg(F.min(F.struct("sample_date", "sample_id")).alias("begin"))
    base = early_baseline(samples).select(*key, F.col("centre").alias("centre0"), F.col("scale").alias("scale0"))
    order = [*key, "sample_date", "sample_id"]
    starts = begins.join(base, key, "left")
    sliced = (later.join(starts, key).withColumn("first", F.struct("sample_date", "sample_id") == F.col("begin")).drop("begin")
              .repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("slice", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    alpha, keep = F.lit(P.ACOUSTIC_ALPHA), F.lit(1.0 - P.ACOUSTIC_ALPHA)
    # centre: a known start or the value itself, then keep * x + alpha * value
    start = F.coalesce(keep * F.col("centre0") + alpha * F.col("value"), F.col("value"))
    centres = _scanned(sliced.select("*", F.when(F.col("first"), 0.0).otherwise(keep).alias("a"),
                                     F.when(F.col("first"), start).otherwise(alpha * F.col("value")).alias("b"), F.lit(_NONE).alias("c")))
    centres = centres.select("*", F.when(F.col("first"), F.col("centre0")).otherwise(F.col("prior")).alias("prior_centre"),
                             F.col("now").alias("centre")).drop("now", "prior")
    floor = F.abs("centre") * F.lit(P.SCALE_FLOOR_FRACTION)
    deviation = F.abs(F.col("value") - F.col("prior_centre")) * F.lit(P.MAD_TO_SD)
    # scale: the floor if there was no centre, the bare deviation if there was no scale
    start = F.when(F.col("prior_centre").isNull(), floor).otherwise(
        F.greatest(F.coalesce(keep * F.col("scale0") + alpha * deviation, deviation), floor))
    scales = _scanned(centres.select("*", F.when(F.col("first"), 0.0).otherwise(keep).alias("a"),
                                     F.when(F.col("first"), start).otherwise(alpha * deviation).alias("b"), floor.alias("c")))
    return scales.select(*key, "sample_id", "sample_date", "value", "prior_centre",
                         F.when(F.col("first"), F.col("scale0")).otherwise(F.col("prior")).alias("prior_scale"),
                         "centre", F.col("now").alias("scale"))


def stress_signals(samples: DataFrame) -> DataFrame:
    """Score each check-in against the baseline before it; unreliable ones say why."""
    weight = lookup(F.col("feature"), P.ACOUSTIC_WEIGHTS, None)
    way = lookup(F.col("feature"), {k: float(v) for k, v in P.ACOUSTIC_DIRECTIONS.items()}, None)
    z = way * (F.col("value") - F.col("prior_centre")) / F.col("prior_scale")
    usable = F.col("prior_centre").isNotNull() & F.col("prior_scale").isNotNull() & (F.col("prior_scale") > 0)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), z) / F.lit(P.ACOUSTIC_SATURATION_SD))
    scored = ema_fold(samples).groupBy("pseudonym_id", "sample_id").agg(
        F.sum(F.when(usable, weight * share)).alias("weighted"), F.sum(F.when(usable, weight)).alias("available"))
    early = first_samples(samples).select("sample_id", F.lit(True).alias("_early"))
    everyone = samples.select("pseudonym_id", "sample_id", "sample_date").join(early, "sample_id", "left").join(
        scored, ["pseudonym_id", "sample_id"], "left")
    available = F.coalesce("available", F.lit(0.0))
    thin = available < P.ACOUSTIC_MIN_WEIGHT - 1e-12
    reliable = F.col("_early").isNull() & ~thin
    reason = F.when(F.col("_early").isNotNull(), "baseline too short").when(thin, "too little could be measured")
    signal = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(100.0) * F.try_divide(F.col("weighted"), available)))
    return everyone.select(
        "pseudonym_id", "sample_id", "sample_date", F.when(reliable, signal).alias(P.VOICE_SIGNAL),
        reliable.alias("is_reliable"), F.when(F.col("_early").isNull(), available).otherwise(F.lit(0.0))
        .alias("available_weight"), reason.alias("reason"))


def align_to_snapshots(signals: DataFrame, snapshots: Sequence[date],
                       tolerance_days: int = P.SNAPSHOT_INTERVAL_DAYS) -> DataFrame:
    """As-of: newest reliable check-in at or before a snapshot and not older than the tolerance."""
    usable = signals.filter("is_reliable").select("pseudonym_id", "sample_date", "sample_id", P.VOICE_SIGNAL)
    near = with_snapshots(usable, snapshots).filter(
        (F.col("sample_date") <= F.col("snapshot_date"))
        & (F.col("sample_date") >= F.date_sub("snapshot_date", tolerance_days)))
    return near.groupBy("pseudonym_id", "snapshot_date").agg(
        F.max_by(P.VOICE_SIGNAL, F.struct("sample_date", "sample_id")).alias(P.VOICE_SIGNAL))
