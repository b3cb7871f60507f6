"""Exact Shapley values, counterfactual sweeps and what-if scoring.

The scorer is an argument: a function from a mapping of signal name to Column
to a score Column, or (``*_by_model``) any DataFrame -> DataFrame transform.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from math import ceil, factorial
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fettle import policy as P
from fettle import texts
from fettle.operators.scoring import SCORE, band, signal_index, signal_index_arrays
from fettle.operators.spread import settle

ColumnScorer = Callable[[Mapping[str, Column]], Column]


def background(signals: DataFrame, rows: int = P.BACKGROUND_ROWS, seed: int = P.SEED,
               key: Sequence[str] = ("pseudonym_id", "snapshot_date"),
               inputs: Sequence[str] = P.SIGNALS) -> DataFrame:
    """A reproducible reference sample: the rows with the smallest keyed hash."""
    order = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    return signals.withColumn("_order", order).orderBy("_order", *key).limit(rows).select(*key, *inputs)


def _marginal_weights(n: int) -> list[float]:
    """Weight of a coalition of each size in one player's Shapley sum."""
    return [factorial(s) * factorial(n - s - 1) / factorial(n) for s in range(n)]


def _share(mask: Column, bit: int, n: int) -> Column:
    """Signed weight of v(mask) in the value of player ``bit``.

    A coalition holding the player counts +w(|S|-1), one without it -w(|S|), so
    every player's value is one linear sum over coalition scores: no self-join
    between S and S + i is needed.
    """
    weights = F.array(*[F.lit(w) for w in _marginal_weights(n)])
    size = F.bit_count(mask)
    holds = mask.bitwiseAND(F.lit(1 << bit)) != 0
    return F.when(holds, F.element_at(weights, size.cast("int"))).otherwise(
        -F.element_at(weights, (size + 1).cast("int")))


def _as_array(frame: DataFrame, inputs: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in inputs])


CASES_PER_TASK = 32


def _by_work(cases: DataFrame, key: str) -> DataFrame:
    """Cases dealt out before they expand: few small rows carry all the work, so sizes in bytes mislead.

    The number of partitions follows the number of cases.
    """
    return cases.repartition(max(1, ceil(cases.count() / CASES_PER_TASK)), key)


def _per_case(scored: DataFrame, score: str, n: int, key: str) -> DataFrame:
    """Weighted sums over coalitions, each first summed over the reference rows.

    The n weights are looked up once per coalition, not once per reference row. Cases are
    partitioned by their key, which serves both groupings: neither shuffles.
    """
    full = (1 << n) - 1
    coalitions = scored.groupBy(key, "_mask").agg(F.sum(score).alias("_sum"), F.max("_rows").alias("_n"))
    sums = [F.sum(_share(F.col("_mask"), i, n) * F.col("_sum")).alias(f"_phi{i}") for i in range(n)]
    return coalitions.groupBy(key).agg(
        *sums, F.sum(F.when(F.col("_mask") == 0, F.col("_sum"))).alias("_base"),
        F.sum(F.when(F.col("_mask") == full, F.col("_sum"))).alias("_pred"), F.max("_n").alias("_n"))


def shapley(cases: DataFrame, reference: DataFrame, inputs: Sequence[str] = P.SIGNALS,
            scorer: ColumnScorer = signal_index, key: str = "pseudonym_id") -> DataFrame:
    """Exact Shapley values of every case against the reference rows.

    ``reference`` is at most a few hundred rows and is broadcast. Each case row
    expands to coalitions x reference rows inside its own task and is summed
    back to one row per case, so only one row per case is shuffled. A scorer with
    an array form scores all of a case's combinations as arrays; a case with a
    null or NaN input, and any other scorer, expands to rows.
    """
    n = len(inputs)
    if n > P.MAX_EXACT_INPUTS:
        raise ValueError(f"{n} inputs: exact enumeration stops at {P.MAX_EXACT_INPUTS}")
    arrays = ARRAY_FORMS.get(scorer)
    if arrays is None:
        return _by_rows(cases, reference, inputs, scorer, key)
    reference = settle(reference.select(*inputs))
    odd = reduce(or_, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in inputs])
    if not reference.filter(odd).isEmpty():
        return _by_rows(cases, reference, inputs, scorer, key)
    per_row = _by_arrays(cases.filter(~odd), reference, inputs, arrays, key).unionByName(
        _by_rows(cases.filter(odd), reference, inputs, scorer, key))
    # keys may repeat: their rows add up
    return per_row.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("base_value", "prediction", *inputs)])


#: scorers of Columns and the same of arrays
ARRAY_FORMS = {signal_index: signal_index_arrays}

CASES_PER_ARRAY_TASK = 1024


def _by_arrays(cases: DataFrame, reference: DataFrame, inputs: Sequence[str],
               scorer: Callable[[dict[str, np.ndarray]], np.ndarray], key: str) -> DataFrame:
    names, n = list(inputs), len(inputs)
    masks = np.arange(1 << n)
    holds = ((masks[:, None] >> np.arange(n)) & 1).astype(bool)  # coalition x input
    weights, sizes = np.array(_marginal_weights(n)), holds.sum(1)
    share = np.where(holds, weights[sizes - 1][:, None], -weights[np.minimum(sizes, n - 1)][:, None])
    refs = np.array([list(r) for r in reference.select(*[F.col(c).cast("double") for c in names]).collect()], float)  # bounded sample
    shared = cases.sparkSession.sparkContext.broadcast((refs.reshape(-1, n), share))

    def run(batches):
        refs, share = shared.value
        full = (2,) * n + (len(refs),)

        def mixed(row):
            # an axis per input, 0 from the reference and 1 from the case: terms of few inputs stay small
            spots = [(1,) * (n - 1 - i) + (2,) + (1,) * i + (len(refs),) for i in range(n)]
            return {c: np.stack([refs[:, i], np.full(len(refs), row[i])]).reshape(spots[i]) for i, c in enumerate(names)}

        for batch in batches:
            x = batch[names].to_numpy(float)
            value = np.array([np.broadcast_to(scorer(mixed(row)), full).mean(-1).ravel() for row in x]).reshape(-1, 1 << n)
            phi = value @ share
            yield pd.DataFrame({key: batch[key], "base_value": value[:, 0], "prediction": value[:, -1],
                                **{c: phi[:, i] for i, c in enumerate(names)}})

    rows = cases.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, base_value double, prediction double, " + ", ".join(f"`{c}` double" for c in names)
    return rows.repartition(max(1, ceil(rows.count() / CASES_PER_ARRAY_TASK))).mapInPandas(run, schema)


def _by_rows(cases: DataFrame, reference: DataFrame, inputs: Sequence[str], scorer: ColumnScorer, key: str) -> DataFrame:
    n = len(inputs)
    ref = reference.agg(F.collect_list(_as_array(reference, inputs)).alias("_refs"))  # bounded sample
    expanded = (
        _by_work(cases.select(key, _as_array(cases, inputs).alias("_x")), key)
        .crossJoin(F.broadcast(ref))
        .withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
        .withColumn("_b", F.explode("_refs"))
        .select(key, "_mask", F.size("_refs").alias("_rows"), *[
            F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("_x")[i]).otherwise(F.col("_b")[i]).alias(c)
            for i, c in enumerate(inputs)
        ])
        .select(key, "_mask", "_rows", scorer({c: F.col(c) for c in inputs}).alias("_v"))
    )
    per_case = _per_case(expanded, "_v", n, key)
    return per_case.select(
        key, (F.col("_base") / F.col("_n")).alias("base_value"), (F.col("_pred") / F.col("_n")).alias("prediction"),
        *[(F.col(f"_phi{i}") / F.col("_n")).alias(c) for i, c in enumerate(inputs)],
    )


def shapley_by_model(cases: DataFrame, reference: DataFrame, transform: Callable[[DataFrame], DataFrame],
                     score: str, inputs: Sequence[str] = P.MODEL_INPUTS, key: str = "pseudonym_id") -> DataFrame:
    """The same for a fitted model: null players are dropped before expanding.

    A player equal in every case and reference row cannot move the score; its
    value is zero, and each one left out halves the number of coalitions.
    """
    varying = _varying(cases, reference, inputs)
    n = len(varying)
    if n > P.MAX_EXACT_INPUTS:
        raise ValueError(f"{n} inputs: exact enumeration stops at {P.MAX_EXACT_INPUTS}")
    ref = reference.agg(F.collect_list(_as_array(reference, varying)).alias("_refs"))
    fixed = [c for c in inputs if c not in varying]
    expanded = (
        _by_work(cases.select(key, *fixed, _as_array(cases, varying).alias("_x")), key)
        .crossJoin(F.broadcast(ref))
        .withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
        .withColumn("_b", F.explode("_refs"))
        .select(key, "_mask", F.size("_refs").alias("_rows"), *fixed, *[
            F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("_x")[i]).otherwise(F.col("_b")[i]).alias(c)
            for i, c in enumerate(varying)
        ])
    )
    scored = transform(expanded)
    per_case = _per_case(scored, score, n, key)
    values = {c: (F.col(f"_phi{i}") / F.col("_n")) for i, c in enumerate(varying)}
    return per_case.select(
        key, (F.col("_base") / F.col("_n")).alias("base_value"), (F.col("_pred") / F.col("_n")).alias("prediction"),
        *[values.get(c, F.lit(0.0)).alias(c) for c in inputs],
    )


def _varying(cases: DataFrame, reference: DataFrame, inputs: Sequence[str]) -> list[str]:
    both = cases.select(*inputs).unionByName(reference.select(*inputs))
    spans = both.agg(*[F.min(c).alias(f"lo_{c}") for c in inputs], *[F.max(c).alias(f"hi_{c}") for c in inputs]).first()
    return [c for c in inputs if spans[f"lo_{c}"] != spans[f"hi_{c}"]]


def contributions(phi: DataFrame, cases: DataFrame, inputs: Sequence[str] = P.SIGNALS,
                  key: str = "pseudonym_id") -> DataFrame:
    """Long form with the signal's own value and its rank, most positive first."""
    long_phi = phi.unpivot([key], list(inputs), "signal_name", "contribution")
    long_x = cases.select(key, *inputs).unpivot([key], list(inputs), "signal_name", "signal_value")
    position = F.row_number().over(Window.partitionBy(key).orderBy(F.col("contribution").desc(), "signal_name"))
    return long_phi.join(long_x, [key, "signal_name"]).withColumn("position", position)


def top_factors(ranked: DataFrame, count: int = P.TOP_FACTORS) -> DataFrame:
    """Strongest upward contributors only; protective ones are not drivers."""
    return ranked.filter((F.col("contribution") > 0) & (F.col("position") <= count))


def additivity(phi: DataFrame, inputs: Sequence[str] = P.SIGNALS) -> DataFrame:
    """Worst gap between the sum of contributions and prediction - base."""
    total = sum((F.col(c) for c in inputs), F.lit(0.0))
    gap = F.abs(total - (F.col("prediction") - F.col("base_value")))
    return phi.agg(F.count(F.lit(1)).alias("cases"), F.max(gap).alias("worst_gap"),
                   F.count_if(gap > 1e-6 * F.greatest(F.lit(1.0), F.abs("prediction"))).alias("violations"))


def population_medians(signals: DataFrame, inputs: Sequence[str] = P.SIGNALS, decimals: int = 1) -> DataFrame:
    """Median per signal of the published (rounded) values, one row per signal.

    Published values have one decimal, so a signal has at most 1001 distinct
    values whatever the population: they are counted, then ranked as counts.
    """
    rounded = signals.select(*[F.bround(F.col(c), decimals).alias(c) for c in inputs])
    counts = rounded.unpivot([], list(inputs), "signal_name", "value").filter(F.col("value").isNotNull()) \
        .groupBy("signal_name", "value").agg(F.count(F.lit(1)).alias("ties"))
    ordered = Window.partitionBy("signal_name").orderBy("value")
    every = Window.partitionBy("signal_name")
    ranked = counts.withColumn("upto", F.sum("ties").over(ordered)).withColumn("n", F.sum("ties").over(every))
    low = F.min(F.when(F.col("upto") >= F.floor((F.col("n") + 1) / 2), F.col("value")))
    high = F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("value")))
    medians = ranked.groupBy("signal_name").agg(low.alias("lo"), high.alias("hi"))
    names = signals.sparkSession.createDataFrame([(c,) for c in inputs], "signal_name string")
    return names.join(medians, "signal_name", "left").select(
        "signal_name", F.coalesce((F.col("lo") + F.col("hi")) / F.lit(2.0), F.lit(0.0)).alias("median"))


def sweep(cases: DataFrame, medians: DataFrame, scorer: ColumnScorer = signal_index, score: str = SCORE,
          inputs: Sequence[str] = P.SIGNALS, min_move: float = P.MIN_REDUCTION,
          key: str = "pseudonym_id") -> DataFrame:
    """Each signal held at its population median in turn, rescored within the row.

    No join per variant: the medians are one broadcast row and the variants are
    an array of scores exploded in place.
    """
    row = medians.groupBy().pivot("signal_name", list(inputs)).agg(F.first("median")).select(
        *[F.col(c).alias(f"_m_{c}") for c in inputs])
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("signal_name"), F.lit(P.SIGNAL_LABELS[c]).alias("label"),
            F.col(c).alias("current_value"), F.col(f"_m_{c}").alias("reference_value"),
            scorer({s: (F.col(f"_m_{s}") if s == c else F.col(s)) for s in inputs}).alias("projected_score"),
        ) for c in inputs
    ])
    current = F.col("current_score")
    moved = (
        cases.crossJoin(F.broadcast(row))
        .select(key, F.col(score).alias("current_score"), F.inline(entries))
        .withColumn("reduction", current - F.col("projected_score"))
        .filter(F.abs("reduction") >= min_move)
        .withColumn("would_leave_high_band", (current >= P.HIGH_MIN) & (F.col("projected_score") < P.HIGH_MIN))
        .withColumn("would_leave_officer_queue",
                    (current >= P.MODERATE_MIN) & (F.col("projected_score") < P.MODERATE_MIN))
    )
    position = F.row_number().over(Window.partitionBy(key).orderBy(F.col("reduction").desc(), "signal_name"))
    return moved.withColumn("position", position)


def sweep_summary(cases: DataFrame, entries: DataFrame, score: str = SCORE, key: str = "pseudonym_id") -> DataFrame:
    """Per case: entries kept, decisive ones, the largest lever and the sentence about it."""
    per = entries.groupBy(key).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("would_leave_high_band").alias("decisive_count"),
        F.min_by("signal_name", "position").alias("largest_lever"), F.min_by("label", "position").alias("_label"),
        F.min_by("projected_score", "position").alias("_projected"),
        F.array_sort(F.collect_list(F.when(  # at most one entry per signal
            F.col("would_leave_high_band"), F.struct("position", F.lower("label").alias("l"))))).alias("_decisive"))
    names = F.array_join(F.transform(F.slice("_decisive", 1, 2), lambda x: x["l"]), ", ")
    current = F.col("current_score")
    summary = (
        F.when(F.coalesce(F.col("entries"), F.lit(0)) == 0, F.lit(texts.NO_LEVER))
        .when(F.col("decisive_count") > 0, F.format_string(texts.DECISIVE_LEVER, names))
        .otherwise(F.format_string(texts.LARGEST_LEVER, F.lower("_label"), F.bround("_projected"), F.bround(current))))
    return cases.select(key, F.col(score).alias("current_score"), band(F.col(score)).alias("current_level")) \
        .join(per, key, "left").select(
            key, "current_score", "current_level", F.coalesce("entries", F.lit(0)).alias("entries"),
            F.coalesce("decisive_count", F.lit(0)).alias("decisive_count"), "largest_lever", summary.alias("summary"))


def adjustment_problem(name: str = "signal_name", value: str = "new_value") -> Column:
    """Why an override is refused, or NULL when it is fine."""
    v = F.col(value)
    return (
        F.when(~F.coalesce(F.col(name).isin(*P.SIGNALS), F.lit(False)), "not adjustable")
        .when(v.isNull() | F.isnan(v), "not a number")
        .when((v < P.SIGNAL_MIN) | (v > P.SIGNAL_MAX), "out of range")
    )


def what_if(cases: DataFrame, overrides: DataFrame, scorer: ColumnScorer = signal_index,
            inputs: Sequence[str] = P.SIGNALS, key: str = "pseudonym_id") -> DataFrame:
    """Score with some signals replaced; refused overrides are left out."""
    valid = overrides.filter(adjustment_problem().isNull())
    wide = valid.groupBy(key).agg(*[
        F.max(F.when(F.col("signal_name") == c, F.col("new_value"))).alias(f"_o_{c}") for c in inputs])
    replaced = {c: F.coalesce(F.col(f"_o_{c}"), F.col(c)) for c in inputs}
    return (
        cases.join(wide, key)
        .withColumn("current_score", scorer({c: F.col(c) for c in inputs}))
        .withColumn("projected_score", scorer(replaced))
        .withColumn("change", F.col("projected_score") - F.col("current_score"))
        .select(key, "current_score", "projected_score", "change")
    )
