"""Agreement of the scores with outside raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle import texts
from fettle.operators import spread

PHRASES = texts.SIGNAL_PHRASES
PHRASED = 4


def level_word(value: Column) -> Column:
    return (
        F.when(value >= 75, "far above").when(value >= 55, "well above").when(value >= 35, "somewhat above")
        .when(value >= 15, "around").otherwise("below"))


def describe(cases: DataFrame) -> DataFrame:
    """Posting and the four most elevated conditions in words, inside the row (no shuffle)."""
    ranked = F.array_sort(F.array(*[
        F.struct((-F.col(c)).alias("down"), F.lit(i).alias("at"),
                 F.format_string(text, level_word(F.col(c))).alias("sentence"))
        for i, (c, text) in enumerate(PHRASES.items())]))
    lines = F.transform(F.slice(ranked, 1, PHRASED), lambda x: x["sentence"])
    posting = F.concat(F.lit("Posting: "), F.translate("posting_type", "_", " "), F.lit("."))
    return cases.withColumn("description", F.concat_ws(" ", posting, F.concat_ws(" ", lines)))


def systematic_sample(cases: DataFrame, count: int, score: str = "welfare_risk_score",
                      tie: str = "pseudonym_id") -> DataFrame:
    """Evenly spaced picks through the score order: positions int(i·N/count)."""
    ordered = spread.numbered(cases, [], [score, tie], "_position")
    size = ordered.agg(F.max("_position")).scalar()
    at = F.col("_position") - 1
    step = F.col("_n") / F.lit(float(count))
    nearest = F.ceil(at / step)
    # floor(i·step) may land on this row for i one below or above the division
    pick = F.least(*[
        F.when((i >= 0) & (i < count) & (F.floor(i * step) == at), i)
        for i in (nearest - 1, nearest, nearest + 1)])
    index = F.when(F.col("_n") <= count, at).otherwise(pick)
    return ordered.withColumn("_n", size).withColumn("sample_index", index).filter(
        F.col("sample_index").isNotNull()).withColumn(
        "profile_id", F.format_string("R%03d", F.col("sample_index") + 1)).drop("_position", "_n", "sample_index")


def _weighted_corr(pairs: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """Pearson correlation of counted pairs; NULL for fewer than two or no spread."""
    weight, a, b = F.col(w), F.col(x), F.col(y)
    s = pairs.groupBy(*keys).agg(
        F.sum(weight).alias("n"), F.sum(weight * a).alias("sa"), F.sum(weight * b).alias("sb"),
        F.sum(weight * a * a).alias("saa"), F.sum(weight * b * b).alias("sbb"), F.sum(weight * a * b).alias("sab"))
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    return s.select(*keys, "n", F.when((n >= 2) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("rho"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation over the whole table.

    Rows become counts per (x, y), then counts per value are ranked, so neither
    ties nor the row number bound a single task.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    weighted = lambda c, out: _value_ranks(pairs, c, out)
    ranked = pairs.join(weighted(x, "rx"), x).join(weighted(y, "ry"), y)
    return _weighted_corr(ranked, [], "rx", "ry", "w")


def _value_ranks(pairs: DataFrame, value: str, out: str) -> DataFrame:
    counts = pairs.groupBy(value).agg(F.sum("w").alias("ties"))
    total = spread.running_totals(counts, [], [value], "ties", "upto")
    return total.select(value, (F.col("upto") - (F.col("ties") - 1) / F.lit(2.0)).alias(out))


def one_rating(ratings: DataFrame) -> DataFrame:
    """One rating per (rater, profile): the last one given."""
    return ratings.groupBy("rater_id", "profile_id").agg(F.max_by("rating", "given_at").alias("rating"))


def inter_rater(ratings: DataFrame, least: int = 3, cell: int = 512) -> DataFrame:
    """Pairwise agreement on shared profiles.

    The ratings of a profile are dealt into parts of about ``cell`` by the rater's hash;
    every pair of parts is a join key of its own, so a profile with a third of all ratings
    spreads over many tasks and no task holds its panel. A rating is copied once per part.
    What leaves a task is a count per (rater pair, rating pair); ranks are then taken
    inside those counts.
    """
    sizes = ratings.groupBy("profile_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias("parts"))
    dealt = ratings.join(sizes, "profile_id").withColumn("part", F.pmod(F.xxhash64("rater_id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = dealt.select("profile_id", F.col("part").alias("i"), every.alias("j"), F.col("rater_id").alias("rater_a"), F.col("rating").alias("x"))
    other = dealt.select("profile_id", every.alias("i"), F.col("part").alias("j"), F.col("rater_id").alias("rater_b"), F.col("rating").alias("y"))
    pairs = one.join(other, ["profile_id", "i", "j"]).filter("rater_a < rater_b")
    counts = pairs.groupBy("rater_a", "rater_b", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    key = ["rater_a", "rater_b"]
    rx = spread.running_totals(counts.groupBy(*key, "x").agg(F.sum("w").alias("t")), key, ["x"], "t", "u")
    ry = spread.running_totals(counts.groupBy(*key, "y").agg(F.sum("w").alias("t")), key, ["y"], "t", "u")
    avg_rank = F.col("u") - (F.col("t") - 1) / F.lit(2.0)
    ranked = counts.join(rx.select(*key, "x", avg_rank.alias("rx")), [*key, "x"]).join(
        ry.select(*key, "y", avg_rank.alias("ry")), [*key, "y"])
    return _weighted_corr(ranked, key, "rx", "ry", "w").filter((F.col("n") >= least) & F.col("rho").isNotNull())


def consensus(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("profile_id").agg(F.avg("rating").alias("consensus"), F.count("rating").alias("raters"))


def model_agreement(ratings: DataFrame, scores: DataFrame) -> DataFrame:
    """Rank correlation of the consensus with the scores on matched profiles."""
    agreed = consensus(ratings).withColumn("consensus", F.round("consensus", 6))  # equal means must tie
    matched = agreed.join(scores.select("profile_id", "model_score"), "profile_id")
    return spearman(matched, "model_score", "consensus")


