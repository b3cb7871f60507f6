"""Sources mixed to target weights by Poisson replication.

A row of source s is wanted ``target_s / share_s`` times on average. The number of its
copies is drawn from the Poisson distribution of that mean by inversion: a hash of seed,
key and part gives a number in [0, 1), and the count is how many steps of the cumulative
distribution lie at or below it. Means over ``PART`` are split in equal parts, one draw
each (sums of Poisson draws are Poisson draws), so the tables of steps have one fixed
length. Every row decides alone: no sort, no quota, the same result on any cluster.

Copies are then put in one global order by a second hash: range-partitioned on it and
sorted within partitions, which is the whole shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.llm.rows import named, packed, unpacked
from fettle.operators.spread import settle

PART = 8.0
#: P(Poisson(8) > 60) is under 2**-53, less than the hash can tell
STEPS = 60
SEED = 17


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the joined parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None,
          temperature: float = 0.5) -> DataFrame:
    """``mixed``, ``rows``, ``rate`` per source; one partial aggregate.

    ``weights`` are target weights (any positive scale; sources left out get none).
    Without them the targets are the shares raised to ``temperature``. The expected number
    of copies equals the number of rows of the sources with a weight.
    """
    counts = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("mixed")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weighed = counts.withColumn("_w", F.pow(F.col("rows").cast("double"), F.lit(temperature)))
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else None
        weighed = counts.withColumn("_w", F.coalesce(table[F.col("mixed")], F.lit(0.0)) if weights else F.lit(0.0))
    weighed = settle(weighed)
    whole = weighed.filter(F.col("_w") > 0).agg(F.sum("_w").alias("_all_w"), F.sum("rows").alias("_all_n"))
    return weighed.crossJoin(F.broadcast(whole)).select("mixed", "rows", F.coalesce(
        F.col("_w") * F.col("_all_n") / (F.col("_all_w") * F.col("rows")), F.lit(0.0)).alias("rate"))


def poisson_table(rate: Column) -> tuple[Column, Column]:
    """Number of parts, and the cumulative distribution of one part at 0 to STEPS."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    mean = rate / parts
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("steps"))
    table = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"), (acc["c"] + acc["p"] * mean / k).alias("c"),
        F.concat(acc["steps"], F.array(acc["c"] + acc["p"] * mean / k)).alias("steps")), lambda acc: acc["steps"])
    return parts, table


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` with all their columns, repeated by their draw, in global shuffle order.

    Added: ``copy`` (from 1) and ``order_key`` (60-bit hash the order goes by).
    Null sources are one source named "", null keys draw by their text (rows equal in key
    draw alike), an empty table gives an empty result; an incoming column named like an
    added one is replaced.
    """
    table = rates(docs, source, weights, temperature)
    parts, steps = poisson_table(F.col("rate"))
    table = settle(table.withColumn("parts", parts).withColumn("steps", steps))
    name = F.coalesce(named(key).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(named(text), F.lit("")))))
    rows = packed(docs, mixed=F.coalesce(named(source), F.lit("")), name=name).join(table, "mixed")
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: uniform(F.lit(str(seed)), F.col("name"), part.cast("string")))
    draws = F.transform(draws, lambda u: F.size(F.filter("steps", lambda c: c <= u)))
    rows = rows.withColumn("copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x))
    copies = rows.filter((F.col("rate") > 0) & (F.col("copies") > 0)).select(
        "row", "name", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    digest = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.col("name"), F.col("copy").cast("string")))
    shuffled = (copies.withColumn("order_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
                .repartitionByRange("order_key", "name", "copy").sortWithinPartitions("order_key", "name", "copy"))
    return unpacked(shuffled, docs.columns, copy=F.col("copy").cast("long"), order_key=F.col("order_key"))


SQL = """
WITH shares AS (SELECT coalesce(source, '') AS s, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY 1),
rates AS (SELECT s, w * (SELECT sum(n) FROM shares) / ((SELECT sum(w) FROM shares) * n) AS rate FROM shares),
parts AS (SELECT s, CAST(greatest(ceil(rate / 8.0), 1) AS INTEGER) AS parts, rate / greatest(ceil(rate / 8.0), 1) AS mean FROM rates),
terms AS (SELECT s, parts, k, CASE WHEN k = 0 THEN exp(-mean) ELSE exp(-mean + k * ln(mean) - lgamma(k + 1)) END AS p
          FROM parts, range(0, 61) r(k)),
steps AS (SELECT s, parts, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
tables AS (SELECT s, any_value(parts) AS parts, list(c ORDER BY k) AS cs FROM steps GROUP BY s),
named AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) AS name FROM documents),
drawn AS (SELECT doc_id, s, name, list_sum(list_transform(range(1, parts + 1), lambda part: len(list_filter(cs,
            lambda c: c <= CAST(('0x' || substr(md5('17:' || name || ':' || CAST(part AS VARCHAR)), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)))))
            AS copies FROM named JOIN tables USING (s)),
copied AS (SELECT doc_id, s, name, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS copy FROM drawn)
SELECT doc_id, s AS source, CAST(copy AS BIGINT) AS copy,
       CAST(('0x' || substr(md5('order 17:' || name || ':' || CAST(copy AS VARCHAR)), 1, 15)) AS BIGINT) AS order_key FROM copied
"""


def report(mixed: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Digest columns: one row per copy."""
    return mixed.select(named(key), F.coalesce(named(source), F.lit("")).alias("source"), "copy", "order_key")
