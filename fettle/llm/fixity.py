"""Fixity audit of WARC replicas with Merkle trees.

A replica is a table of records: ``archive`` (file), ``offset`` and ``bytes`` (length) of
the record in it, and the SHA-256 of its content. Records are leaves. Level one joins the
records of one range of ``RANGE`` bytes, in offset order; every further level joins up to
``FANOUT`` neighbouring ranges, up to one root per archive. Two replicas are compared from
the roots down, and only below nodes that differ: level k+1 is met with the differing
nodes of level k, so what is read shrinks with the damage. No node ever holds more than
the records of one range or FANOUT children, however large an archive is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.operators.spread import running_totals, settle

RANGE = 1 << 20
FANOUT = 64
PER_ARCHIVE = 4096


def record_of(url: Column, page_id: Column, html: Column) -> Column:
    """A page as the text of one WARC resource record."""
    body, name = F.coalesce(html, F.lit("")), F.coalesce(page_id.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def catalogue(records: DataFrame) -> DataFrame:
    """Adds ``offset``: running sum of ``bytes`` per ``archive`` in the order of ``position``.

    (archive, position) must be unique. The sum is carried over range partitions, so one
    large archive spans many tasks.
    """
    return (running_totals(records, ["archive"], ["position"], "bytes", "_end")
            .withColumn("offset", F.col("_end") - F.col("bytes")).drop("_end"))


def _hash(children: Column) -> Column:
    return F.sha2(F.array_join(children, "\n"), 256)


def ranges(replica: DataFrame) -> DataFrame:
    """Level one: ``archive``, ``node``, ``hash``."""
    leaf = F.struct("offset", "bytes", "sha256")
    parts = F.transform(F.array_sort(F.collect_list(leaf)), lambda r: F.concat_ws(
        ":", r["offset"].cast("string"), r["bytes"].cast("string"), r["sha256"]))
    return replica.groupBy("archive", F.floor(F.col("offset") / RANGE).cast("long").alias("node")).agg(_hash(parts).alias("hash"))


def parents(level: DataFrame) -> DataFrame:
    """The next level: FANOUT neighbours joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: F.concat_ws(
        ":", c["node"].cast("string"), c["hash"]))
    return level.groupBy("archive", F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(
        _hash(parts).alias("hash")).withColumnRenamed("up", "node")


def tree(replica: DataFrame, levels: int) -> list[DataFrame]:
    """Levels from the ranges up to the roots, each written once."""
    built = [settle(ranges(replica))]
    for _ in range(levels - 1):
        built.append(settle(parents(built[-1])))
    return built


def levels_for(*replicas: DataFrame) -> int:
    """Levels after which every archive has one root."""
    far = max(r.agg(F.max("offset").alias("m")).first()["m"] or 0 for r in replicas)
    nodes, levels = far // RANGE + 1, 1
    while nodes > 1:
        nodes, levels = math.ceil(nodes / FANOUT), levels + 1
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b")))


def audit(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(damage, roots) of two replicas with archive, offset, bytes, sha256.

    ``damage``: archive, offset, first_sha256, second_sha256, status ``changed``,
    ``missing`` (not in the second) or ``extra`` (only there). ``roots``: archive, hash of
    the first replica's root. Equal replicas and empty tables give no damage; a record
    whose length alone differs is changed. archive and offset must not be null (the
    catalogue gives neither); records repeated at one offset count as one changed place;
    other columns are not read.
    """
    levels = levels_for(first, second)
    trees = [tree(r, levels) for r in (first, second)]
    bad = _differing(trees[0][-1], trees[1][-1], ["archive", "node"], "hash").select("archive", "node")
    for k in range(levels - 2, -1, -1):
        bad = settle(bad)
        up = bad.withColumnRenamed("node", "_up")
        below = [t[k].withColumn("_up", F.floor(F.col("node") / FANOUT).cast("long")).join(up, ["archive", "_up"], "left_semi")
                 for t in trees]
        bad = _differing(*below, ["archive", "node"], "hash").select("archive", "node")
    bad = settle(bad)
    leaf = F.concat_ws(":", F.col("bytes").cast("string"), F.col("sha256"))
    suspects = [r.withColumn("node", F.floor(F.col("offset") / RANGE).cast("long")).join(bad, ["archive", "node"], "left_semi")
                .groupBy("archive", "offset").agg(F.max(leaf).alias("leaf")) for r in (first, second)]
    found = _differing(*suspects, ["archive", "offset"], "leaf")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("changed")
    plain = lambda c: F.substring_index(F.col(c), ":", -1)
    return found.select("archive", "offset", plain("_a").alias("first_sha256"), plain("_b").alias("second_sha256"),
                        status.alias("status")), trees[0][-1].select("archive", "hash")


def replicas_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the pages as WARC archives of PER_ARCHIVE consecutive page numbers.

    The second has damage of fixed places to find: pages whose number leaves 5 on division
    by 499 have one character added to their body, those that leave 7 on division by 997
    are lost. Null page numbers form archive -1; pages repeated under one number keep their
    order by content.
    """
    flipped = F.when(F.col("page_id") % 499 == 5, F.concat(F.coalesce("html", F.lit("")), F.lit("~"))).otherwise(F.col("html"))
    record = record_of(F.col("url"), F.col("page_id"), F.col("html"))
    second = record_of(F.col("url"), F.col("page_id"), flipped)
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / PER_ARCHIVE).cast("long"), F.lit(-1)).alias("archive"), "page_id",
        F.octet_length(record).cast("long").alias("bytes"), F.sha2(record, 256).alias("sha256"),
        F.octet_length(second).cast("long").alias("second_bytes"), F.sha2(second, 256).alias("second_sha256"),
        (F.col("page_id") % 997 == 7).alias("lost"), F.monotonically_increasing_id().alias("_row"))
    placed = rows.withColumn("position", F.struct(F.coalesce("page_id", F.lit(-1)).alias("n"), F.col("sha256").alias("s"), F.col("_row").alias("r")))
    first = settle(catalogue(placed.drop("_row")))
    copy = first.filter(~F.coalesce("lost", F.lit(False))).select(
        "archive", "offset", F.col("second_bytes").alias("bytes"), F.col("second_sha256").alias("sha256"))
    return first.select("archive", "page_id", "offset", "bytes", "sha256"), copy


def report(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per record of the first replica: its place, hash, the root of its archive and what the audit found."""
    damage, roots = audit(first, second)
    return (first.join(damage.select("archive", "offset", "second_sha256", "status"), ["archive", "offset"], "left")
            .join(roots.withColumnRenamed("hash", "root_sha256"), "archive", "left")
            .select("archive", "page_id", F.col("offset").alias("record_offset"), F.col("bytes").alias("record_bytes"),
                    "sha256", "root_sha256", F.coalesce("status", F.lit("ok")).alias("status")))


SQL = """
WITH recs AS (SELECT page_id, coalesce(CAST(floor(page_id / 4096.0) AS BIGINT), -1) AS archive,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || repeat(chr(13) || chr(10), 2)
    || coalesce(html, '') || repeat(chr(13) || chr(10), 2) AS rec FROM pages),
hashed AS (SELECT archive, page_id, octet_length(encode(rec)) AS n, sha256(rec) AS h FROM recs),
placed AS (SELECT *, CAST(sum(n) OVER (PARTITION BY archive ORDER BY coalesce(page_id, -1), h ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS o FROM hashed),
l1 AS (SELECT archive, o // 1048576 AS node, sha256(string_agg(CAST(o AS VARCHAR) || ':' || CAST(n AS VARCHAR) || ':' || h, chr(10) ORDER BY o)) AS hash
       FROM placed GROUP BY 1, 2),
top AS (SELECT max(o) // 1048576 + 1 AS nodes FROM placed),
l2 AS (SELECT archive, node // 64 AS node, sha256(string_agg(CAST(node AS VARCHAR) || ':' || hash, chr(10) ORDER BY node)) AS hash FROM l1 GROUP BY 1, 2),
l3 AS (SELECT archive, node // 64 AS node, sha256(string_agg(CAST(node AS VARCHAR) || ':' || hash, chr(10) ORDER BY node)) AS hash FROM l2 GROUP BY 1, 2),
roots AS (SELECT archive, hash FROM l1 WHERE (SELECT nodes FROM top) = 1
          UNION ALL SELECT archive, hash FROM l2 WHERE (SELECT nodes FROM top) BETWEEN 2 AND 64
          UNION ALL SELECT archive, hash FROM l3 WHERE (SELECT nodes FROM top) BETWEEN 65 AND 4096)
SELECT archive, page_id, o AS record_offset, CAST(n AS BIGINT) AS record_bytes, h AS sha256, roots.hash AS root_sha256,
       CASE WHEN page_id % 997 = 7 THEN 'missing' WHEN page_id % 499 = 5 THEN 'changed' ELSE 'ok' END AS status
FROM placed JOIN roots USING (archive)
"""
