"""Ranked lexical search: exact inner products through ball trees over sparse document vectors.

A document's vector holds, for each term that any query asks for, the whole number
``weight * ((10**9 * tf) div (1000 * tf + 8 * m))``; a query's vector holds how often it
names a term. Their inner product is the score, in whole numbers throughout.

Documents are taken in shards of one partition, about ``SHARD_BYTES`` of text, so nothing
is shuffled. Within a task each shard gets a ball tree: nodes with a centroid and a radius
in each of ``GROUPS`` groups of columns. For any document x below a node,
q.x <= q.c + |q1| r1 + |q2| r2 + ...; a query visits nodes best-first by that bound and
stops where it falls below its tenth score so far, so whole subtrees are never scored.
(With one group, the bound is |q| r for terms that a query does not even name.) Centroids and radii are doubles; both are widened by more than their
rounding can be (``SLACK``), so no document is lost to it. Leaves are scored exactly in
integers. A task keeps the best of all its shards and returns k rows a query, which are
then ranked, first by task salt, then over all.

Queries come in blocks of at most ``BLOCK_TERMS`` distinct terms (one query at least),
each of which a task loads, uses and lets go: memory is bounded for any benchmark.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fettle.llm.contamination import words_of
from fettle.llm.rows import named
from fettle.operators.spread import settle

TOP = 10
SHARD_BYTES = 8 << 20
BLOCK_TERMS = 8_192
LEAF = 16
SALTS = 32
GROUPS = 1_024  # groups of columns with a radius of their own
ROWS = 1_024  # documents measured against a centroid at a time
#: sums of n products of doubles err by less than n * 2**-53 of the sum of magnitudes; this is 8 times that for 2**13
#: products, and grows with a block that has more columns
SLACK = 1e-11


@dataclass
class Queries:
    """A block of queries: numbers, terms by column, and counts as (columns, repeats) of each query."""

    numbers: list[int]
    column: dict[bytes, int]
    wanted: list


def blocks_of(rows: list[tuple[int, str]], limit: int) -> list[Queries]:
    """Queries gathered until their distinct terms reach the limit."""
    import numpy as np

    out: list[Queries] = []
    for number, text in rows:
        count = Counter(words_of(text))
        if not count:
            continue
        if not out or len(out[-1].column.keys() | count.keys()) > limit:
            out.append(Queries([], {}, []))
        block = out[-1]
        at = [block.column.setdefault(t, len(block.column)) for t in count]
        block.numbers.append(number)
        block.wanted.append((np.array(at, np.int64), np.array(list(count.values()), np.int64)))
    return out


class Shard:
    """Term counts of a run of documents: per distinct (document, term) the term number and its repeats."""

    def __init__(self, texts: list[str | None]):
        import numpy as np

        number: dict[bytes, int] = {}
        terms, sizes = [], []
        for t in texts:
            words = words_of(t)
            sizes.append(len(words))
            terms.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        self.length = np.array(sizes, np.int64)
        self.terms = list(number)
        every = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        size = max(1, len(self.terms))
        pairs, self.tf = np.unique(np.repeat(np.arange(len(sizes)), self.length) * size + every, return_counts=True)
        self.doc, self.term = pairs // size, pairs % size

    def columns(self, block: Queries):
        """Column of each of the shard's terms in a block, or -1."""
        import numpy as np

        return np.array([block.column.get(t, -1) for t in self.terms] or [-1], np.int64)


class BallTree:
    """Ball tree over sparse whole-number vectors (row starts, columns, values)."""

    def __init__(self, starts, cols, vals, width: int, leaf: int = LEAF, groups: int = GROUPS):
        import numpy as np

        self.width, self.groups, rows = width, max(1, min(groups, width)), len(starts) - 1
        slack, groups = max(SLACK, width * 2.0 ** -50), self.groups
        group = np.arange(width) % groups
        exact = vals.astype(np.float64)
        square = np.add.reduceat(exact * exact, starts[:-1])
        self.rows, self.left, self.right, self.span, centres, radii = np.arange(rows), [], [], [], [], []

        def gather(ids):
            """Places of the entries of some rows, and which of them each belongs to."""
            size = starts[ids + 1] - starts[ids]
            owner = np.repeat(np.arange(len(ids)), size)
            return np.repeat(starts[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), owner

        stack = [(0, rows, None, False)]
        while stack:
            low, high, parent, is_right = stack.pop()
            ids = self.rows[low:high]
            at, owner = gather(ids)
            c, v = cols[at], exact[at]
            centre = np.bincount(c, v, minlength=width) / len(ids)
            length = float(centre @ centre)
            toward = lambda y: np.bincount(owner, v * y[c], minlength=len(ids))  # noqa: E731, B023
            far = square[ids] - 2 * toward(centre) + length
            # squared distances by group; what the subtraction can lose is a share of the terms subtracted
            lengths, square_most, apart_most = np.bincount(group, centre * centre, groups), np.zeros(groups), np.full(groups, -np.inf)
            edges = np.searchsorted(owner, np.arange(0, len(ids) + ROWS, ROWS))
            for k, (i, j) in enumerate(zip(edges, edges[1:])):
                n = min(ROWS, len(ids) - k * ROWS)
                place, x, y = (owner[i:j] - k * ROWS) * groups + group[c[i:j]], v[i:j], centre[c[i:j]]
                apart_most = np.maximum(apart_most, np.bincount(place, x * x - 2 * x * y, n * groups).reshape(n, groups).max(0))
                square_most = np.maximum(square_most, np.bincount(place, x * np.maximum(x, y), n * groups).reshape(n, groups).max(0))
            radius = np.sqrt(np.maximum(apart_most + lengths + 4 * slack * (square_most + lengths), 0.0)) * (1 + slack)
            node = len(self.left)
            self.left.append(-1)
            self.right.append(-1)
            self.span.append((low, high))
            centres.append(centre)
            radii.append(radius)
            if parent is not None:
                (self.right if is_right else self.left)[parent] = node
            if len(ids) <= leaf:
                continue
            # two far rows; halves by which of them is nearer
            poles = []
            for _ in range(2):
                row = int(np.argmax(far))
                pole = np.bincount(c[owner == row], v[owner == row], minlength=width)
                far = square[ids] - 2 * toward(pole) + float(pole @ pole)
                poles.append(far)
            order = np.argsort(poles[0] - poles[1], kind="stable")
            self.rows[low:high] = ids[order]
            cut = low + len(ids) // 2
            stack += [(cut, high, node, True), (low, cut, node, False)]
        self.centres, self.radii, self.slack = np.array(centres), np.array(radii), slack
        at, owner = gather(self.rows)  # entries in the order of the leaves
        self.cols, self.vals = cols[at], vals[at]
        self.starts = np.concatenate(([0], np.cumsum(starts[self.rows + 1] - starts[self.rows])))

    def bounds(self, wanted: list):
        """Upper bounds of the score by node and query."""
        import numpy as np

        asked = np.zeros((self.width, len(wanted)))
        for k, (at, times) in enumerate(wanted):
            asked[at, k] = times
        at = np.arange(self.width) % self.groups
        length = np.zeros((self.groups, len(wanted)))
        np.add.at(length, at, asked * asked)
        middle = self.centres @ asked
        return (middle + self.radii @ np.sqrt(length)) * (1 + 4 * self.slack) + 1e-6

    def search(self, bound: list[float], weights, keep, limit):
        """Visit leaves best-first for one query: ``keep`` takes rows and exact scores, ``limit()`` is the least score that still counts."""
        import numpy as np

        heap, visited = [(-bound[0], 0)], 0
        while heap:
            top, node = heapq.heappop(heap)
            if -top < limit():
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (max(top, -bound[child]), child))
                continue
            low, high = self.span[node]
            a, b = self.starts[low], self.starts[high]
            scores = np.add.reduceat(self.vals[a:b] * weights[self.cols[a:b]], self.starts[low:high] - a)
            keep(self.rows[low:high], scores)
            visited += high - low
        return visited


class Best:
    """The k best of what one query has met: highest score first, then smallest key, null keys last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def limit(self) -> int:
        """Least score that can still matter; equal scores may, by their key."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, keys: list, scores) -> None:
        import numpy as np

        for i in np.flatnonzero(scores >= max(1, self.limit())).tolist():
            self.rows.append((int(scores[i]), keys[i]))
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        del self.rows[self.k:]


def statistics(docs: DataFrame, text: str, blocks: list) -> tuple[int, int, dict[tuple[int, int], int]]:
    """Documents with a term, their terms, and by (block, column) the documents holding that term."""
    import numpy as np
    import pyarrow as pa

    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(b) for b in blocks]

    def count(batches):
        seen, used, total = Counter(), 0, 0
        for texts in shards(batches, 0, SHARD_BYTES):
            shard = Shard(texts[0])
            used += int((shard.length > 0).sum())
            total += int(shard.length.sum())
            df = np.bincount(shard.term, minlength=len(shard.terms))
            for k, block in enumerate(loaded(shared)):
                column = shard.columns(block)
                for i in np.flatnonzero(column >= 0).tolist():
                    seen[k, int(column[i])] += int(df[i])
        seen[-1, 0], seen[-1, 1] = used, total
        keys = list(seen)
        for low in range(0, len(keys), 10_000):
            part = keys[low:low + 10_000]
            yield pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in part], pa.int32()), "col": pa.array([c for _, c in part], pa.int64()),
                                              "n": pa.array([seen[p] for p in part], pa.int64())})

    counted = docs.select(named(text).alias("body")).mapInArrow(count, "block int, col bigint, n bigint").groupBy("block", "col").agg(F.sum("n").alias("n"))
    found = {(r["block"], r["col"]): r["n"] for r in counted.toLocalIterator()}
    return found.pop((-1, 0), 0), found.pop((-1, 1), 0), found


def shards(batches, text_column: int, limit: int):
    """Runs of whole rows of about ``limit`` bytes of text, as lists by column."""
    import pyarrow.compute as pc

    held, size = None, 0
    for batch in batches:
        names = [batch.column(k) for k in range(batch.num_columns)]
        sizes = pc.binary_length(names[text_column]).to_pylist()
        first = 0
        for k, n in enumerate(sizes):
            size += (n or 0) + 256
            if size >= limit:
                held = gathered(held, names, first, k + 1)
                yield held
                held, first, size = None, k + 1, 0
        if first < len(sizes):
            held = gathered(held, names, first, len(sizes))
    if held:
        yield held


def gathered(held, columns, low: int, high: int):
    held = held or [[] for _ in columns]
    for to, column in zip(held, columns):
        to += column.slice(low, high - low).to_pylist()
    return held


def loaded(shared: list):
    """Blocks one after another; of several, one is in memory at a time."""
    for b in shared:
        yield b.value
        if len(shared) > 1:
            vars(b).pop("_value", None)


def weight(held: int, used: int) -> int:
    """Weight of a term that ``held`` of ``used`` documents hold."""
    return math.floor(1000 * math.log((2 * used + 2) / (2 * held + 1)))


def search_shard(shard: Shard, keys: list, block: Queries, weights, used: int, total: int, best: dict[int, Best], leaf: int = LEAF, groups: int = GROUPS) -> int:
    """Let the queries of a block meet the documents of a shard; how many (query, document) pairs were scored."""
    import numpy as np

    column = shard.columns(block)[shard.term]
    mine = np.flatnonzero(column >= 0)
    if not mine.size:
        return 0
    doc, column, tf = shard.doc[mine], column[mine], shard.tf[mine]
    m = 25 + (75 * shard.length * used) // max(1, total)
    vals = weights[column] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    tree = BallTree(np.append(first, len(doc)), column, vals, len(block.column), leaf, groups)
    bounds = tree.bounds(block.wanted)
    who = doc[first]
    scored = 0
    for k, (number, (at, times)) in enumerate(zip(block.numbers, block.wanted)):
        asked = np.zeros(len(block.column), np.int64)
        asked[at] = times
        mine_best = best[number]
        scored += tree.search(bounds[:, k].tolist(), asked,
                              lambda rows, s: mine_best.add([keys[i] for i in who[rows].tolist()], s), mine_best.limit)  # noqa: B023
    return scored


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = TOP, shard_bytes: int = SHARD_BYTES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per query the ``k`` documents of highest score above 0: item, rank, key, score.

    Equal scores are ranked by ascending key, null keys last. A null, empty or wordless text, of documents or
    queries, has no terms and is in no result. Repeated document rows are each ranked; wholly repeated query rows
    count once, several texts under one identifier are several queries. Long texts are read whole. An empty table on
    either side gives no rows. Only key and text are read, so further columns cannot clash.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    asked = settle(queries.select(named(item).alias("item"), named(item_text).alias("body")).filter("body IS NOT NULL").distinct()
                   .withColumn("number", F.monotonically_increasing_id()))
    # the driver holds the benchmark's questions; documents never come here
    blocks = blocks_of([(r["number"], r["body"]) for r in asked.orderBy("number").toLocalIterator()], block_terms)
    used, total, held = statistics(docs, text, blocks)
    context = spark.sparkContext
    shared = [context.broadcast((b, np.array([weight(held.get((n, c), 0), used) for c in range(len(b.column))], np.int64)))
              for n, b in enumerate(blocks)]
    numbers = [n for b in blocks for n in b.numbers]

    def run(batches):
        best = {n: Best(k) for n in numbers}
        for keys, texts in shards(batches, 1, shard_bytes):
            shard = Shard(texts)
            for block, weights in loaded(shared):
                search_shard(shard, keys, block, weights, used, total, best)
        rows = [(n, key_, s) for n, b in best.items() for s, key_ in b.rows]
        for low in range(0, len(rows), 10_000):
            part = rows[low:low + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], key_type),
                                              pa.array([r[2] for r in part], pa.int64())], ["number", "key", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(named(key).alias("key"), named(text).alias("body"))
    key_type = to_arrow_type(rows.schema["key"].dataType)
    found = rows.mapInArrow(run, f"number bigint, key {rows.schema['key'].dataType.simpleString()}, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("key")]
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for keys in (["number", "salt"], ["number"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return salted.join(asked.select("number", "item"), "number").select(
        F.col("item").alias(item), F.col("rank"), F.col("key").alias(key), F.col("score"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
t AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(w)) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT nn FROM g) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t GROUP BY term),
s AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN f USING (term), g GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
