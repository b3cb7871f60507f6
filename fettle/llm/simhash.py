"""SimHash fingerprints linked through vantage-point trees.

Fingerprint. Words are what lies between ASCII white space after lowering A-Z; shingles of
``words`` words are hashed with XXH64 (seed 42); a bit is set if it is set in over half of
the hashes. Further lanes of 64 bits come from the same hashes, remixed.

Partition. Equal fingerprints are one node. A vantage-point tree over a bounded sample
cuts the space of fingerprints: each tree node keeps what lies within the median Hamming
distance of its vantage point apart from the rest. A node lives in one leaf (shard) and
visits the leaves that its ball of the radius touches, by the triangle bounds, so pairs
across shard borders are met. Where sizes bound the similarity (``least_size``), rings of
size are the first cut: the distance from the empty text.

Search. A shard is cut by a hash into chunks of about ``BLOCK`` nodes and searched by
pairs of chunks; a shard of any size, even one dense group, only has more blocks. Inside a block a
vantage-point tree prunes again, leaves are compared in full, and links are folded into a
spanning forest as they are found, so a block returns fewer edges than it has nodes,
never all pairs of a group. Components of these edges are the groups.

The sample only decides how well the tree is balanced: every node is indexed, queried
and compared exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fettle.llm.components import components
from fettle.llm.rows import layout, named, packed, unpacked
from fettle.operators.spread import settle

SEED = 42
SAMPLE = 4096
SHARD = 30_000
BLOCK = 128_000
LEAF = 1 << 20  # pairs compared at once
GROUP_BYTES = 16 << 20  # hashes of candidates compared in one task


def shingle_hashes(text: str | None, words: int) -> bytes:
    """Big-endian XXH64 of every shingle, repeats included; fewer words give one shingle, none none."""
    from xxhash import xxh64_digest

    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return b""
    if len(tokens) <= words:
        return xxh64_digest(b" ".join(tokens), SEED)
    return b"".join([xxh64_digest(s, SEED) for s in map(b" ".join, zip(*(tokens[i:] for i in range(words))))])


def majority(hashes, sizes):
    """Per text the bits set in over half of its hashes; ``sizes`` are all positive.

    Eight bits are counted at once in the bytes of a word, 255 hashes at a time.
    """
    import numpy as np

    starts = np.cumsum(sizes) - sizes
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    out = np.zeros(len(sizes), np.uint64)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(sums, first, axis=0)
        for byte in range(8):
            chosen = (counts[:, byte] * 2 > sizes).astype(np.uint64)
            out |= chosen << np.uint64(8 * byte + bit)
    return out


def remixed(hashes, lane: int):
    """Another 64 bits from the same hashes; lane 0 is the hash itself."""
    import numpy as np

    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2 ** 64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(texts: list[str | None], words: int, lanes: int = 1):
    """(fingerprints [texts x lanes] as unsigned numbers, numbers of shingles)."""
    import numpy as np

    out, sizes = np.zeros((len(texts), lanes), np.uint64), np.zeros(len(texts), np.int64)
    held, held_rows, total = [], [], 0

    def flush():
        hashes = np.frombuffer(b"".join(held), ">u8").astype(np.uint64)
        rows = np.array(held_rows, np.int64)
        for lane in range(lanes):
            out[rows, lane] = majority(remixed(hashes, lane), sizes[rows])
        held.clear()
        held_rows.clear()

    for i, text in enumerate(texts):
        digest = shingle_hashes(text, words)
        if digest:
            sizes[i] = len(digest) // 8
            held.append(digest)
            held_rows.append(i)
            total += len(digest)
            if total > 1 << 20:
                flush()
                total = 0
    if held:
        flush()
    return out, sizes


def fingerprint(rows: DataFrame, words: int, lanes: int = 1, returned: int = 1) -> DataFrame:
    """``rows`` (``row``, ``body``) with ``lanes`` array<long> and ``size``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            prints, sizes = fingerprints_of(batch.column(1).to_pylist(), words, lanes)
            flat = pa.array(prints.view("int64").reshape(-1))
            listed = pa.FixedSizeListArray.from_arrays(flat, lanes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:returned], listed, pa.array(sizes)], ["row", "body"][:returned] + ["lanes", "size"])

    return rows.select("row", "body").mapInArrow(
        run, layout(rows.select(*["row", "body"][:returned]), lanes="array<bigint>", size="bigint"))


# -- the tree that cuts the space ------------------------------------------------------

def vantage_tree(sample, depth: int):
    """Nested (vantage point, median distance, inside, outside); a leaf is its number."""
    import numpy as np

    numbers = iter(range(1 << 30))

    def grow(points, left: int):
        if left and len(points) >= 16:
            point = points[len(points) // 2]
            far = np.bitwise_count(points ^ point)
            middle = int(np.median(far))
            if (far <= middle).all():
                middle -= 1
            inside = far <= middle
            if inside.any() and not inside.all():
                return (int(point), middle, grow(points[inside], left - 1), grow(points[~inside], left - 1))
        return next(numbers)

    return grow(sample, depth)


def route(tree, points, radius: int):
    """(point number, leaf, visiting) for every leaf a point is met in.

    A point lives in one leaf. At each cut those that live outside also visit the inside
    if it lies within the radius, not the other way round: of a pair across the cut one
    visit is enough. Visitors go wherever the triangle bounds allow.
    """
    import numpy as np

    found, stack = [], [(tree, np.arange(len(points)), np.arange(0))]
    while stack:
        node, lives, visits = stack.pop()
        if not isinstance(node, tuple):
            at = np.concatenate((lives, visits))
            found.append((at, np.full(len(at), node, np.int64), np.arange(len(at)) >= len(lives)))
            continue
        point, middle, inside, outside = node
        far = np.bitwise_count(points[lives] ^ np.uint64(point)).astype(np.int64)
        far_v = np.bitwise_count(points[visits] ^ np.uint64(point)).astype(np.int64)
        crossing = lives[(far > middle) & (far - radius <= middle)]
        stack.append((inside, lives[far <= middle], np.concatenate((visits[far_v - radius <= middle], crossing))))
        stack.append((outside, lives[far > middle], visits[far_v + radius > middle]))
    return tuple(np.concatenate(x) for x in zip(*found))


# -- search of a block -----------------------------------------------------------------

class Forest:
    """Links folded into labels: the smallest member of each group, all members at once."""

    def __init__(self, n: int):
        import numpy as np

        self.label = np.arange(n)

    def one(self, a, b) -> bool:
        """True if all of both are one group already."""
        first, second = self.label[a], self.label[b]
        return bool(first[0] == second[0] and (first == first[0]).all() and (second == first[0]).all())

    def join(self, a, b) -> None:
        import numpy as np

        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def search_block(points, at, lives, visits, radius: int, forest: Forest, close, own: bool = True) -> None:
    """Joins what lies within ``radius`` and passes ``close``: pairs of ``lives`` with ``visits`` and, if ``own``, among themselves.

    ``at`` gives the forest's number of each point. The tree is cut at the median distance
    from a vantage point while that saves comparisons.
    """
    import numpy as np

    def compare(i, q):
        if not len(i) or not len(q):
            return
        step = max(1, LEAF // len(i))
        inner = points[i][None, :]
        for k in range(0, len(q), step):
            part = q[k:k + step]
            if forest.one(at[i], at[part]):  # a dense group is soon one
                continue
            x, y = np.nonzero(np.bitwise_count(inner ^ points[part][:, None]) <= radius)
            if len(x):
                a, b = i[y], part[x]
                held = close(a, b)
                forest.join(at[a[held]], at[b[held]])

    def leaf(r, v):
        compare(r, v)
        if own:
            step = max(1, LEAF // max(1, len(r)))
            for k in range(0, len(r), step):
                compare(r[:k + step], r[k:k + step])

    stack = [(lives, visits)]
    while stack:
        r, v = stack.pop()
        if not len(r) or not own and not len(v):
            continue
        if len(r) * (len(r) + len(v)) <= LEAF:
            leaf(r, v)
            continue
        point = points[r[len(r) // 2]]
        far, far_v = np.bitwise_count(points[r] ^ point).astype(np.int64), np.bitwise_count(points[v] ^ point).astype(np.int64)
        middle = int(np.median(far))
        inside = far <= middle
        crossing = r[~inside & (far - radius <= middle)] if own else r[:0]
        near, away = np.concatenate((v[far_v - radius <= middle], crossing)), v[far_v + radius > middle]
        n, m = int(inside.sum()), int((~inside).sum())
        whole = len(r) * len(v) + own * len(r) ** 2 / 2
        if not m or n * len(near) + m * len(away) + own * (n * n + m * m) / 2 > 0.95 * whole:  # nothing to prune here
            leaf(r, v)
            continue
        stack += [(r[inside], near), (r[~inside], away)]


# -- linking ---------------------------------------------------------------------------

def link(nodes: DataFrame, radius: int, lanes: int = 1, total: int | None = None, least_size: float | None = None) -> DataFrame:
    """Edges ``a``, ``b`` (a spanning forest per block) between nodes that are close.

    ``nodes``: ``node`` long, ``lanes``, ``size``, each node once. Close: at most
    ``radius`` differing bits in the first lane, at most ``total`` over all lanes, and the
    smaller size at least ``least_size`` of the larger.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    count = nodes.count()
    depth = 0 if least_size else max(0, math.ceil(math.log2(max(1, count) / SHARD)))
    first = F.element_at("lanes", 1)
    points = [] if not depth else [r[0] for r in nodes.select(first.alias("p")).orderBy(F.xxhash64("p"), "p").limit(SAMPLE).collect()]
    tree = vantage_tree(np.array(points, np.int64).view(np.uint64), depth) if depth else 0
    ring = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(math.log(1 / least_size))) if least_size else F.lit(0)

    def routed(batches):
        for batch in batches:
            who, leaf, visiting = route(tree, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), radius)
            yield batch.take(pa.array(who)).append_column("leaf", pa.array(leaf)).append_column("visits", pa.array(visiting))

    base = nodes.select("node", first.alias("point"), "lanes", "size", ring.cast("long").alias("ring"))
    if depth:
        spread = base.mapInArrow(routed, layout(base, leaf="bigint", visits="boolean"))
    else:
        spread = base.withColumn("leaf", F.lit(0).cast("long")).withColumn("visits", F.lit(False))
    if least_size:  # a pair within the size bound lies in one ring or two neighbouring ones: the lower one visits
        places = F.array(*[F.struct((F.col("ring") + k).alias("ring"), F.lit(bool(k)).alias("visits")) for k in (0, 1)])
        spread = spread.drop("visits").withColumn("place", F.explode(places)).withColumns(
            {"ring": F.col("place.ring"), "visits": F.col("place.visits")}).drop("place")
    spread = settle(spread.drop("point"))
    counts = settle(spread.groupBy("ring", "leaf").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("chunks"), F.count_if(~F.col("visits")).alias("lives"))
        .filter("lives > 0").select("ring", "leaf", "chunks"))
    # a shard in chunks: every pair of chunks is a block
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(
        F.least(c, F.col("chunk")).alias("i"), F.greatest(c, F.col("chunk")).alias("j")))
    blocks = (spread.join(counts, ["ring", "leaf"]).withColumn("chunk", own).withColumn("pair", F.explode(pairs))
              .select("ring", "leaf", "pair.i", "pair.j", "chunk", "visits", "node", "lanes", "size"))

    def searched(table):
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        chunk = table.column("chunk").to_numpy()
        visits = np.asarray(table.column("visits").to_numpy(zero_copy_only=False)).astype(bool)
        node, size = table.column("node").to_numpy(), table.column("size").to_numpy()
        prints = pc.list_flatten(table.column("lanes")).to_numpy().reshape(-1, lanes).view(np.uint64)
        names, at = np.unique(node, return_inverse=True)
        forest = Forest(len(names))

        def close(a, b):
            ok = np.ones(len(a), bool)
            if lanes > 1:
                ok &= np.bitwise_count(prints[a] ^ prints[b]).sum(1, dtype=np.int64) <= total
            if least_size:
                ok &= np.minimum(size[a], size[b]) >= least_size * np.maximum(size[a], size[b])
            return ok

        one, other = chunk == i, chunk == j
        first_lane = np.ascontiguousarray(prints[:, 0])
        if i == j:
            search_block(first_lane, at, np.flatnonzero(~visits), np.flatnonzero(visits), radius, forest, close)
        else:
            search_block(first_lane, at, np.flatnonzero(one & ~visits), np.flatnonzero(other), radius, forest, close, own=False)
            search_block(first_lane, at, np.flatnonzero(other & ~visits), np.flatnonzero(one & visits), radius, forest, close, own=False)
        linked = forest.label != np.arange(len(names))
        return pa.table({"a": names[linked], "b": names[forest.label[linked]]})

    return blocks.groupBy("ring", "leaf", "i", "j").applyInArrow(searched, "a bigint, b bigint")


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (16 hex digits), ``component_id``.

    The component is the smallest non-null key reachable over links of at most ``radius``
    bits, null if there is none. Null, empty and white texts have fingerprint zero and
    link like any other; repeated rows share their component; an empty table gives an
    empty result; other columns are not read.
    """
    body = docs.select(F.struct(named(key).alias("key")).alias("row"), named(text).alias("body"))
    prints = settle(fingerprint(body, words).select(F.col("row.key").alias("key"), F.element_at("lanes", 1).alias("node"), "size"))
    nodes = settle(prints.groupBy("node").agg(F.min("key").alias("least"), F.max("size").alias("size")))
    found = components(settle(link(nodes.select("node", F.array("node").alias("lanes"), "size"), radius)))
    members = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = settle(members.select("node", "root").join(groups, "root").select("node", "component_id"))
    return prints.join(classes, "node").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


# -- near copies with an exact check -----------------------------------------------------

def distinct_hashes(text: str | None, words: int) -> bytes:
    """The shingle hashes of a text as a set: big-endian, ascending, each once."""
    digest = shingle_hashes(text, words)
    return b"".join(sorted({digest[i:i + 8] for i in range(0, len(digest), 8)}))


def set_fingerprint(rows: DataFrame, words: int, lanes: int) -> DataFrame:
    """``rows`` (``row``, ``body``) with ``lanes``, ``size`` and ``node`` (hash) of the set of shingles."""
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    def run(batches):
        for batch in batches:
            sets = [distinct_hashes(t, words) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) // 8 for x in sets], np.int64)
            nodes = np.array([xxh64_intdigest(x, SEED) for x in sets], np.uint64).view(np.int64)
            prints = np.zeros((len(sets), lanes), np.uint64)
            held = np.flatnonzero(sizes)
            for part in np.split(held, np.flatnonzero(np.diff(np.cumsum(sizes[held]) // (1 << 17))) + 1) if len(held) else []:
                hashes = np.frombuffer(b"".join([sets[k] for k in part]), ">u8").astype(np.uint64)
                for lane in range(lanes):
                    prints[part, lane] = majority(remixed(hashes, lane), sizes[part])
            listed = pa.FixedSizeListArray.from_arrays(pa.array(prints.view("int64").reshape(-1)), lanes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, pa.array(sizes), pa.array(nodes)], ["row", "body", "lanes", "size", "node"])

    return rows.select("row", "body").mapInArrow(
        run, layout(rows.select("row", "body"), lanes="array<bigint>", size="bigint", node="bigint"))


class Sets:
    """Sets of hashes side by side, renumbered so that one mask over all numbers can be looked up."""

    def __init__(self, blobs):
        import numpy as np

        self.sizes = np.array([len(x) // 8 for x in blobs], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        names, self.ids = np.unique(np.frombuffer(b"".join(blobs), ">u8").astype(np.uint64), return_inverse=True)
        self.mask = np.zeros(len(names), bool)

    def shared(self, a, b):
        """How many hashes each pair of sets has in common; no set is empty."""
        import numpy as np

        out = np.zeros(len(a), np.int64)
        if len(np.unique(a)) < len(np.unique(b)):
            a, b = b, a
        order = np.argsort(b, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(order) else []:
            mine = self.ids[self.starts[b[at[0]]]:][:self.sizes[b[at[0]]]]
            self.mask[mine] = True
            for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(self.sizes[a[at]]) // LEAF)) + 1):
                n = self.sizes[a[part]]
                first = np.cumsum(n) - n
                where = np.repeat(self.starts[a[part]] - first, n) + np.arange(n.sum())
                out[part] = np.add.reduceat(self.mask[self.ids[where]].astype(np.int64), first)
            self.mask[mine] = False
        return out

    def alike(self, a, b, similarity: float):
        """Whether the Jaccard similarity of each pair is at least ``similarity``."""
        both = self.shared(a, b)
        return both >= similarity * (self.sizes[a] + self.sizes[b] - both) - 1e-9


def confirm(members: DataFrame, sets: DataFrame, radius: int, lanes: int, total: int, similarity: float) -> DataFrame:
    """Edges ``a``, ``b`` that join all nodes of a group which exact similarity links.

    ``members``: ``root`` (group of candidates) and ``size`` of every node; ``sets``:
    ``node``, ``root``, ``lanes``, ``size``, ``hashes`` (``distinct_hashes``). Groups are packed into buckets of about ``GROUP_BYTES``; a
    larger group is cut by a hash into chunks of that size and searched by pairs of
    chunks. Candidates are found as in ``link``; of those in different parts of the forest
    each is compared as a set before it may join them, so a group of true copies takes
    about one comparison a node, and one that a refusal splits is searched to the end.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    weight = F.sum(F.col("size") * 8 + 128)
    whole = members.agg(weight.alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(whole / GROUP_BYTES))
    wide = (members.groupBy("root").agg(F.ceil(weight / GROUP_BYTES).cast("int").alias("chunks"))
            .filter("chunks > 1"))
    chunk = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda c: F.struct(
        F.least(c, F.col("chunk")).alias("i"), F.greatest(c, F.col("chunk")).alias("j")))
    bucket = F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("root"), F.lit(buckets)))
    alone = F.when(F.col("chunks").isNotNull(), F.col("root"))
    blocks = (sets.join(settle(wide), "root", "left").withColumn("chunk", chunk).withColumn("pair", F.explode(pairs))
              .select(bucket.alias("bucket"), alone.alias("alone"), "pair.i", "pair.j", "chunk", "root", "node", "lanes", "size", "hashes"))

    def searched(table):
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.take(pc.sort_indices(table.select(["root", "node"]), sort_keys=[("root", "ascending"), ("node", "ascending")]))
        root, node = table.column("root").to_numpy(), table.column("node").to_numpy()
        chunk, size = table.column("chunk").to_numpy(), table.column("size").to_numpy()
        prints = pc.list_flatten(table.column("lanes")).to_numpy().reshape(-1, lanes).view(np.uint64)
        sets = Sets(table.column("hashes").to_pylist())
        forest = Forest(len(node))
        first_lane = np.ascontiguousarray(prints[:, 0])

        def close(a, b):
            """Joins what is alike itself, so it need not look at pairs that others have joined."""
            ok = np.bitwise_count(prints[a] ^ prints[b]).sum(1, dtype=np.int64) <= total
            ok &= np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
            ok &= (a != b) & (size[a] > 0)
            order = np.argsort(a[ok], kind="stable")
            x, y, quota = a[ok][order], b[ok][order], 1
            while len(x):
                apart = forest.label[x] != forest.label[y]
                x, y = x[apart], y[apart]
                turn = np.arange(len(x)) - np.searchsorted(x, x)  # x is sorted: how many pairs of this set come before
                now = turn < quota
                held = sets.alike(x[now], y[now], similarity)
                forest.join(x[now][held], y[now][held])
                x, y, quota = x[~now], y[~now], 2 * quota
            return np.zeros(len(a), bool)

        at, none = np.arange(len(node)), np.arange(0)
        for part in np.split(at, np.flatnonzero(np.diff(root)) + 1):
            if i == j:
                search_block(first_lane, at, part, none, radius, forest, close)
            else:
                search_block(first_lane, at, part[chunk[part] == i], part[chunk[part] == j], radius, forest, close, own=False)
        linked = forest.label != at
        return pa.table({"a": node[linked], "b": node[forest.label[linked]]})

    return blocks.groupBy("bucket", "alone", "i", "j").applyInArrow(searched, "a bigint, b bigint")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, lanes: int = 4,
                radius: int = 18, total: int = 58, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest key, nulls last.

    Groups are the components of all pairs whose sets of ``words``-word shingles have a
    Jaccard similarity of at least ``similarity``, each compared exactly; the fingerprints
    of the sets (64 bits a lane) only find the candidates. Two sets at 0.8 differ in 39 of
    256 bits on average (cosine 2J / (1 + J), angle over pi) with a deviation of six, so
    ``total`` leaves a margin of three deviations, and ``radius`` the same for the first
    lane; sets of less than ten shingles differ more and keep a smaller one. A pair whose
    only path leads over a candidate beyond these bounds is not found. Equal sets are one
    node and known by a 64-bit hash of the set. Null, empty and white texts have the empty
    set and are equal to each other, very long texts are ordinary, repeated rows leave one
    row. Rows keep all their columns; names cannot clash, as they travel inside one
    struct. An empty table gives an empty result.
    """
    import pyarrow as pa

    packing = packed(docs, [c for c in docs.columns if c != text], body=named(text))
    rows = settle(set_fingerprint(packing, words, lanes).withColumn("id", F.monotonically_increasing_id()))
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "id")
    nodes = settle(rows.select("id", F.col("row").getField(key).alias("key"), "lanes", "size", "node").groupBy("node").agg(
        F.first("lanes").alias("lanes"), F.first("size").alias("size"), F.min(rank).alias("least")))
    candidates = components(settle(link(nodes.select("node", "lanes", "size"), radius, lanes, total, similarity)))
    members = settle(nodes.join(candidates, "node").select("node", "root", "lanes", "size", F.col("least.id").alias("id")))

    def hashed(batches):
        for batch in batches:
            sets = pa.array([distinct_hashes(t, words) for t in batch.column("body").to_pylist()], pa.binary())
            yield batch.drop_columns(["body"]).append_column("hashes", sets)

    # by shuffle at every size: the lists of members and of kept rows grow with the table
    texts = rows.select("id", "body").join(members.hint("merge"), "id").select("node", "root", "lanes", "size", "body")
    sets = texts.mapInArrow(hashed, layout(texts.drop("body"), hashes="binary"))
    found = components(settle(confirm(members, sets, radius, lanes, total, similarity)))
    groups = nodes.select("node", "least").join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    kept = settle(groups.select(F.col("least.id").alias("id")))
    return unpacked(rows.join(kept.hint("merge"), "id", "left_semi"), docs.columns, {text: F.col("body")})
