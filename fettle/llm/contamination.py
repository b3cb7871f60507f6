"""Benchmark passages in training texts, found with an FM-index per shard.

A shard is a run of whole documents of one partition, about ``SHARD_BYTES`` of text, so
nothing is shuffled. Within a task the words of the shard become numbers (a dictionary,
so equality is exact), every document ends in a sign of its own, and the index is built:
suffix array, Burrows-Wheeler transform, wavelet tree with rank counts, and every
``SAMPLE``-th suffix position. All phrases of the benchmark are searched backwards at
once; occurrences are located by walking to the next sampled position, and the word
ranges are merged per document.

Phrases: every ten consecutive words of an item, or the whole item if it has fewer. They
reach the tasks in blocks of at most ``BLOCK_BYTES`` of item text (one item at least),
each of which a task loads, uses and lets go, so memory is bounded for any benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fettle.llm.rows import layout, named, packed, unpacked

WINDOW = 10
SHARD_BYTES = 3 << 20
BLOCK_BYTES = 2 << 20
SAMPLE = 32

#: bytes of words (digits, a-z after lowering, and all of other scripts) stay, the rest are spaces
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; null has none."""
    return text.encode().translate(_TABLE).split() if text else []


def suffix_array(s, bits: int):
    """Positions in the order of their suffixes, by prefix doubling on what is still tied.

    The last sign must occur once, and suffixes must differ before the end.
    """
    import numpy as np

    n, h = len(s), max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        if j < n:
            key[:n - j] |= s[j:]
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while slots.size:
        at = sa[slots]
        after = np.minimum(at + h, n - 1)
        key = rank[at] * (n + 1) + np.where(at + h < n, rank[after] + 1, 0)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.ones(len(at), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class Wavelet:
    """Wavelet tree (level by level) over numbers below 2**bits: symbol at, and rank before, a place."""

    def __init__(self, values, bits: int):
        import numpy as np

        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], ones)))
            chosen = bit.astype(bool)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate((values[~chosen], values[chosen]))

    def _ones(self, level: int, at):
        import numpy as np

        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & below)

    def rank(self, symbols, at):
        """How often each symbol occurs before its place."""
        import numpy as np

        low, high = np.zeros(len(at), np.int64), at.copy()
        for k in range(self.bits):
            one = ((symbols >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, high)
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def symbol(self, at):
        """The symbol at each place."""
        import numpy as np

        found = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            a = self._ones(k, at)
            one = self._ones(k, at + 1) > a
            found = (found << 1) | one
            at = np.where(one, self.zeros[k] + a, at - a)
        return found


class FMIndex:
    """Full-text index of a sequence whose suffixes all differ before its end."""

    def __init__(self, sequence, size: int):
        import numpy as np

        bits = max(1, int(size - 1).bit_length())
        sa = suffix_array(sequence, bits)
        self.n = len(sequence)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=size))))
        self.tree = Wavelet(sequence[sa - 1], bits)
        marked = sa % SAMPLE == 0
        self.sampled = np.zeros(self.n, bool)
        self.sampled[marked] = True
        self.upto = np.cumsum(marked)
        self.positions = sa[marked]

    def search(self, phrases, lengths):
        """Ranges of suffixes that begin with each phrase (rows of ``phrases``, filled from the left)."""
        import numpy as np

        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not live.size:
                break
            sign = phrases[live, lengths[live] - 1 - back]
            low[live] = self.first[sign] + self.tree.rank(sign, low[live])
            high[live] = self.first[sign] + self.tree.rank(sign, high[live])
        return low, high

    def locate(self, rows):
        """Text positions of suffixes: walk back until a sampled one."""
        import numpy as np

        rows, found = rows.copy(), np.zeros(len(rows), np.int64)
        live, steps = np.arange(len(rows)), 0
        while live.size:
            at = rows[live]
            done = self.sampled[at]
            found[live[done]] = self.positions[self.upto[at[done]] - 1] + steps
            live, at = live[~done], at[~done]
            sign = self.tree.symbol(at)
            rows[live] = self.first[sign] + self.tree.rank(sign, at)
            steps += 1
        return found


def phrases_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Phrase -> identifiers of the items that hold it."""
    found: dict[tuple[bytes, ...], dict[str, None]] = {}
    for name, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i:i + window]), {})[name] = None
    return {k: list(v) for k, v in found.items()}


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def search_shard(texts: list[str | None], blocks: Iterator[dict]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: number of words, merged hit ranges in words, items with an occurring phrase."""
    import numpy as np

    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    numbers, docs = _Numbers(), len(texts)
    flat = [numbers[x] for w in words for x in w] if docs else []
    del words
    size = docs + len(numbers)
    # every document is followed by a sign of its own, below all words
    sequence = np.empty(len(flat) + docs, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(sequence), bool)
    inner[ends] = False
    sequence[inner] = np.array(flat, np.int64) + docs
    sequence[ends] = np.arange(docs)
    del flat
    starts = ends - sizes
    hit = np.zeros(len(sequence) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    index = FMIndex(sequence, size) if len(sequence) > docs else None
    for block in blocks if index else ():
        known = [(p, names) for p, names in block.items() if all(w in numbers for w in p)]
        if not known:
            continue
        longest = max(len(p) for p, _ in known)
        table = np.array([[numbers[w] + docs for w in p] + [0] * (longest - len(p)) for p, _ in known], np.int64)
        lengths = np.array([len(p) for p, _ in known], np.int64)
        low, high = index.search(table, lengths)
        counts = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(known)), counts)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
        at = index.locate(rows)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + lengths[which], -1)
        owner = np.searchsorted(ends, at)
        for doc, k in np.unique(np.stack([owner, which], 1), axis=0).tolist() if len(at) else ():
            items[doc].update(known[k][1])
    covered = np.cumsum(hit)[:-1] > 0
    result = []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in edge.reshape(-1, 2).tolist():
        doc = int(np.searchsorted(ends, a))
        spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
    for k in range(docs):
        result.append((int(sizes[k]), spans[k], items[k]))
    return result


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the word ranges cut out, each replaced by one space."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out += [text[at:places[a][0]], " "]
        at = places[b - 1][1]
    return "".join(out) + text[at:]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """Broadcast phrase blocks; the driver holds one block at a time."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // block_bytes))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(phrases_of([(r["i"], r["t"]) for r in rows.filter(
        F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()])) for k in range(parts)]


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
                  cut: bool = False, columns: list[str] | None = None) -> DataFrame:
    """``row`` (``columns`` of ``docs``, by default all but the text) with ``words``, ``spans`` (merged hit ranges in words,
    array<struct<start, end>>), ``items`` (identifiers, array<string>) and ``clean``: with
    ``cut`` the text without the ranges, else null.

    A null or empty text, of documents or items, has no words and no hits; a null item
    identifier counts as ""; items repeated under one identifier count once; repeated
    rows are searched each; an empty table on either side gives no hits; the caller's
    columns stay in ``row``, so no name can clash.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    blocks = _blocks(benchmark, item, item_text, block_bytes)

    def phrases():
        for b in blocks:
            yield b.value
            if len(blocks) > 1:
                vars(b).pop("_value", None)  # one block in memory at a time

    def search(batches):
        rows: list = []
        size = 0

        def done():
            table = pa.Table.from_batches(rows)
            rows.clear()
            texts = table.column("body").to_pylist()
            found = search_shard(texts, phrases())
            cleaned = [without(t, s) if cut and s else t if cut else None for t, (_, s, _) in zip(texts, found)]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            out = pa.table({
                "row": table.column("row"), "words": pa.array([w for w, _, _ in found], pa.int64()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], span),
                "items": pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())),
                "clean": pa.array(cleaned, pa.string())})
            yield from out.to_batches(max_chunksize=2000)

        for batch in batches:
            first = 0
            for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                size += (n or 0) + 16
                if size >= shard_bytes:
                    rows.append(batch.slice(first, k + 1 - first))
                    yield from done()
                    first, size = k + 1, 0
            if first < batch.num_rows:
                rows.append(batch.slice(first))
        if rows:
            yield from done()

    rows = packed(docs, [c for c in docs.columns if c != text] if columns is None else columns, body=named(text))
    schema = layout(rows.select("row"), words="bigint", spans="array<struct<start:int,end:int>>",
                    items="array<string>", clean="string")
    return rows.mapInArrow(search, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the passages cut out of the texts; a document of which no word is left goes."""
    found = find_passages(docs, benchmark, text, cut=True, **options)
    kept = found.filter((F.size("spans") == 0) | (F.col("words") > _hit_words()))
    return unpacked(kept, docs.columns, {text: F.col("clean")})


def _hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the contract."""
    return found.select(
        F.col("row").getField(key).alias(key), F.col("words").alias("n_words"), _hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (_hit_words() > 0).alias("contaminated"))
