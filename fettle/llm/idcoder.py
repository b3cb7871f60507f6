"""Token ids in a compressed file format: context mixing drives a range coder in blocks.

Documents are put in order of their keys by a range shuffle, tokenised where they land and
cut into frames of whole documents. A frame is a row of a Parquet table: keys and numbers
of ids of its documents, and blocks of ``BLOCK_IDS`` ids, each coded from a fresh model and
with a checksum (CRC-32 of its ids), so every block can be read alone and damage is found
where it is.

Model of a block. Orders 2 and 1 each predict an id: the one that last followed the same
two ids, or one id, with a confidence. Whether the predicted id comes is coded by a
probability mixed in the logistic domain from the adaptive probabilities of all three
orders (how often confidences like these were right, how often this id was right when
predicted); the weights are learned as coding goes on. The candidate is that of order 2, or
of order 1 where order 2 has none. Order 0 counts the ids of the block that were not
predicted; the block ends with those counts, and such an id is coded by them, in one step.
A block is the words of the range coder, the counts and how many bytes they take.
All arithmetic is in whole numbers, so any machine decodes what another one wrote.

The blocks of a task are coded side by side, one id of every block at a time: a step is
some 70 array operations over all blocks and no loop, for coding and decoding alike.
"""

from __future__ import annotations

import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fettle.llm.rows import named

BLOCK_IDS = 4_096
FRAME_IDS = 16 * BLOCK_IDS
LANES = 2_048  # blocks coded side by side
END = 2
BATCH_BYTES = 1 << 20  # text handed to the tokenizer at a time
KNOWN_WORDS = 1 << 19  # words whose ids a worker keeps at hand
_SLOTS = 11  # bits of the tables of predicted ids
_MOST = 1 << 17  # counts of a block together, so that no id's part of a range is empty
_FULL, _LEAST = (1 << 62) - 1, 1 << 30


def _tables():
    """Stretch and squash between probabilities of 12 bits and the logistic domain (256 to a unit)."""
    import numpy as np

    squash = np.floor(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256)) + 0.5).clip(1, 4095).astype(np.int32)
    p = (np.arange(4096) + 0.5) / 4096
    return np.floor(np.log(p / (1 - p)) * 256 + 0.5).clip(-2047, 2047).astype(np.int32), squash


class Mix:
    """Adaptive probabilities by input and context, mixed by learned weights, one set for each lane."""

    def __init__(self, lanes: int, sizes: list[int]):
        import numpy as np

        self.stretch, self.squash = _tables()
        offset = np.cumsum([0, *sizes[:-1]])[:, None]
        self.base = offset + np.arange(lanes) * sum(sizes)
        self.p = np.full(lanes * sum(sizes), 1 << 15, np.int32)
        self.w = np.full((len(sizes), lanes), (1 << 16) * 2 // (len(sizes) + 1), np.int32)
        self.steps = 0

    def predict(self, contexts):
        """Probability of yes (16 bits) for the first lanes; ``contexts`` by input and lane."""
        a = contexts.shape[1]
        self.at = contexts
        self.at += self.base[:, :a]
        self.held = self.p.take(self.at)
        self.st = self.stretch.take(self.held >> 4)
        part = self.w[:, :a] * self.st
        part >>= 8
        dot = part[0]
        for more in part[1:]:
            dot += more
        dot >>= 8
        dot += 2048
        self.mixed = self.squash.take(dot, mode="clip")
        return self.mixed << 4

    def update(self, yes) -> None:
        """Learn from the answers."""
        wrong = yes << 12
        wrong -= self.mixed
        wrong *= 6
        w = self.w[:, :len(yes)]
        learned = self.st * wrong
        learned += 1 << 9
        learned >>= 10
        w += learned
        self.steps += 1
        if self.steps % 4 == 0:  # a step moves a weight by less than 50,000, so that no product leaves 32 bits
            w.clip(-(1 << 19), 1 << 19, out=w)
        away = yes * 65_535 - self.held
        away >>= 4
        away += self.held
        self.p[self.at] = away


class Heads:
    """Order 0 of several blocks: how often each block holds an id that was not predicted, and where it lies among them."""

    def __init__(self, heads: list[tuple]):
        import numpy as np

        sizes = [len(ids) for ids, _ in heads]
        self.ids = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in heads)]).astype(np.int32)
        self.own = np.concatenate([np.zeros(0, np.int64), *(own for _, own in heads)])
        totals = np.array([int(own.sum()) for _, own in heads], np.int64)
        self.base, self.total = np.cumsum(totals) - totals, totals
        self.before = np.cumsum(self.own) - self.own - np.repeat(self.base, sizes)
        self.at = np.cumsum(sizes, dtype=np.int64) - sizes

    @staticmethod
    def counted(ids) -> tuple:
        """The distinct ids in order, their counts, and the number of each id among them; of no ids, id 0 once."""
        import numpy as np

        if not len(ids):
            return np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(0, np.int64)
        found, number, own = np.unique(ids, return_inverse=True, return_counts=True)
        while own.sum() > _MOST:
            own = (own + 1) >> 1
        return found, own, number

    @staticmethod
    def packed(ids, own) -> bytes:
        """Gaps between the ids and counts, byte by byte, deflated."""
        import numpy as np

        gaps = np.diff(ids, prepend=0)
        planes = np.stack([gaps & 255, gaps >> 8, own & 255, own >> 8 & 255, own >> 16]).astype(np.uint8)
        return zlib.compress(planes.tobytes(), 6, -15)

    @staticmethod
    def opened(head: bytes) -> tuple:
        """The counterpart of ``packed``; what is no head (the block's checksum will not hold) counts nothing but id 0."""
        import numpy as np

        try:
            planes = zlib.decompressobj(-15).decompress(head, 5 * 65_536)
        except zlib.error:
            planes = b""
        n = len(planes) // 5
        rows = np.frombuffer(planes, np.uint8, 5 * n).reshape(5, n).astype(np.int64)
        ids, own = np.cumsum(rows[0] + (rows[1] << 8)), rows[2] + (rows[3] << 8) + (rows[4] << 16)
        if not n or ids[-1] > 65_535 or own.min() < 1 or own.sum() > _MOST:
            return np.zeros(1, np.int64), np.ones(1, np.int64)
        return ids, own


class Encoder:
    """Range coders of several blocks: 62 bits of low and range, words of 32 bits out, carries settled at the end."""

    def __init__(self, lanes: int):
        import numpy as np

        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, _FULL, np.int64)
        self.words, self.at = np.zeros(64 * lanes, np.int64), np.arange(lanes)  # each lane's next word

    def room(self, words: int) -> None:
        """Make sure that each lane can take so many more words."""
        import numpy as np

        more = int(self.at.max(initial=0)) + words * len(self.low) - len(self.words)
        if more > 0:
            rows = more // len(self.low) + 1 + len(self.words) // len(self.low) // 2
            self.words = np.concatenate((self.words, np.zeros(rows * len(self.low), np.int64)))

    def code(self, p, yes, before, own, total) -> None:
        """Code yes by its probability, or no and a symbol."""
        import numpy as np

        low, whole, at = self.low[:len(p)], self.range[:len(p)], self.at[:len(p)]
        cut = whole >> 16
        cut *= p
        step = whole - cut
        step //= total
        low += np.where(yes, 0, step * before + cut)
        now = np.where(yes, cut, step * own)
        # every lane writes its next word; it stays where the range has become short. Carries are its 33rd bit
        self.words[at] = low >> 30
        short = now < _LEAST
        at += short * len(self.low)
        shift = short * 32
        low -= (low >> 30 << 30) * short
        low <<= shift
        np.left_shift(now, shift, out=whole)

    def done(self) -> list[bytes]:
        """The bytes of each lane: one more word settles the value, zeros may follow."""
        self.room(1)
        lanes = len(self.low)
        self.words[self.at] = (self.low + ((1 << 30) - 1)) >> 30
        words, used = self.words.reshape(-1, lanes), self.at // lanes
        for k in range(len(words) - 1, 0, -1):
            words[k - 1] += words[k] >> 32
        return [(words[:used[i] + 1, i] & 0xFFFFFFFF).astype(">u4").tobytes() for i in range(lanes)]


class Decoder:
    """The counterpart of ``Encoder``."""

    def __init__(self, blocks: list[bytes], heads: Heads):
        import numpy as np

        words = np.zeros((max((len(b) for b in blocks), default=0) // 4 + 3, len(blocks)), np.int64)
        for i, b in enumerate(blocks):
            words[:len(b) // 4, i] = np.frombuffer(b, ">u4", len(b) // 4)
        self.left = (words[0] << 30) | (words[1] >> 2)
        # the next 32 bits of a lane begin with the last two of the word begun
        self.more = ((words[1:-1] & 3) << 30 | words[2:] >> 2).ravel()
        self.range, self.at = np.full(len(blocks), _FULL, np.int64), np.arange(len(blocks))
        self.heads, self.most = heads, heads.total - 1
        self.slots = np.repeat(np.arange(len(heads.own), dtype=np.int32), heads.own)

    def code(self, p, who):
        """Whether yes comes in each lane, and the id: that of ``who`` with yes, else that of the symbol."""
        import numpy as np

        a, heads = len(p), self.heads
        left, whole, next_ = self.left[:a], self.range[:a], self.at[:a]
        cut = whole >> 16
        cut *= p
        rest = left - cut
        yes = rest < 0
        step = whole - cut
        step //= heads.total[:a]
        slot = rest // step  # of no use with yes
        np.minimum(slot, self.most[:a], out=slot)
        slot += heads.base[:a]
        at = self.slots.take(slot, mode="clip")
        ids = np.where(yes, who, heads.ids.take(at))
        rest -= step * heads.before.take(at)
        now = np.where(yes, cut, step * heads.own.take(at))
        short = now < _LEAST
        shift = short * 32
        np.left_shift(np.where(yes, left, rest), shift, out=left)
        left |= self.more.take(next_, mode="clip") * short
        next_ += short * len(self.left)
        np.left_shift(now, shift, out=whole)
        return yes, ids


class Model:
    """The models of several blocks: the candidate for each next id and the probability that it comes."""

    def __init__(self, lanes: int):
        import numpy as np

        # orders 1 and 2: predicted id and confidence, 0 for none
        self.table = np.zeros(lanes << (_SLOTS + 1), np.int32)
        self.base = (np.arange(lanes) << (_SLOTS + 1)) + np.array([[0], [1 << _SLOTS]])
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.factors = np.array([[0x9E3779B1], [0x85EBCA6B]])
        self.right = Mix(lanes, [128, 16, 512])
        # what a confidence becomes when its id does not come (a new id takes the place of 0 and 1), and when it does
        self.change = np.array([0, 0, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], np.int32)

    def ask(self, active: int):
        """The candidates of the first ``active`` lanes and their probabilities; id 0 where nothing is predicted."""
        import numpy as np

        at = self.last[:active] * self.factors
        at[1] += self.before[:active]
        at >>= 15
        at &= (1 << _SLOTS) - 1
        at += self.base[:, :active]
        held = self.table.take(at)
        told, sure = held >> 3, held & 7
        # the candidate: of order 2 if it has one, else of order 1
        who = np.where(sure[1], told[1], told[0])
        contexts = np.empty((3, active), np.int64)
        one = sure[0] * 2
        one += told[0] == told[1]
        contexts[1] = one
        one += sure[1] * 16
        contexts[0] = one
        contexts[2] = who & 511
        self.at, self.held, self.told, self.sure = at, held, told, sure
        return who, self.right.predict(contexts)

    def learn(self, ids, yes) -> None:
        """Learn the ids that came and whether they were the candidates."""
        import numpy as np

        self.right.update(yes.astype(np.int32))
        kind = (self.told == ids) * np.int32(8)
        kind += self.sure
        new = ids << 3
        new |= 1
        held = self.held + self.change.take(kind)
        self.table[self.at] = np.where(kind < 2, new, held)
        last = self.last[:len(ids)]
        np.multiply(last, 0xC2B2AE35, out=self.before[:len(ids)])
        last[:] = ids


def _active(lengths: list[int]) -> list[int]:
    """How many blocks, longest first, have an id at each step."""
    import numpy as np

    sizes = np.array(lengths, np.int64)
    return (len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes.max(initial=0)), side="right")).tolist()


def _encode(blocks: list) -> list[bytes]:
    """Code blocks, longest first, side by side: the models run first, then the counts are known, then words are put out."""
    import numpy as np

    lengths = [len(b) for b in blocks]
    active, lanes = _active(lengths), len(blocks)
    ids = np.zeros((len(active), lanes), np.int32)
    for k, b in enumerate(blocks):
        ids[:lengths[k], k] = b
    p, yes = np.zeros(ids.shape, np.int32), np.zeros(ids.shape, bool)
    model = Model(lanes)
    for t, a in enumerate(active):
        who, p[t, :a] = model.ask(a)
        np.equal(ids[t, :a], who, out=yes[t, :a])
        model.learn(ids[t, :a], yes[t, :a])
    # order 0: the symbol of an id that did not come as predicted is its number among those of the block
    heads, number = [], np.zeros(ids.shape, np.int32)
    for k, n in enumerate(lengths):
        missed = np.flatnonzero(~yes[:n, k])
        *head, number[missed, k] = Heads.counted(ids[missed, k])
        heads.append(tuple(head))
    known, coder = Heads(heads), Encoder(lanes)
    for t, a in enumerate(active):
        if t % 64 == 0:
            coder.room(64 + 4)
            at = number[t:t + 64] + known.at
            before, own = known.before.take(at, mode="clip"), known.own.take(at, mode="clip")
        coder.code(p[t, :a], yes[t, :a], before[t % 64, :a], own[t % 64, :a], known.total[:a])
    out = []
    for n, head, words in zip(lengths, heads, coder.done()):
        packed = Heads.packed(*head) if n else b""
        out.append(words + packed + len(packed).to_bytes(4, "big") if n else b"")
    return out


def _decode(blocks: list[bytes], lengths: list[int]):
    """The ids of blocks, longest first, by step and block."""
    import numpy as np

    active, lanes = _active(lengths), len(blocks)
    cut = [max(len(b) - 4 - int.from_bytes(b[-4:], "big"), 0) for b in blocks]
    coder = Decoder([b[:c] for b, c in zip(blocks, cut)], Heads([Heads.opened(b[c:-4]) for b, c in zip(blocks, cut)]))
    model, out = Model(lanes), np.zeros((len(active), lanes), np.int32)
    for t, a in enumerate(active):
        who, p = model.ask(a)
        yes, out[t, :a] = coder.code(p, who)
        model.learn(out[t, :a], yes)
    return out


def encode(blocks: list) -> list[bytes]:
    """Code arrays of ids, each by itself; an empty one gives no bytes."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    done: dict[int, bytes] = {}
    for i in order:
        if len(blocks[i]) and (blocks[i].max() > 65_535 or blocks[i].min() < 0):
            raise ValueError("ids are numbers of 16 bits")
    for low in range(0, len(order), LANES):
        part = order[low:low + LANES]
        done.update(zip(part, _encode([blocks[i] for i in part])))
    return [done[i] for i in range(len(blocks))]


def decode(blocks: list[bytes], lengths: list[int]) -> list:
    """The ids of coded blocks, as arrays of unsigned 32-bit numbers."""
    order = sorted(range(len(blocks)), key=lambda i: -lengths[i])
    done: dict = {}
    for low in range(0, len(order), LANES):
        part = order[low:low + LANES]
        table = _decode([blocks[i] for i in part], [lengths[i] for i in part])
        done.update((i, table[:lengths[i], k].astype("<u4")) for k, i in enumerate(part))
    return [done[i] for i in range(len(blocks))]


class Words:
    """A tokenizer that keeps the ids of the words it has met.

    A tokenizer of byte pairs never joins across a space that follows another sign than white space, so a text may be
    cut before such spaces and each piece be encoded by itself, each distinct piece of a batch once. Where the tokenizer is of another kind, or a text
    holds one of its added tokens, the text goes to it whole.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.run = getattr(self.whole, "encode_batch_fast", self.whole.encode_batch)
        kind = json.loads(self.whole.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.divides = (kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                        and not before.get("add_prefix_space") and kind.get("truncation") is None and kind.get("padding") is None)
        self.added = [t["content"] for t in kind.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # a space in an alphabet of bytes

    def pieces(self, texts: list[str]) -> tuple:
        """The texts in pieces that are tokenised independently of each other, and how many pieces each text has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pa.array(texts, pa.large_string())
        _, offsets, data = column.buffers()
        starts = np.frombuffer(offsets, np.int64, len(texts) + 1)
        if not self.divides or starts[-1] == 0:
            return column, np.ones(len(texts), np.int64)
        body = np.frombuffer(data, np.uint8, starts[-1])
        at = np.flatnonzero(body[4:] == 32) + 4  # what lies before the fifth byte stays with its text
        # a character that is certainly no white space comes before: an ASCII sign, or by its first byte
        one, two, three, four = (body[at - k] for k in (1, 2, 3, 4))
        cut = (one > 32) & (one < 127)
        cut |= (two >= 0xC3) & (two <= 0xDF) | (three == 0xE0) | (three >= 0xE4) & (three <= 0xEF) | (four >= 0xF0)
        at = at[cut]
        owner = np.searchsorted(starts, at, side="right") - 1
        keep = starts[owner] < at
        for token in self.added:
            keep &= ~pc.match_substring(column, token).to_numpy(zero_copy_only=False)[owner]
        at, owner = at[keep], owner[keep]
        count = np.bincount(owner, minlength=len(texts)) + 1
        bounds = np.append(np.insert(at, np.searchsorted(at, starts[:-1]), starts[:-1]), starts[-1])
        return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), data]), count

    def new(self, words: list[str]) -> dict[str, bytes]:
        """The ids of pieces not met before. Those with one space, at their begin, are handed over in rows of many: there
        each id that begins with a space begins a piece."""
        import numpy as np

        alone, rows, out = words, [], {}
        if self.divides:
            plain = [w.rfind(" ") == 0 and _closes(w) for w in words]
            alone, many = ([w for w, p in zip(words, plain) if p == kind] for kind in (False, True))
            rows = [many[k:k + 1_000] for k in range(0, len(many), 1_000)]
        for row in rows:
            text = "".join(row)
            ids = np.array(self.run([text], add_special_tokens=False)[0].ids, np.uint32)
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) != len(row) or begins[0] or any(a in text for a in self.added):
                alone += row
                continue
            raw, at = ids.tobytes(), (4 * begins).tolist()
            out.update(zip(row, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]))
        out.update((w, array("I", e.ids).tobytes()) for w, e in zip(alone, self.run(alone, add_special_tokens=False)))
        return out

    def encode(self, texts: list[str], end: int) -> list:
        """Arrays of the ids of each text and the end id."""
        import numpy as np

        pieces, count = self.pieces(texts)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        here = self.new([w for w in words if w not in known])
        known.update(here)
        found = [known[w] for w in words]
        for w in here:
            if len(w) > 64:
                del known[w]
        # the ids of all pieces in a row
        flat, number = np.frombuffer(b"".join(found), np.uint32), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        size = sizes[number]
        ends = np.cumsum(size)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[number] - ends + size, size) + np.arange(size.sum())]
        last = np.array([end], np.uint32)
        bounds = [0, *ends[np.cumsum(count) - 1].tolist()]
        return [np.concatenate((ids[a:b], last)) for a, b in zip(bounds, bounds[1:])]


def _closes(part: str) -> bool:
    """Whether a part ends in a character that is certainly no white space."""
    return "!" <= part[-1] <= "~" or part[-1].isalnum()


_LOADED: dict[str, Words] = {}


def _tokenizer(path: str) -> Words:
    """The tokenizer of a file, loaded once a worker."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def _encoded(texts: list[str | None], tokenizer: Words, end: int):
    """Ids of each text with the end id, a bounded amount of text at a time."""
    waiting, size = [], 0
    for k, t in enumerate(texts):
        waiting.append(t or "")
        size += len(waiting[-1])
        if size >= BATCH_BYTES or k == len(texts) - 1:
            yield from tokenizer.encode(waiting, end)
            waiting, size = [], 0


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END,
       block_ids: int = BLOCK_IDS, frame_ids: int = FRAME_IDS) -> None:
    """Write the ids of all texts, in ascending order of the key (null keys last), as coded frames at ``path``.

    ``tokenizer`` is a file every executor has. A null or empty text is its end id alone; rows of one key follow each
    other in the order of a hash of their texts, repeated rows each keep their ids; long texts are encoded whole, a
    text is never divided between frames; an empty table writes no frames; columns other than key and text are not
    read, so none can clash.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(named(key).alias("key"), named(text).alias("body"))
    order = [F.asc_nulls_last("key"), F.xxhash64("body").asc(), F.length("body").asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    key_type = to_arrow_type(rows.schema["key"].dataType)
    names = ["part", "frame", "first", "ids", "keys", "lengths", "sizes", "sums", "blocks"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(key_type), pa.list_(pa.int64()),
             pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]

    def run(batches):
        from pyspark import TaskContext

        part, model = TaskContext.get().partitionId(), _tokenizer(tokenizer)
        first, number, waiting = 0, 0, []
        keys, ids, size = [], [], 0

        def closed():
            """The documents at hand as a frame; its blocks wait until enough are there to be coded side by side."""
            import numpy as np

            nonlocal first, number, keys, ids, size
            stream = np.concatenate(ids)
            cut = [stream[k:k + block_ids] for k in range(0, len(stream), block_ids)]
            waiting.append((part, number, first, size, keys, [len(x) for x in ids], cut))
            first, number = first + size, number + 1
            keys, ids, size = [], [], 0

        def coded():
            blocks = encode([b for w in waiting for b in w[-1]])
            at = 0
            for *head, cut in waiting:
                row = [*head, [len(b) for b in cut], [zlib.crc32(b.astype("<u4").tobytes()) for b in cut], blocks[at:at + len(cut)]]
                at += len(cut)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)
            waiting.clear()

        for batch in batches:
            for k, found in zip(batch.column(0), _encoded(batch.column(1).to_pylist(), model, end)):
                keys.append(k.as_py())
                ids.append(found)
                size += len(found)
                if size >= frame_ids:
                    closed()
                    if sum(len(w[-1]) for w in waiting) >= LANES:
                        yield from coded()
        if keys:
            closed()
        yield from coded()

    kind = rows.schema["key"].dataType.simpleString()
    schema = (f"part int, frame bigint, first bigint, ids bigint, keys array<{kind}>, lengths array<bigint>, "
              "sizes array<int>, sums array<bigint>, blocks array<binary>")
    placed.mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Documents of the frames at ``path``: key, ``start`` (ids of all documents before it) and ``ids`` (little-endian
    unsigned 32-bit numbers, the end id included).

    A block whose checksum does not hold fails the read with its part, frame and block. No frames give no rows.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    frames = spark.read.parquet(path)
    element = frames.schema["keys"].dataType.elementType
    key_type = to_arrow_type(element)

    def run(batches):
        waiting, lanes = [], 0

        def opened():
            import numpy as np

            mine = [(i, k) for i, r in enumerate(waiting) for k in range(len(r["blocks"]))]
            got = dict(zip(mine, decode([waiting[i]["blocks"][k] for i, k in mine], [waiting[i]["sizes"][k] for i, k in mine])))
            for i, r in enumerate(waiting):
                parts = [got.pop((i, k)) for k in range(len(r["blocks"]))]
                for k, ids in enumerate(parts):
                    if zlib.crc32(ids.tobytes()) != r["sums"][k]:
                        raise ValueError(f"part {r['part']}, frame {r['frame']}, block {k} is damaged")
                stream = np.concatenate(parts).tobytes()
                starts = np.concatenate(([0], np.cumsum(r["lengths"]))).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(r["keys"]), pa.int32()), pa.array([r["first"] + s for s in starts[:-1]], pa.int64()),
                     pa.array(r["keys"], key_type), pa.array([stream[4 * a:4 * b] for a, b in zip(starts, starts[1:])], pa.binary())],
                    ["part", "at", "key", "ids"])
            waiting.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                waiting += batch.slice(k, 1).to_pylist()
                lanes += len(waiting[-1]["blocks"])
                if lanes >= LANES:
                    yield from opened()
                    lanes = 0
        yield from opened()

    found = (frames.select("part", "frame", "first", "keys", "lengths", "sizes", "sums", "blocks")
             .mapInArrow(run, f"part int, at bigint, key {element.simpleString()}, ids binary"))
    # one row per file
    sums = frames.groupBy("part").agg(F.sum("ids").alias("ids"))
    offsets = sums.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("offset"))
    return found.join(offsets, "part").select(F.col("key").alias(key), (F.col("offset") + F.col("at")).alias("start"), "ids")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the contract."""
    return found.select(key, "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
