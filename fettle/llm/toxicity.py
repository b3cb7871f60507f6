"""Toxicity grades by a cumulative-link (ordinal) regression over sparse word counts.

P(grade <= k) = logistic(threshold_k - w.x): one weight per feature shared by all grades,
ordered thresholds between them. Output are the probabilities, the expected severity
(the sum of P(grade >= k)) and the decision P(grade >= 1) >= the model's cut.

Features. A word counts by itself and by its beginnings of ``STEMS`` letters, so that the
inflected forms of a stem share their evidence. Beginnings are hashed into ``BUCKETS``
weights: none is left out, however rare. Words of two or more labelled texts have a weight
of their own besides. The ridge, not a threshold, keeps rare features small; it is
lighter for features that lie in many toxic texts and few clean ones.

Fit. At most ``SAMPLE_ROWS`` labelled texts, a quarter of them toxic, chosen by a hash of
the key, meet in one task; repeated texts count once. Each counts alike, whatever the
number of labels, and the convex objective is followed to its minimum. One text in
``HELD`` takes no part: on those the cut is chosen (``CUT`` at most, ``LEAST_CUT`` at
least) so that no more than ``FLAGGED`` of the clean texts are flagged, a rule that does
not depend on how the classes are mixed. Labels only say toxic or not; the grade of a
toxic text is 1, 2 or 3 by how many telling words it holds (``GRADES``): words of which
the word itself or a beginning lies in many toxic texts and few clean ones.

Scoring reads whole texts, once, where they lie.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fettle.llm.rows import layout, named, packed, unpacked
from fettle.operators.spread import settle

SAMPLE_ROWS = 4_000
HELD, FLAGGED, LEAST_CUT = 5, 0.003, 0.2
STEMS = (4, 5, 6, 7, 8)
BUCKETS = 1 << 18
GRADES = (1, 4, 7)  # telling words from which on a toxic text has grade 1, 2, 3
CUT = 0.5
RIDGE = 30.0
SURE_SHARE = 0.01  # of the ridge, for features that tell toxicity
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; null has none."""
    return _WORDS.findall(text.lower()) if text else []


def stems_of(word: str) -> list[int]:
    """Buckets of the beginnings of a word."""
    return [zlib.crc32(f"{k}{word[:k]}".encode()) % BUCKETS for k in STEMS if k <= len(word)]


@dataclass(frozen=True)
class Ordinal:
    """Weights by word and by bucket of beginnings, and ordered thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    stems: dict[int, float] = field(default_factory=dict)
    cut: float = CUT
    _known: dict[str, float] = field(default_factory=dict, init=False, repr=False, compare=False)

    def weight(self, word: str) -> float:
        """What one occurrence of the word adds."""
        known = self._known.get(word)
        if known is None:
            if len(self._known) >= 1 << 18:  # a cache only
                self._known.clear()
            known = self._known[word] = self.weights.get(word, 0.0) + sum(self.stems.get(k, 0.0) for k in stems_of(word))
        return known

    def shares(self, text: str | None) -> list[float]:
        """P(grade >= k) for k from 1."""
        score = sum(self.weight(w) * (1.0 + math.log(n)) for w, n in Counter(words_of(text)).items())
        return [1.0 / (1.0 + math.exp(min(500.0, max(-500.0, t - score)))) for t in self.thresholds]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def telling(toxic, clean, toxic_docs: int, clean_docs: int):
    """Which features tell toxicity, from the numbers of texts of both classes that hold them."""
    import numpy as np

    odds = np.log((toxic + 0.5) / (toxic_docs + 1) / ((clean + 0.5) / (clean_docs + 1)))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return (toxic >= 5) & (odds > np.maximum(4 * error, math.log(10)))


def _logistic(z):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def minimum(objective, x, rounds: int, tolerance: float, memory: int = 6):
    """Least point of a convex function (value and gradient) by limited-memory quasi-Newton steps.

    Ends when the gradient is ``tolerance`` of its first length, or after ``rounds`` steps.
    """
    import numpy as np

    value, grad = objective(x)
    first, past = float(np.linalg.norm(grad)), []
    for _ in range(rounds):
        if np.linalg.norm(grad) <= tolerance * max(first, 1e-12):
            break
        way, shares = grad.copy(), []
        for s, d, rho in reversed(past):
            shares.append(rho * (s @ way))
            way -= shares[-1] * d
        if past:
            s, d, _ = past[-1]
            way *= (s @ d) / (d @ d)
        else:
            way /= max(float(np.linalg.norm(way)), 1e-12)
        for (s, d, rho), share in zip(past, reversed(shares)):
            way += (share - rho * (d @ way)) * s
        slope, step = float(grad @ way), 1.0
        while step > 1e-10:
            at = x - step * way
            new, new_grad = objective(at)
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, d = at - x, new_grad - grad
        if s @ d > 1e-12:
            past = [*past[1 - memory:], (s, d, 1.0 / float(s @ d))]
        x, value, grad = at, new, new_grad
    return x


def fit(docs: list[tuple[str | None, int]], ridge: float = RIDGE, rounds: int = 80, tolerance: float = 2e-3) -> Ordinal:
    """Maximum penalised likelihood on sparse counts, to a gradient of ``tolerance`` of the first one or ``rounds`` steps."""
    import numpy as np

    numbers, labels = _Numbers(), np.array([int(bool(t)) for _, t in docs], np.int64)
    rows, cols, reps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, (t, _) in enumerate(docs):
        found = Counter(words_of(t))
        rows.append(np.full(len(found), i, np.int64))
        cols.append(np.array([numbers[w] for w in found], np.int64))
        reps.append(np.array(list(found.values()), np.int64))
    row, col, times = np.concatenate(rows), np.concatenate(cols), np.concatenate(reps)
    names, n, size = list(numbers), len(labels), len(numbers)
    stems = [stems_of(w) for w in names]
    owner = np.repeat(np.arange(size), [len(x) for x in stems])  # word number and bucket of each beginning
    bucket = np.array([k for x in stems for k in x], np.int64)
    own = (np.bincount(col, minlength=size) >= 2).astype(float)
    del rows, cols, reps, stems, numbers
    # grades of the toxic texts
    texts = [np.bincount(col[labels[row] == k], minlength=size) for k in (0, 1)]
    docs_of = [max(1, int((labels == k).sum())) for k in (0, 1)]
    told = telling(texts[1], texts[0], docs_of[1], docs_of[0])
    sure = np.concatenate((told, np.zeros(BUCKETS, bool)))
    if len(bucket):
        in_row = np.repeat(np.arange(len(row)), np.bincount(owner, minlength=size)[col])
        first = np.cumsum(np.bincount(owner, minlength=size)) - np.bincount(owner, minlength=size)
        step = np.arange(len(in_row)) - np.repeat(np.cumsum(np.bincount(owner, minlength=size)[col]) - np.bincount(owner, minlength=size)[col],
                                                  np.bincount(owner, minlength=size)[col])
        held = np.unique(row[in_row] * BUCKETS + bucket[first[col[in_row]] + step])  # each bucket once a text
        del in_row, step
        per = [np.bincount(held[labels[held // BUCKETS] == k] % BUCKETS, minlength=BUCKETS) for k in (0, 1)]
        del held
        sure[size:] = telling(per[1], per[0], docs_of[1], docs_of[0])
        told |= np.bincount(owner, sure[size:][bucket], minlength=size) > 0
    pull_back = np.where(sure, SURE_SHARE * ridge, ridge)
    told_words = np.bincount(row, times * told[col], minlength=n)
    y = np.where(labels > 0, np.maximum(1, sum((told_words >= g).astype(np.int64) for g in GRADES)), 0)
    val = 1.0 + np.log(times)
    top = len(GRADES)
    theta = np.log(np.array([(np.sum(y < k) + 1.0) / (np.sum(y >= k) + 1.0) for k in range(1, top + 1)]))
    theta = np.maximum.accumulate(theta + np.arange(top) * 1e-1)

    def objective(x):
        """Penalised negative log likelihood and its gradient; thresholds are the first one and the logarithms of the gaps."""
        w, gaps = x[:-top], np.exp(np.clip(x[1 - top:], -30, 30))
        theta = x[-top] + np.concatenate(([0.0], np.cumsum(gaps)))
        word = own * w[:size] + np.bincount(owner, w[size:][bucket], minlength=size)
        score = np.bincount(row, val * word[col], minlength=n)
        edges = np.concatenate([np.full((n, 1), -np.inf), theta[None, :] - score[:, None], np.full((n, 1), np.inf)], 1)
        up, low = edges[np.arange(n), y + 1], edges[np.arange(n), y]
        cut_up, cut_low = _logistic(up), _logistic(low)
        # for texts beyond all thresholds on one side the difference is taken where it is exact
        p = np.where(low > 0, _logistic(-low) - _logistic(-up), cut_up - cut_low)
        if np.any(p <= 0):
            p = np.maximum(p, 1e-300)
        d_up, d_low = cut_up * _logistic(-up) / p, cut_low * _logistic(-low) / p
        pull = d_up - d_low  # derivative of the loss by the score
        by_word = np.bincount(col, val * pull[row], minlength=size)
        g_w = np.concatenate((own * by_word, np.bincount(bucket, by_word[owner], minlength=BUCKETS))) + pull_back * w
        g_t = np.bincount(y, d_low, minlength=top + 1)[1:] - np.bincount(y, d_up, minlength=top + 1)[:top]
        after = np.cumsum(g_t[::-1])[::-1]  # a gap moves all thresholds after it
        return float(-np.log(p).sum() + 0.5 * (pull_back * w * w).sum()), np.concatenate((g_w, after[:1], after[1:] * gaps))

    x = np.concatenate((np.zeros(size + BUCKETS), theta[:1], np.log(np.diff(theta))))
    if n and size:
        x = minimum(objective, x, rounds, tolerance)
    w, theta = x[:-top], x[-top] + np.concatenate(([0.0], np.cumsum(np.exp(np.clip(x[1 - top:], -30, 30)))))
    return Ordinal({names[i]: float(w[i]) for i in np.flatnonzero(own)}, tuple(float(t) for t in theta),
                   {int(k): float(w[size + k]) for k in np.unique(bucket)})


def cut_of(model: Ordinal, held: list[tuple[str | None, int]], flagged: float = FLAGGED) -> float:
    """A cut between ``LEAST_CUT`` and ``CUT`` that flags at most a share of the clean texts held out.

    Midway (of logarithms) between the highest clean text that must not be flagged and the lowest toxic one above it.
    """
    clean, toxic = (sorted((model.shares(t)[0] for t, y in held if bool(y) == kind), reverse=True) for kind in (False, True))
    if not clean:
        return CUT
    floor = clean[int(len(clean) * flagged)]
    return min(CUT, max(LEAST_CUT, math.sqrt(floor * min((p for p in toxic if p > floor), default=CUT)), math.nextafter(floor, 2.0)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fit on at most ``rows`` labelled texts, in one task, a quarter of them toxic if there are as many.

    Null labels, keys and texts are left out; several labels of one key count as the largest; texts that occur
    repeatedly count once, as toxic if any of their labels says so; empty and very long texts are texts like others.
    Without labelled texts the model rejects nothing.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max((F.col(label) > 0).cast("int")).alias("_y"))
    present = settle(known.join(docs.filter(named(text).isNotNull()).select(named(key).alias("_key")).distinct(), "_key", "left_semi"))
    # a bounded number of keys by hash, so they may go to every task; the texts need not move
    most = {0: max(1, rows - rows // 4), 1: max(1, rows // 4)}
    keys, sample = None, None
    for y in (0, 1):
        part = present.filter(F.col("_y") == y).orderBy(F.xxhash64("_key"), "_key").limit(most[y])
        keys = part if keys is None else keys.unionByName(part)
    keys = settle(keys)
    joined = docs.select(named(key).alias("_key"), named(text).alias("_text")).filter("_text IS NOT NULL").join(F.broadcast(keys), "_key")
    for y in (0, 1):  # a key may have many rows
        part = joined.filter(F.col("_y") == y).select("_y", F.xxhash64("_text").alias("_order"), "_key", "_text").orderBy("_order", "_key").limit(most[y])
        sample = part if sample is None else sample.unionByName(part)

    def fitted(frame):
        import pandas as pd

        frame = frame.sort_values(["_y", "_order", "_key"], ascending=[False, True, True]).drop_duplicates("_text")
        held = frame["_order"] % HELD == 0
        model = fit(list(zip(frame["_text"][~held], frame["_y"][~held])))
        cut = cut_of(model, list(zip(frame["_text"][held], frame["_y"][held])))
        none = [None] * (len(model.thresholds) + 1)
        return pd.DataFrame({"word": [*model.weights, *[None] * len(model.stems), *none],
                             "stem": pd.array([*[None] * len(model.weights), *model.stems, *none[1:], -1], dtype="Int64"),
                             "value": [*model.weights.values(), *model.stems.values(), *model.thresholds, cut]})

    table = sample.groupBy().applyInPandas(fitted, "word string, stem bigint, value double").toArrow().to_pylist()
    thresholds = tuple(sorted(r["value"] for r in table if r["word"] is None and r["stem"] is None)) or (math.inf,) * len(GRADES)
    stems = {r["stem"]: r["value"] for r in table if r["stem"] is not None}
    cut = stems.pop(-1, CUT)
    return Ordinal({r["word"]: r["value"] for r in table if r["word"] is not None}, thresholds, stems, cut)


def score(docs: DataFrame, model: Ordinal, text: str = "text", cut: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with ``columns`` (all by default) and ``severity`` (expected grade), ``p_toxic``, ``toxic``.

    ``cut``: the model's own by default. Null, empty and wordless texts get the severity of a text without telling words;
    repeated rows are scored each; an empty table gives an empty result; without labels
    nothing is toxic; an incoming column of one of the three names is replaced.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            shares = [model.shares(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:returned], pa.array([sum(s) for s in shares], pa.float64()),
                 pa.array([s[0] for s in shares], pa.float64()), pa.array([s[0] >= cut for s in shares], pa.bool_())],
                ["row", "body"][:returned] + ["severity", "p_toxic", "toxic"])

    cut = model.cut if cut is None else cut
    columns = docs.columns if columns is None else columns
    returned = 2 if text in columns else 1
    rows = packed(docs, [c for c in columns if c != text], body=named(text))
    schema = layout(rows.select(*rows.columns[:returned]), severity="double", p_toxic="double", toxic="boolean")
    return unpacked(rows.mapInArrow(run, schema), columns, {text: F.col("body")},
                    **{c: F.col(c) for c in ("severity", "p_toxic", "toxic")})


def report(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns: one row per document."""
    return scored.select(F.col(key), F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), "toxic")
