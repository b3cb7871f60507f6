"""Personal data in texts: fixed patterns, and boosted trees over looser candidates.

Generators of high recall propose overlapping spans (spelt-out mail addresses, number
groups with or without a country code, dotted numbers). Each candidate becomes a handful
of small-valued features of its format and of the 24 characters on either side. Boosted
trees of depth two are trained here, on all candidates of the corpus. A positive is what a
base pattern confirms, or what carries evidence that the open forms have, too: a word that
announces a number or address right before it, or a bracketed "(at)". So forms that no
base pattern can confirm (national numbers, spelt-out addresses) have positives of their
own, and a form that is mostly announced is recognised where it is not. What the trees see
never includes the very sign the base pattern demands.

Training is exact and bounded: features take so few values that the corpus is one table
of counts per feature vector (at most ``CELLS`` rows), which one aggregate gives. Half of
the rows (by a hash of the key) fit the trees, the other half calibrates: a candidate is
redacted from the lowest score at which the positive share of all held-out candidates of
its form with that score or more reaches ``precision``. Real data without evidence counts
against that share, so it is a lower bound. The trees are then one CASE expression.

Rows never leave the JVM: patterns, features, trees and thresholds are Columns.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.llm.spans import clear_of, joined, labelled, located
from fettle.operators.spread import settle

# The patterns of the contract. Possessive where nothing can follow, and a
# run of name characters or digits is tried from its first character only, so a long run
# costs one pass.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SPELT = r"[A-Za-z0-9._%+-]{2,64}\x20?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,12}"
GROUPS = r"[(+]?[0-9][0-9().\x20-]{6,24}[0-9]"
# Words that announce a number or an address, right before it.
NUMBER_CUE = (r"(?<!\p{L})(?:tele?phone|phone|tel[eé]fono|t[eé]l[eé]phone|telefon|tel|t[eé]l|mobile?|m[oó]vil|handy|fax|cell|call|whatsapp)"
              r"(?:\x20(?:me|us|no|nr|number|nummer|num[eé]ro|n[uú]mero))?[.:#=\x20-]{1,4}$")
MAIL_CUE = r"(?<!\p{L})(?:e-?mail|mail|courriel|correo|contact|write\x20to|reach\x20me\x20at)[.:=\x20-]{1,4}$"
BRACKETED = r"[(\[{]at[)\]}]"
PLAIN, NUMBER, MARKED = 0, 1, 2  # forms: address, number group, address with a bracketed sign
CONTEXT = 24
CELLS = 4096
TREES = 20
STEP = 0.3

Span = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the check digit is right."""
    backwards = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(backwards, lambda c, i: F.when(
            i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1))
            .otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _small_part(part: Column) -> Column:
    """True where a dotted part is at most 255, however many zeros lead."""
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.when(bare == "", 0).otherwise(
        F.substring(bare, 1, 3).cast("int")) <= 255)


def base_spans(text: Column) -> list[Column]:
    """Spans of email, ip, card and phone; matches that fail their check are consumed, not retried."""
    ip = F.filter(located(text, IP), lambda s: F.forall(F.split(s["found"], r"\."), _small_part))
    card = F.filter(located(text, CARD), lambda s: F.length(_digits(s["found"])).between(16, 19) & luhn(_digits(s["found"])))
    phone = F.filter(located(text, PHONE), lambda s: F.length(_digits(s["found"])).between(8, 15))
    return [labelled(located(text, EMAIL), "email", 0), labelled(ip, "ip", 1), labelled(card, "card", 2),
            labelled(phone, "phone", 3)]


def candidates(text: Column) -> Column:
    """Overlapping proposals: ``array<struct<start, end, found, form, before, after>>``."""
    def around(spans: Column, form: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), F.lit(form).alias("form"),
            F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)).cast("int") + 1,
                        F.least(s["start"], F.lit(CONTEXT)).cast("int")).alias("before"),
            F.substring(text, s["end"].cast("int") + 1, F.lit(CONTEXT)).alias("after")))

    return F.concat(around(located(text, SPELT), PLAIN), around(located(text, GROUPS), NUMBER))


def form_of(c: Column) -> Column:
    return F.when(c["found"].rlike(BRACKETED), MARKED).otherwise(c["form"])


def announced(c: Column) -> Column:
    """Evidence that needs no base pattern."""
    before = F.lower(c["before"])
    number = before.rlike(NUMBER_CUE) & F.length(_digits(c["found"])).between(7, 15)
    return F.coalesce(F.when(c["form"] == NUMBER, number).otherwise(c["found"].rlike(BRACKETED) | before.rlike(MAIL_CUE)), F.lit(False))


def features(c: Column) -> dict[str, Column]:
    """Small-valued features of a candidate; the product of their sizes is at most CELLS."""
    n = F.length(_digits(c["found"]))
    bare = F.regexp_replace(c["found"], "^[(+]", "")  # not the very sign that a base pattern demands
    parts = F.size(F.split(bare, r"[^0-9A-Za-z]+"))
    cue = F.lower(c["before"]).rlike(r"(?:phone|tel|call|mobile|fax|mail|contact|card|visa|ssn|address|host|server)")
    return {
        "form": form_of(c).cast("int"),  # 3
        "digits": F.when(n < 7, 0).when(n < 9, 1).when(n < 11, 2).when(n == 11, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6),  # 7
        "parts": F.least(parts, F.lit(6)).cast("int"),  # 7
        "parens": c["found"].contains("(").cast("int"),  # 2
        "dots": F.when(F.length(F.regexp_replace(c["found"], "[^.]", "")) >= 3, 2).when(c["found"].contains("."), 1).otherwise(0),  # 3
        "cue": F.coalesce(cue, F.lit(False)).cast("int"),  # 2
        "edge": F.coalesce(c["before"].rlike(r"[\s:;,(]$"), F.lit(False)).cast("int"),  # 2
    }


def boost(cells: list[tuple[dict, int, int]], trees: int = TREES, step: float = STEP) -> tuple[float, list]:
    """Depth-two trees by gradient steps of the log loss over counted feature vectors.

    ``cells``: (features, positives, negatives). Returns the first score and the trees;
    a tree is (feature, limit, left, right) with nested trees or leaf values.
    """
    pos, neg = sum(p for _, p, _ in cells), sum(n for _, _, n in cells)
    start = math.log((pos + 1.0) / (neg + 1.0))
    scores = [start] * len(cells)
    names = sorted(cells[0][0]) if cells else []

    def leaf(rows: list[int], g: list[float], h: list[float]) -> float:
        return step * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1.0)

    def gain(rows: list[int], g: list[float], h: list[float]) -> float:
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1.0)

    def grow(rows: list[int], g: list[float], h: list[float], depth: int):
        best, whole = None, gain(rows, g, h)
        for name in names if depth else ():
            for limit in sorted({cells[i][0][name] for i in rows})[:-1]:
                left = [i for i in rows if cells[i][0][name] <= limit]
                right = [i for i in rows if cells[i][0][name] > limit]
                won = gain(left, g, h) + gain(right, g, h) - whole
                if best is None or won > best[0]:
                    best = (won, name, limit, left, right)
        if best is None or best[0] < 1e-9:
            return leaf(rows, g, h)
        return (best[1], best[2], grow(best[3], g, h, depth - 1), grow(best[4], g, h, depth - 1))

    grown = []
    for _ in range(trees if cells else 0):
        share = [1.0 / (1.0 + math.exp(-s)) for s in scores]
        g = [p - (p + n) * q for (_, p, n), q in zip(cells, share)]
        h = [(p + n) * q * (1.0 - q) for (_, p, n), q in zip(cells, share)]
        tree = grow(list(range(len(cells))), g, h, 2)
        grown.append(tree)
        scores = [s + _value(tree, f) for s, (f, _, _) in zip(scores, cells)]
    return start, grown


def _value(tree, row: dict) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def score_of(model: tuple[float, list], row: dict) -> float:
    """Score of a feature vector."""
    return model[0] + sum(_value(t, row) for t in model[1])


def cut_for(model: tuple[float, list], held: list[tuple[dict, int, int]], precision: float) -> float:
    """Lowest score from which on the positive share of held-out candidates reaches ``precision``; infinite if none does.

    One more negative than was seen is reckoned with, so a handful of positives proves nothing.
    """
    pos = neg = 0
    cut = math.inf
    ranked = sorted(((score_of(model, f), p, n) for f, p, n in held), reverse=True, key=lambda x: x[0])
    for k, (score, p, n) in enumerate(ranked):
        pos, neg = pos + p, neg + n
        last = k + 1 == len(ranked) or ranked[k + 1][0] < score
        if last and pos >= precision * (pos + neg + 1):
            cut = score
    return cut


def tree_column(tree, row: Column) -> Column:
    """A tree as nested CASE over a struct of features."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(row[tree[0]] <= tree[1], tree_column(tree[2], row)).otherwise(tree_column(tree[3], row))


def train(rows: DataFrame, precision: float) -> tuple[tuple[float, list], dict[int, float]]:
    """Model and cut per form from rows with ``half``, ``evident`` and ``f``: one aggregate of at most 2 x CELLS rows."""
    counts = (rows.groupBy("half", "f").agg(F.sum(F.col("evident").cast("long")).alias("p"),
                                           F.count(F.lit(1)).alias("n")).collect())
    cells = {half: sorted(((r["f"].asDict(), r["p"], r["n"] - r["p"]) for r in counts if r["half"] == half),
                          key=lambda c: sorted(c[0].items())) for half in (0, 1)}
    model = boost(cells[0])
    held = {form: [c for c in cells[1] if c[0]["form"] == form] for form in (PLAIN, NUMBER, MARKED)}
    return model, {form: cut_for(model, part, precision) for form, part in held.items()}


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", precision: float = 0.95) -> DataFrame:
    """One row per row of ``docs``: its key, the ``base`` spans and the ``added`` spans.

    Base spans are ordered by kind, then start; code points of the whole text, end
    exclusive. ``added`` holds the candidates that the trees accept and that overlap no
    base span, of kind ``likely``. Null and empty texts have no spans; repeated rows and
    keys are handled row by row, a null key is kept; an empty table, or one without
    candidates, gives no added span; other columns are not read, so names cannot clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    by_kind = base_spans(body)
    rows = settle(docs.select(F.col(key).alias("key"), F.concat(*by_kind).alias("base"), candidates(body).alias("found"),
                              F.pmod(F.xxhash64(F.col(key), F.length(body)), F.lit(2)).cast("int").alias("half")))
    described = F.transform("found", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), (~clear_of(c, F.col("base"))).alias("confirmed"),
        (~clear_of(c, F.col("base")) | announced(c)).alias("evident"),
        F.struct(*[v.alias(k) for k, v in features(c).items()]).alias("f")))
    rows = rows.select("key", "base", "half", described.alias("found"))
    model, cuts = train(rows.select("half", F.explode("found").alias("c")).select("half", "c.evident", "c.f"), precision)
    cuts = {form: cut for form, cut in cuts.items() if not math.isinf(cut)}
    none = F.array().cast(Span)
    if not cuts:
        return rows.select("key", "base", none.alias("added"))
    score = lambda f: reduce(lambda a, t: a + tree_column(t, f), model[1], F.lit(model[0]))
    sure = lambda f: reduce(lambda a, b: a | b, [(f["form"] == form) & (score(f) >= cut - 1e-9) for form, cut in cuts.items()])
    taken = F.filter("found", lambda c: ~c["confirmed"] & sure(c["f"]))
    added = F.array_sort(F.transform(taken, lambda c: F.struct(
        c["start"].alias("start"), F.lit(4).alias("rank"), c["end"].alias("end"), F.lit("likely").alias("kind"))))
    return rows.select("key", "base", F.coalesce(added, none).alias("added"))


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the contract."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("key").alias(key), *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_likely"))
