"""Secrets in texts: fixed patterns, and a randomness battery for tokens of unknown form.

Battery. A candidate is a maximal run of 20 or more key characters that holds a digit.
Its encoding is inferred from its characters, and three statistics are taken over that
alphabet: chi-squared against equal frequencies, the number of runs above and below the
middle of the alphabet, and the lag-one serial correlation.

The chi-squared test is turned round. The hypothesis to reject is "as uneven as ordinary
identifiers": a chi-squared statistic with a non-centrality that grows with the length
of the token. A short token is rarely even enough to reject it, a long one is; so the
p-value knows the length. Benjamini-Hochberg over all candidates of the corpus, within
bands of length, holds the share of false discoveries at ``rate``. Tokens whose order is
not random (runs or serial correlation) are then turned down.

The p-values are counted on a logarithmic grid before they are ranked, rounded up by at
most 1.1 %, so what the step-up procedure sorts is bounded whatever the corpus holds,
and a token that is random beyond doubt is accepted among any number of ordinary ones.

Everything is a Column expression or an aggregate; rows never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fettle.llm.spans import clear_of, joined, labelled, located, normal_tail
from fettle.operators.spread import settle

# The patterns of the contract, in forms that do not recurse
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"

# Alphabets, and how uneven ordinary identifiers are over them
# (size of the alphabet times the sum of squared frequencies, less one)
ALPHABETS = {
    "decimal": ("0123456789", 0.6),
    "hex": ("0123456789abcdef", 0.6),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.0),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.0),
}
GRID = 64  # steps to a halving of the p-value
LEAST = 1e-300
BANDS = (20, 32, 64)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """(assign, access, hex) spans. A match that fails its length is consumed, not retried."""
    assign = F.filter(located(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 6)
    return labelled(assign, "assign", 0), labelled(located(text, ACCESS), "access", 1), labelled(located(text, HEX), "hex", 2)


def encoding_of(token: Column) -> Column:
    """The narrowest alphabet that holds the token."""
    return (F.when(token.rlike("^[0-9]+$"), "decimal").when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
            .when(token.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64"))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds ``encoding``, ``size``, ``p_even`` and ``p_order`` to rows with a ``token``.

    ``p_even``: how likely an ordinary identifier of that length is this even.
    ``p_order``: how likely random order has such runs and serial correlation.
    """
    encoding = encoding_of(F.col("token"))
    alphabet = F.create_map(*[F.lit(x) for k, (a, _) in ALPHABETS.items() for x in (k, a)])
    uneven = F.create_map(*[F.lit(x) for k, (_, u) in ALPHABETS.items() for x in (k, u)])
    bare = F.translate(F.rtrim(F.col("token"), F.lit("=")), "-_", "+/")
    rows = (tokens.withColumn("encoding", encoding)
            .withColumn("_bare", F.when(F.col("encoding") == "hex", F.lower(bare)).otherwise(F.translate(bare, "=", "")))
            .withColumn("_alphabet", alphabet[F.col("encoding")]).withColumn("_uneven", uneven[F.col("encoding")])
            .withColumn("size", F.length("_bare").cast("double")).withColumn("_a", F.length("_alphabet").cast("double")))
    rows = rows.withColumn("_codes", F.expr("transform(split(_bare, ''), c -> cast(instr(_alphabet, c) - 1 as double))"))
    squares = F.expr("aggregate(split(_alphabet, ''), 0D, (acc, c) -> acc + power(length(_bare) - length(replace(_bare, c, '')), 2))")
    n, a = F.col("size"), F.col("_a")
    chi = a / n * squares - n
    df, far = a - 1.0, (n - 1.0) * F.col("_uneven")
    scale, free = (df + 2.0 * far) / (df + far), (df + far) * (df + far) / (df + 2.0 * far)
    z = (F.pow(F.greatest(chi, F.lit(0.0)) / (scale * free), F.lit(1.0 / 3)) - (1.0 - 2.0 / (9.0 * free))) / F.sqrt(2.0 / (9.0 * free))
    rows = rows.withColumn("p_even", normal_tail(z))
    # runs above and below the middle of the alphabet
    bits = F.expr("array_join(transform(_codes, c -> if(c < _a / 2, '0', '1')), '')")
    rows = rows.withColumn("_bits", bits)
    high = n - F.length(F.replace(F.col("_bits"), F.lit("1"), F.lit("")))
    low = n - high
    turns = [(n - F.length(F.replace(F.col("_bits"), F.lit(x), F.lit("")))) / 2.0 for x in ("01", "10")]
    mean = 1.0 + 2.0 * high * low / n
    gaps = F.greatest(n - 1.0, F.lit(1.0))  # a lone character beside "=" has none
    spread = F.sqrt((mean - 1.0) * (mean - 2.0) / gaps)
    z_runs = F.when((high * low > 0) & (spread > 0), (1.0 + turns[0] + turns[1] - mean) / spread).otherwise(6.0)
    variance = (a * a - 1.0) / 12.0
    products = F.expr(
        "aggregate(zip_with(slice(_codes, 1, size(_codes) - 1), slice(_codes, 2, size(_codes) - 1), "
        "(x, y) -> (x - (_a - 1) / 2) * (y - (_a - 1) / 2)), 0D, (acc, v) -> acc + v)")
    z_serial = products / (variance * F.sqrt(gaps))
    return (rows.withColumn("p_order", F.exp(-(z_runs * z_runs + z_serial * z_serial) / 2.0))
            .drop("_bare", "_alphabet", "_uneven", "_a", "_codes", "_bits"))


def band_of(size: Column) -> Column:
    """Number of the length band."""
    return sum((F.when(size >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0)).cast("int")


def step_of(p: Column) -> Column:
    """Grid step of a p-value: the larger, the less likely; 2 ** (-step / GRID) is never below the p-value."""
    return F.floor(-F.log2(F.greatest(F.least(p, F.lit(1.0)), F.lit(LEAST))) * GRID).cast("int")


def cutoffs(tested: DataFrame, rate: float) -> DataFrame:
    """Per band the least grid step, that is the largest p-value, that Benjamini-Hochberg accepts, as a one-row map."""
    counts = tested.groupBy("band", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("band").orderBy(F.desc("step"))
    whole = Window.partitionBy("band")
    ranked = counts.withColumn("k", F.sum("n").over(upto)).withColumn("m", F.sum("n").over(whole))
    passed = ranked.filter(F.pow(F.lit(2.0), -F.col("step") / F.lit(float(GRID))) <= F.lit(rate) * F.col("k") / F.col("m"))
    best = passed.groupBy("band").agg(F.min("step").alias("step"))
    return best.agg(F.map_from_entries(F.collect_list(F.struct("band", "step"))).alias("_cut"))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = 0.05,
                 order_level: float = 0.001) -> DataFrame:
    """One row per row of ``docs``: its key, the ``base`` spans and the ``added`` spans.

    Spans are ``array<struct<start, rank, end, kind>>`` ordered by start, then kind;
    code points of the whole text, end exclusive. ``added`` holds random tokens that
    overlap no base span. Null and empty texts have no spans; repeated rows and keys
    are handled row by row, a null key is kept; an empty table gives an empty result;
    other columns are not read, so their names cannot clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    assign, access, hexes = base_spans(body)
    tokens = F.filter(located(body, CANDIDATE), lambda s: s["found"].rlike("[0-9]"))
    rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                              F.array_sort(F.concat(assign, access, hexes)).alias("base"), tokens.alias("tokens")))
    found = (rows.select(F.explode("tokens").alias("t")).select(F.col("t.found").alias("token"))
             .groupBy("token").agg(F.count(F.lit(1)).alias("copies")))
    tested = (battery(found).withColumn("band", band_of(F.col("size")))
              .withColumn("step", step_of(F.col("p_even"))))
    cut = cutoffs(tested, rate)
    secret = (tested.crossJoin(F.broadcast(cut))
              .filter((F.col("step") >= F.col("_cut")[F.col("band")]) & (F.col("p_order") >= order_level))
              .select("token"))
    # the few candidates outside the base spans meet the accepted tokens
    clear = F.filter("tokens", lambda t: clear_of(t, F.col("base")))
    hits = (rows.select("row", F.explode(clear).alias("t"))
            .join(secret, F.col("t.found") == F.col("token"))
            .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
                F.col("t.start").alias("start"), F.lit(3).alias("rank"), F.col("t.end").alias("end"),
                F.lit("random").alias("kind")))).alias("added")))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return (rows.join(hits, "row", "left")
            .select("key", "base", F.coalesce("added", none).alias("added")))


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the contract."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("key").alias(key), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_random"))
