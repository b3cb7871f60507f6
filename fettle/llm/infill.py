"""Fill-in-middle transformation with a sparse exception index.

A text is handled as its UTF-8 bytes. Most characters are one byte, so the index records
only the exceptions: the code-point positions of multibyte characters and the bytes they
have in excess, summed up. ``searchsorted`` on the exceptions turns code points into bytes
and back; between two exceptions a place is found by addition alone, and a text of ASCII
characters has an empty index. Unit ends are found in the bytes, the cuts are converted.

Cuts, form and order of a document depend on a hash of its key and on nothing else.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.llm.rows import layout, named, packed, unpacked

#: fixed values: the marks before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT, SEED = 50, 80, 42


class Exceptions:
    """Multibyte characters of UTF-8 bytes: their code points and excess bytes."""

    def __init__(self, data: bytes):
        import numpy as np

        raw = np.frombuffer(data, np.uint8)
        self.size = len(raw)
        if data.isascii():
            lead = np.zeros(0, np.int64)
            excess = lead
        else:
            lead = np.flatnonzero(raw >= 0xC0)  # first bytes of multibyte characters
            excess = 1 + (raw[lead] >= 0xE0).astype(np.int64) + (raw[lead] >= 0xF0)
        self.excess = np.concatenate(([0], np.cumsum(excess)))
        self.at = lead - self.excess[:-1]  # code points before each exception
        self.byte = lead
        self.chars = self.size - int(self.excess[-1])

    def bytes_of(self, points):
        """Byte places of code-point places."""
        import numpy as np

        points = np.asarray(points, np.int64)
        return points + self.excess[np.searchsorted(self.at, points)]

    def points_of(self, places):
        """Code-point places of byte places between characters."""
        import numpy as np

        places = np.asarray(places, np.int64)
        return places - self.excess[np.searchsorted(self.byte, places)]


def word_ends(data: bytes):
    """Byte places after each unit: white space with the word that follows it, or what is left of white space."""
    import numpy as np

    raw = np.frombuffer(data, np.uint8)
    white = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    last = np.append(white[1:], True) & ~white  # last byte of each word
    ends = np.flatnonzero(last) + 1
    return np.append(ends, len(raw)) if len(raw) and white[-1] else ends


def hashes(key, seed: int) -> list[int]:
    """Four unsigned numbers of 32 bits from seed and key; a null key counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def arranged(key, text: str | None, unit: str = "word", fim: int = FIM_PERCENT, spm: int = SPM_PERCENT, seed: int = SEED):
    """(units, form, output, code points of prefix, of middle) of one text; the last two None if plain.

    Two cuts are drawn from the numbers of units before them, 0 to all.
    """
    text = text or ""
    data = text.encode()
    index = None
    if unit == "char":
        index = Exceptions(data)
        n = index.chars
    else:
        ends = word_ends(data)
        n = len(ends)
    h1, h2, h3, h4 = hashes(key, seed)
    if not text or h3 % 100 >= fim or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", text, None, None
    index = index or Exceptions(data)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if unit == "char":
        points, (i, j) = (a, b), index.bytes_of([a, b]).tolist()
    else:
        i, j = (int(ends[k - 1]) if k else 0 for k in (a, b))
        points = index.points_of([i, j]).tolist()
    head, mid, tail = data[:i], data[i:j], data[j:]
    form = "spm" if h4 % 100 < spm else "psm"
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    parts = [marks[1], tail, marks[0], head] if form == "spm" else [marks[0], head, marks[1], tail]
    return n, form, b"".join([*parts, marks[2], mid]).decode(), points[0], points[1] - points[0]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "word", fim: int = FIM_PERCENT,
              spm: int = SPM_PERCENT, seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with ``columns`` (by default all but the text) and ``units``, ``form``, ``output``,
    ``prefix_chars``, ``middle_chars``.

    ``form``: ``plain`` (the text), ``psm`` or ``spm``; of texts without a mark ``fim`` percent are cut, ``spm``
    percent of these begin with the suffix. ``unit``: ``word`` or ``char``. A null text counts as empty and stays
    plain, as does a text that holds a mark; a null key hashes as the empty key; repeated rows are each
    transformed alike; texts of any length are cut whole; an empty table gives an empty result; an incoming column
    of a result's name is replaced.
    """
    import pyarrow as pa

    if unit not in ("word", "char"):
        raise ValueError(f"unit must be word or char, not {unit}")

    def run(batches):
        for batch in batches:
            out = [arranged(k.as_py(), t.as_py(), unit, fim, spm, seed) for k, t in zip(batch.column(1), batch.column(2))]
            n, form, output, head, mid = zip(*out) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(output, pa.string()),
                 pa.array(head, pa.int64()), pa.array(mid, pa.int64())],
                ["row", "units", "form", "output", "prefix_chars", "middle_chars"])

    columns = [c for c in docs.columns if c != text] if columns is None else columns
    rows = packed(docs, columns, key=named(key).cast("string"), body=named(text))
    schema = layout(rows.select("row"), units="bigint", form="string", output="string", prefix_chars="bigint", middle_chars="bigint")
    return unpacked(rows.mapInArrow(run, schema), columns,
                    **{c: F.col(c) for c in ("units", "form", "output", "prefix_chars", "middle_chars")})


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: marks occur once each, as no text that holds one is cut."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    mid = F.substring_index(output, MIDDLE, -1)
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), mid, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), mid, between(SUFFIX, PREFIX))).otherwise(output))


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the contract."""
    return found.select(key, F.col("units").alias("n"), "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM d),
k AS (SELECT *, len(units) AS n,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS two,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                       OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
                  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(units[1:least(one, two)], '') AS pre,
             array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS mid,
             array_to_string(units[greatest(one, two) + 1:], '') AS suf FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
