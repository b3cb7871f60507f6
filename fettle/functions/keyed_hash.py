"""HMAC-SHA256 as a Column expression (no UDF, stays in codegen)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from fettle import policy as P

BLOCK = 64


def _pads(key: bytes) -> tuple[str, str]:
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner = bytes(b ^ 0x36 for b in key).hex()
    outer = bytes(b ^ 0x5C for b in key).hex()
    return inner, outer


def hmac_sha256_hex(message: Column, key: bytes) -> Column:
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def pseudonym(personnel_id: Column, key: bytes) -> Column:
    return F.concat(
        F.lit(P.PSEUDONYM_PREFIX),
        F.substring(hmac_sha256_hex(personnel_id.cast("string"), key), 1, P.PSEUDONYM_HEX),
    )
