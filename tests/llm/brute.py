"""Brute-force versions of the contracts, in plain Python over whole texts."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secret_spans(text):
    """(n_assign, n_access, n_hex, base_sha256)"""
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    count = [sum(s[1] == k for s in spans) for k in range(3)]
    return (*count, sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_spans(text):
    """(n_email, n_ip, n_card, n_phone, base_sha256)"""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    out, counts = [], []
    for kind, pattern, ok in kinds:
        found = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if ok(m[0])]
        counts.append(len(found))
        out += found
    return (*counts, sha(",".join(out)))


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def passages(texts, items, window=10):
    """Per text (n_words, n_hit, n_items, items_sha256, contaminated)."""
    phrases = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i:i + window]), set()).add(str(name))
    sizes = sorted({len(p) for p in phrases})
    out = []
    for text in texts:
        w = words(text)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := phrases.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        out.append((len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def fingerprint(text, size=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, ids, radius=4):
    """Component of each position: the smallest id reachable."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, name in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), name) if x is not None), default=None)
    return [least[find(i)] for i in range(len(prints))]


def crc(text):
    return zlib.crc32((text or "").encode())


def size(text):
    return len((text or "").encode()) + 8
