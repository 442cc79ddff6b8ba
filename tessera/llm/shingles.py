"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

from tessera.llm.common import Prefixes, mix, runs_of

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes above which a word has a cryptographic hash.
LONG = 256
_STEP = np.uint64(0xD1342543DE82EF95)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and each row's first word (n + 1 offsets)."""
    raw = _LOWER[raw]
    begin, end = runs_of(~_SPACE[raw], off)
    found = Prefixes(raw).hash(begin, end)
    # Polynomials modulo 2**64 can be made to agree on long words.
    for i in np.flatnonzero(end - begin > LONG).tolist():
        found[i] = int.from_bytes(hashlib.blake2b(raw[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return found, np.searchsorted(begin, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted; a shorter row is one shingle, a row without words none."""
    hashes, first = word_hashes(raw, off)
    n = len(hashes)
    run = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        run = run * _STEP + hashes[k : n - words + 1 + k] if len(run) else run
    run = mix(run)
    out = []
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            found = run[a : b - words + 1].copy()
            found.sort()
            keep = np.ones(len(found), bool)
            keep[1:] = found[1:] != found[:-1]
            out.append(found[keep])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * _STEP + h
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
