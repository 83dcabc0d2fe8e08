"""Sets of five-word shingles of whole batches of texts, in numpy, and exactly from strings."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

WIDTH, CHUNK = 5, 1 << 17
_B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INV = np.uint64(pow(_B, -1, 1 << 64))
_B = np.uint64(_B)
_MULT = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_UPPER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MULT[0]
    x = (x ^ (x >> np.uint64(29))) * _MULT[1]
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_B, _INV)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word raw[start:end], over blocks of about CHUNK bytes, so that the sums don't grow with the text."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
        part = raw[lo:int(ends[j - 1])]
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=total[1:])
        out[i:j] = mix((total[ends[i:j] - lo] - total[starts[i:j] - lo]) * down[starts[i:j] - lo])
        i = j
    return out


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For non-null texts: sorted distinct shingle hashes, text after text, and the n + 1 offsets of the texts.

    Words are maximal runs of bytes but space and 9 to 13, with A-Z lower-cased; fewer than five words make one shingle.
    """
    n = len(texts)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64) if offs else np.zeros(n + 1, np.int64)
    if not n or offs[-1] == offs[0]:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]]
    offs = offs - offs[0]
    raw = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    first = np.zeros(len(raw) + 1, bool)
    first[offs] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    words = _word_hashes(raw, starts, ends)
    per_text = np.diff(np.searchsorted(starts, offs))
    first_word = np.concatenate([[0], np.cumsum(per_text)])
    joined = words * _MULT[0]
    for k in range(1, WIDTH):
        joined[:-k] += words[k:] * _MULT[k]
    joined = mix(joined)
    counts = np.where(per_text >= WIDTH, per_text - WIDTH + 1, np.minimum(per_text, 1))
    text_of = np.repeat(np.arange(n), counts)
    at = np.concatenate([[0], np.cumsum(counts)])
    hashes = joined[first_word[text_of] + np.arange(at[-1]) - at[text_of]]
    for i in np.flatnonzero((per_text > 0) & (per_text < WIDTH)):  # the sum above reached into the next text
        own = words[first_word[i]:first_word[i + 1]]
        hashes[at[i]] = mix(np.array([(own * np.array(_MULT[:len(own)])).sum() + np.uint64(len(own))], np.uint64))[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[at[:-1][counts > 0]] = True
    return hashes[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def exact_set(text: str) -> set[tuple[str, ...]]:
    """The shingles of one text as words."""
    words = _WORD.findall(text.translate(_UPPER) if not text.isascii() else text.lower())
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(WIDTH)]))
