"""Words and hashed word sequences of text batches, computed with array operations.

Word = maximal run of letters and digits, lower-cased. A sequence of k words is known by a 64-bit mix of the hashes of
its words, so that whole batches are handled by numpy instead of Python objects for each sequence.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


class _Hashes(dict):
    """Hash of each word a worker has met lately."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()
#: Words whose hashes a worker keeps, about 150 bytes each.
KEPT_WORDS = 300_000


def words(text: str | None, fold_yo: bool = False, drop_tags: bool = False) -> list[str]:
    if not text:
        return []
    if drop_tags and "<" in text:
        text = TAG.sub(" ", text)
    text = text.lower()
    return WORD.findall(text.replace("ё", "е") if fold_yo else text)


def hash_batch(token_lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of the whole batch, offsets of the lists in it)."""
    offsets = np.zeros(len(token_lists) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in token_lists], out=offsets[1:])
    flat = [w for t in token_lists for w in t]
    if not flat:
        return np.empty(0, dtype=np.uint64), offsets
    if len(_HASHES) > KEPT_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, flat), dtype=np.uint64, count=len(flat)), offsets


def mix(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words from each position on, without regard to where lists end; len(hashes) - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, np.uint64(salt) + np.uint64(k), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ (out >> _S29)) * _M1 + hashes[i : i + n] * _M2
        out ^= out >> _S32
        out *= _M1
    return out ^ (out >> _S29)
