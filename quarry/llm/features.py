"""Hashed text features that the classifiers share: words and character n-grams by rolling hashes over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from quarry.llm.common import Kept
from quarry.session import ship

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at a time; a run of bytes without a separator that is longer is hashed in parts.
CHUNK = 1 << 20


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_KEPT = Kept()


def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _KEPT.once("powers", lambda: (_powers(_BASE), _powers(_INVERSE)))


def chunks(data: bytes, stop: bytes = b" \n") -> list[bytes]:
    """The bytes in runs of at most CHUNK, cut after a separator where there is one."""
    out = []
    while len(data) > CHUNK:
        at = max(data.rfind(s, 0, CHUNK) for s in (stop[i : i + 1] for i in range(len(stop)))) + 1 or CHUNK
        out.append(data[:at])
        data = data[at:]
    return [*out, data] if data else out


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes above space) of at most CHUNK bytes."""
    if not data:
        return np.zeros(0, np.uint64)
    up, down = _tables()
    array = np.frombuffer(data, np.uint8)
    inside = array > 32
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((array.astype(np.uint64) + np.uint64(1)) * up[: len(array)], dtype=np.uint64)))
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return (hashes ^ (hashes >> np.uint64(29))) * _MIX


def gram_hashes(data: bytes, n: int) -> np.ndarray:
    """A 64-bit hash of each n-gram of bytes."""
    array = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    if len(array) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(array) - n + 1, np.uint64)
    for i in range(n):
        out = (out + array[i : len(array) - n + 1 + i]) * np.uint64(_BASE)
    return (out ^ (out >> np.uint64(29))) * _MIX


def buckets(hashes: np.ndarray, width: int) -> np.ndarray:
    """Bucket numbers below width, a power of two, from the high bits."""
    return (hashes >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


ship(__name__)
