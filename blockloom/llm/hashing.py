"""64-bit keys of many byte strings at once, by a seed that texts can not know.

Strings of up to 32 bytes are hashed 8 bytes at a time, with a mixing step after each (a polynomial of
the bytes would collide for strings that can be written down without knowing anything); longer ones, which
are rare as words, go through a keyed digest.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHORT = 32  # bytes
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SIZE = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    for shift in (32, 29, 32):
        x = (x ^ (x >> np.uint64(shift))) * _MIX
    return x


def keys_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A key for every data[start:end]; data are bytes."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))  # the 8 bytes from every place on
    found = mix(size.astype(np.uint64) * _SIZE + np.uint64(seed))
    short = np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        short = short[size[short] > at]
        if not len(short):
            break
        block = eight[start[short] + at]
        spare = np.maximum(8 - (size[short] - at), 0).astype(np.uint64) * np.uint64(8)
        block = block << spare  # bytes beyond the string fall out
        found[short] = mix(found[short] ^ block)
    secret = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=secret).digest()
        found[i] = np.uint64(int.from_bytes(digest, "little"))
    return found
