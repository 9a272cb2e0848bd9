"""Canonical length-limited Huffman codes over integer ids: building, packing and table-driven unpacking.

A block holds ids in one stream of bits. Every STEP-th id has a checkpoint, its
bit offset; unpacking goes on from all checkpoints of a block at once.
"""

from __future__ import annotations

import numpy as np

LONGEST = 20  # bits of the longest code, enough for 2**20 ids
STEP = 256  # ids between checkpoints


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The length of each symbol's code, 0 for a symbol that does not occur (package-merge)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes longer than {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    level, leaf = weights, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaf.append(order < n)
    take, own = 2 * n - 2, np.zeros(n, np.uint8)
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        own[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = own
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: in order of length, then of symbol."""
    out = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for symbol in order[np.count_nonzero(lengths == 0) :]:
        length = int(lengths[symbol])
        code <<= length - before
        out[symbol], before = code, length
        code += 1
    return out


def unpack_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every value of the next `longest` bits: symbol * 32 + length of its code."""
    longest = int(lengths.max(initial=1))
    table = np.zeros(1 << longest, np.int64)
    first = codes(lengths).astype(np.int64)
    for symbol in np.flatnonzero(lengths):
        free = longest - int(lengths[symbol])
        table[first[symbol] << free : (first[symbol] + 1) << free] = (symbol << 5) | int(lengths[symbol])
    return table, longest


def pack(ids: np.ndarray, code: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The bits of the ids, and the checkpoints as little-endian 64-bit integers."""
    if not len(ids):
        return b"", b""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word, room = start >> 6, 64 - (start & 63)
    value, over = code[ids], np.maximum(size - room, 0)
    shift = np.maximum(room - size, 0).astype(np.uint64)
    high = (value >> over.astype(np.uint64)) << shift
    firsts = np.flatnonzero(np.diff(word, prepend=-1))  # every word of 64 bits has the start of a code
    words = np.zeros(int(end[-1] + 63 >> 6) + 1, np.uint64)
    words[word[firsts]] = np.add.reduceat(high, firsts)
    across = np.flatnonzero(over)
    words[word[across] + 1] += value[across] << (64 - over[across]).astype(np.uint64)
    data = words.astype(">u8").tobytes()[: int(end[-1] + 7 >> 3)]
    return data, start[::STEP].astype("<i8").tobytes()


def unpack(data: bytes, points: bytes, n: int, table: np.ndarray, longest: int) -> np.ndarray:
    """The n ids of a block, from all its checkpoints at once."""
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    view = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = np.frombuffer(points, "<i8").copy()
    out = np.zeros((STEP, len(at)), np.int64)
    last = len(view) - 1
    drop = 32 - longest
    for step in range(min(STEP, n)):
        found = table[(view[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(drop)]
        out[step] = found
        at += found & 31
    return (out.T.reshape(-1)[:n]) >> 5
