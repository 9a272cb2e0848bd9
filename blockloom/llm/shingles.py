"""Sets of word shingles of many texts at once, as sorted 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

from blockloom.llm.hashing import keys_of, mix

_STEP = np.uint64(0xA0761D6478BD642F)


class Shingler:
    """Words end at ASCII blanks and are compared without the case of A to Z. One seed for all sets that are compared."""

    def __init__(self, words: int, seed: int = 0):
        self.words, self.seed = words, seed

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All hashes, ascending within a text, and the end of every text's."""
        parts = [(t or "").encode() for t in texts]
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        ends_of_text = np.cumsum([len(p) + 1 for p in parts])
        letters = (raw >= 65) & (raw <= 90)
        data = raw + letters.astype(np.uint8) * np.uint8(32)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        step = np.diff(blank.astype(np.int8), prepend=1)
        start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        word = keys_of(data, start, end, self.seed)
        of = np.searchsorted(ends_of_text, start, "right")  # the text of a word
        last_word = np.searchsorted(of, np.arange(len(texts)), "right")
        first_word = np.append(0, last_word[:-1])
        k, n = self.words, len(word)
        m = max(n - k + 1, 0)
        shingle = np.zeros(m, np.uint64)
        for i in range(k):
            shingle = mix(shingle * _STEP + word[i : i + m])
        whole = of[:m] == of[k - 1 :][:m] if m else np.zeros(0, bool)
        shingle, of_shingle = shingle[whole], of[:m][whole]
        short = np.flatnonzero((last_word > first_word) & (last_word - first_word < k))
        if len(short):  # too few words: the whole text is one
            one = np.zeros(len(short), np.uint64)
            for i in range(k - 1):
                here = first_word[short] + i < last_word[short]
                at = np.minimum(first_word[short] + i, n - 1)
                one = np.where(here, mix(one * _STEP + word[at] + np.uint64(i + 1)), one)
            shingle, of_shingle = np.concatenate([shingle, one]), np.concatenate([of_shingle, short])
        order = np.lexsort((shingle, of_shingle))
        shingle, of_shingle = shingle[order], of_shingle[order]
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (of_shingle[1:] != of_shingle[:-1])
        shingle, of_shingle = shingle[new], of_shingle[new]
        return shingle, np.searchsorted(of_shingle, np.arange(len(texts)), "right")


def set_key(hashes: np.ndarray) -> int:
    """63 bits that stand for a set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little") >> 1
