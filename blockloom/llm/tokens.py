"""Token ids of whole texts by a public tokenizer, as little-endian 16- or 32-bit integers.

Byte-level BPE never merges across the places where a single space or newline stands between two
other characters, nor between an ASCII letter and a mark after it. Texts are cut there, and the ids of
the pieces, most of which recur, are kept in a bounded table per worker: sorted 64-bit hashes and one
array of ids. Only pieces that are not in it go through the tokenizer. Texts with other blanks are cut
at single ones alone; texts with a special token's string, and tokenizers of other kinds, are encoded
in one go.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np

from blockloom.llm.hashing import keys_of, mix

PIECES = 2_000_000  # pieces a worker keeps; the table starts anew beyond that
PORTION = 1 << 22  # bytes that are cut and hashed at a time
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_SPACE, _LINE = 32, 10
_MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_LETTERS = np.isin(np.arange(256), np.frombuffer(bytes(range(65, 91)) + bytes(range(97, 123)), np.uint8))
_KIND = np.uint64(0xA0761D6478BD642F)


class Pieces:
    """Ids by hash of the piece."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)  # place of a key in at and size
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of every key, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.rows[place], -1)

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """keys are sorted and new."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.cumsum(size) - size
        flat = np.fromiter((i for x in ids for i in x), self.dtype, int(size.sum()))
        place = np.searchsorted(self.keys, keys)
        self.rows = np.insert(self.rows, place, len(self.at) + np.arange(len(keys)))
        self.keys = np.insert(self.keys, place, keys)
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])


class Encoder:
    """Ids of texts, as bytes, equal to Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        pre, post = spec.get("pre_tokenizer") or {}, spec.get("post_processor") or {}
        self.cut = (
            spec["model"]["type"] == "BPE"
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None
            and post.get("type") in (None, "ByteLevel")  # which only trims offsets
        )
        self.kept = Pieces(self.dtype)
        self.seed = int.from_bytes(os.urandom(8), "little")  # a worker's own, so no text can be made to collide with another

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [f.ids for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text; none for a null or empty one."""
        out: list[bytes] = [b""] * len(texts)
        whole: list[int] = []
        plain: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cut or any(s in text for s in self.special) or "\0" in text:
                whole.append(i)
                continue
            spaced = text.replace("\n", " ")
            # No blank but space and newline (others are not printable), and none beside another.
            if "  " in spaced or spaced[0] == " " or spaced[-1] == " " or not spaced.isprintable():
                out[i] = b"".join(map(self._bytes, self._ids(_CUT.split(text))))
                continue
            plain.append(i)
            size += len(text)
            if size > PORTION:
                self._plain(plain, texts, out)
                plain, size = [], 0
        if plain:
            self._plain(plain, texts, out)
        if whole:
            for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
                out[i] = self._bytes(ids)
        return out

    def _plain(self, chosen: list[int], texts: list[str], out: list[bytes]) -> None:
        """Encode texts whose blanks are single spaces and newlines between other characters."""
        raw = b"\0" + b"\0".join([texts[i].encode() for i in chosen]) + b"\0"
        data = np.frombuffer(raw, np.uint8)
        apart = np.flatnonzero((data == _SPACE) | (data == _LINE) | (data == 0))
        start, end = apart[:-1] + 1, apart[1:]  # pieces without the blank before them
        kind = data[start - 1]
        marked = _MARKS[data[end - 1]] & _LETTERS[data[end - 2]] & (end - start > 1)
        # A mark after a letter is a piece of its own, of kind 1.
        places = np.flatnonzero(marked)
        mark_at = end[places] - 1
        end = end - marked
        order_after = places + 1
        start, end = np.insert(start, order_after, mark_at), np.insert(end, order_after, mark_at + 1)
        kind = np.insert(kind, order_after, 1)

        keys = mix(keys_of(data, start, end, self.seed) + kind.astype(np.uint64) * _KIND)
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        rows = self.kept.find(unique)
        new = np.flatnonzero(rows < 0)
        if len(new):
            if len(self.kept.keys) + len(new) > PIECES:
                self.kept.clear()
                new = np.arange(len(unique))
            before = {_SPACE: " ", _LINE: "\n", 0: "", 1: ""}
            pieces = [
                before[k] + raw[a:b].decode()
                for k, a, b in zip(kind[first[new]].tolist(), start[first[new]].tolist(), end[first[new]].tolist())
            ]
            self.kept.add(unique[new], self._ids(pieces))
            rows = self.kept.find(unique)
        row = rows[which]
        size = self.kept.size[row]
        stop = np.cumsum(size)
        ids = self.kept.flat[np.repeat(self.kept.at[row] - stop + size, size) + np.arange(stop[-1])]
        heads = np.flatnonzero(kind == 0)  # the first piece of every text
        bounds = np.append((stop - size)[heads], stop[-1]) * self.dtype.itemsize
        packed = ids.tobytes()
        for i, a, b in zip(chosen, bounds[:-1].tolist(), bounds[1:].tolist()):
            out[i] = packed[a:b]


def encoder(path: str) -> Encoder:
    """This worker's encoder, which stays for its later tasks."""
    kept = sys.modules.setdefault("_worker_encoders", types.ModuleType("_worker_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
