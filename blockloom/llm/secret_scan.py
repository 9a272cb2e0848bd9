"""Secrets in texts: fixed patterns, and strings in a sensitive context that zstandard finds no model for.

Patterns give the base spans. Beside them, every run of key characters that follows a sensitive word (or
stands in an address as a password) is a candidate. Its novelty is what it adds to the compressed size of
the text around it, with a compressor that starts from a dictionary of the corpus' identifiers: a name or
word costs some bytes for a reference, a random string nearly all of its own. Candidates whose added
bytes are at least a share of their own length are spans of the kind `novel`.

The dictionary holds the identifiers without digits that occur most often in all texts, the most frequent
ones last (nearest), up to a number of bytes; a secret, however often it is copied, is none of them.

A null or empty text has no spans. Rows are worked off one by one, where they are read, so equal rows give
equal results and a row without doc_id keeps a null one; other columns are not read. No rows give no rows.
Spans are in code points, the end exclusive; a span of an `assign` is the whole match.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import rows_of, table
from blockloom.session import stored

PORTION = 1 << 20  # characters that are worked off at a time
SHARES = 1024  # parts that identifiers of one frequency are dealt into
COUNTED = 200_000  # identifiers a task counts before it hands the counts on

# The patterns of base spans.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of 18 and more: the greedy run from its first AKIA
_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

# Words that make what follows them sensitive, and parts of them for a quick look.
_SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase)|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth(?:orization)?|bearer"
    r"|basic|credentials?|signature|session[_ -]?id|cookie|connection[_ -]?string|salt|nonce|ssh-(?:rsa|ed25519)|://[^\s/:@]*:",
    re.IGNORECASE | re.ASCII,
)
_SENSITIVE_PARTS = (
    "pass", "pwd", "secret", "token", "key", "auth", "bearer", "basic", "credential", "signature", "session", "cookie",
    "connection", "salt", "nonce", "ssh-", "://",
)
_RUN = re.compile(r"[A-Za-z0-9+/_=~-]+")
_IDENTIFIER = re.compile(r"[A-Za-z_]{4,32}", re.ASCII)


@dataclass(frozen=True)
class Novelty:
    """When a candidate is reported."""

    share: float = 0.6  # added bytes of its own length
    shortest: int = 12  # characters
    reach: int = 48  # characters after the sensitive word in which it begins
    around: int = 512  # characters on either side that it is measured against
    dictionary: int = 1 << 16  # bytes
    level: int = 3


def count_identifiers(docs: DataFrame) -> DataFrame:
    """(identifier, n) of all texts, added up in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["identifier", "n"]
            )
            counts.clear()
            return found

        for (texts,) in rows_of(batches, ["text"], PORTION, "text"):
            for text in texts:
                if text:
                    counts.update(_IDENTIFIER.findall(text))
            if len(counts) > COUNTED:
                yield rows()
        yield rows()

    made = docs.select(F.col("text").cast("string")).mapInArrow(run, "identifier string, n bigint")
    return made.groupBy("identifier").agg(F.sum("n").alias("n"))


def identifier_dictionary(docs: DataFrame, size: int) -> bytes:
    """The most frequent identifiers, blank-separated, the most frequent last, up to `size` bytes.

    A histogram of frequencies, in steps of an eighth of a power of two, says which of them can get in; of
    the step where room ends, a share by hash. So the driver gets some hundred counts and `size` / 5 words.
    """
    counts = stored(count_identifiers(docs).where("n > 1"))
    step = F.floor(F.log2("n") * 8).cast("int")
    room, least, share = size // 5, 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        least, share = r["step"], min(SHARES, SHARES * room // r["n"])
        room -= r["n"]
        if room <= 0:
            break
    own = F.pmod(F.xxhash64("identifier"), F.lit(SHARES)) < share
    top = counts.where((step > least) | (step == least) & own).collect()
    chosen, used = [], 0
    for r in sorted(top, key=lambda r: (-r["n"], r["identifier"])):
        used += len(r["identifier"]) + 1
        if used > size:
            break
        chosen.append(r["identifier"])
    return " ".join(reversed(chosen)).encode()


class Scanner:
    def __init__(self, dictionary: bytes, rule: Novelty = Novelty()):
        import zstandard

        # The library wants some bytes in a dictionary.
        known = zstandard.ZstdCompressionDict(dictionary.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=rule.level)
        self.rule = rule
        self._compress = zstandard.ZstdCompressor(level=rule.level, dict_data=known).compress

    @staticmethod
    def base(text: str, lower: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by the fixed patterns; lower is the text in lower case, for a quick look."""
        found = []
        if any(w in lower for w in _ASSIGN_WORDS):
            found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
        found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
        return found

    def added(self, text: str, start: int, end: int) -> int:
        """Bytes that the string adds to the compressed text around it."""
        before, after = text[max(0, start - self.rule.around) : start], text[end : end + self.rule.around]
        size = lambda t: len(self._compress(t.encode("utf-8", "replace")))
        return size(before + text[start:end] + after) - size(before + after)

    def novel(self, text: str, lower: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """Candidates that compress badly; taken are spans that are reported anyhow, in order."""
        if not any(p in lower for p in _SENSITIVE_PARTS):
            return []
        rule, found, done, at = self.rule, [], 0, 0
        for word in _SENSITIVE.finditer(text):
            for run in _RUN.finditer(text, max(word.end(), done)):
                start, end = run.span()
                if start > word.end() + rule.reach:
                    break
                done = end
                if end - start < rule.shortest or not _mixed(run.group()):
                    continue
                while at < len(taken) and taken[at][1] <= start:
                    at += 1
                if any(a < end for a, _ in taken[at : at + 1]):
                    continue
                if self.added(text, start, end) >= rule.share * (end - start):
                    found.append((start, end, "novel"))
        return found

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """All spans, by start and then by kind."""
        if not text:
            return []
        lower = text.lower()
        base = self.base(text, lower)
        taken: list[tuple[int, int]] = []
        for start, end, _ in sorted(base):  # as disjoint spans
            if taken and start <= taken[-1][1]:
                taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
            else:
                taken.append((start, end))
        return sorted(base + self.novel(text, lower, taken), key=lambda s: (s[0], KINDS.index(s[2])))


def _mixed(run: str) -> bool:
    """Whether a run has letters and digits, or capitals inside: a plain word is never a key."""
    letters = sum(map(str.isalpha, run))
    return 0 < letters < len(run) - run.count("-") - run.count("_") or (not run[1:].islower() and not run.isupper())


def scan(docs: DataFrame, dictionary: bytes, rule: Novelty = Novelty()) -> DataFrame:
    """(doc_id, found): an array of (kind, start, end, secret) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(dictionary, rule)
        for doc_ids, texts in rows_of(batches, ["doc_id", "text"], PORTION, "text"):
            rows = [
                [{"kind": k, "start": a, "end": b, "secret": text[a:b]} for a, b, k in scanner.spans(text)] for text in texts
            ]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(rows, _FOUND)], ["doc_id", "found"])

    found = "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,secret:string>>"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, found)


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    written = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        *[number(k) for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", written), ",").alias("spans"),
    )


def op11_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, measured against a dictionary of all documents' identifiers."""
    docs = table(spark, sf_dir, "documents")
    rule = Novelty()
    return digest(scan(docs, identifier_dictionary(docs, rule.dictionary), rule))
