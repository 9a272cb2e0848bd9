"""Toxicity by a weighted finite-state grammar over clauses.

Three transducers, the last two of them tables, work in turn. LEXICAL turns words into classes: insult,
threat, target, negation, report, conjunction, other, and marks into pause and stop; it is a set of
words and of stems (a stem takes any ending). SCOPE marks insults and threats that stand in reported
speech (after a reporting word, up to the stop) or are negated (after a negation, up to a conjunction or a
pause). TARGET pairs them with a target at most REACH words before or behind, and gives off the matched
clause: a targeted one, or an insult alone among other words; a word that stands for itself and a threat
without target match nothing. SCOPE and TARGET are composed into one machine of (state, class) -> (state,
matches) before texts are read. A document's score is a logistic function of the logarithms of its
matched clauses by kind: in all, and targeted, bare and threat, each plain, negated or reported, with a weight each.

Insults are learned from labelled rows: of all words and stems that (almost) no clean text has, those
that cover toxic texts are picked greedily, and those that are common in them are added. Target, threat, negation, reporting words and
conjunctions are fixed lists; what they change is learned: the logistic weights are fitted to the clause counts of the same rows.
Fitting uses at most about `fit_rows` labelled rows, chosen by hash of doc_id; a parameter, and the
only bound: every whole text is scored.

Labels that are null, or whose document is missing, are not used; of several labels of a document the
largest counts. Null and empty texts match nothing and get the score of no match. Equal rows score
alike; a null doc_id is kept as it is and is never used for fitting. Without labels of both kinds nothing
can be learned, and every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import rows_of, table
from blockloom.session import stored

# Word classes of English, German, French and Spanish.
TARGETS = "you your yours u ur he she they him her them du dich dir dein ihr euch tu toi ton ta vous votre tú te ti usted".split()
THREATS = "kill hurt destroy beat shoot stab murder töten umbringen tuer frapper matar golpear".split()
NEGATIONS = "not never no none nobody isn't aren't wasn't don't nicht kein keine nie niemals pas jamais aucun nunca jamás".split()
REPORTS = "said says saying told called calls quoted wrote alleged according sagte nannte dit disait appelé dijo llamó".split()
CONJUNCTIONS = "but and or although because while aber und oder weil sondern obwohl mais et ou car pero sino y o porque aunque".split()
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.,;:!?\n]")
LETTERS = re.compile(r"[^\W\d_]+")
CLASSES = ("insult", "threat", "target", "negation", "report", "conjunction", "other", "pause", "stop")
MARKS = {",": "pause", ";": "pause", ":": "pause", ".": "stop", "!": "stop", "?": "stop", "\n": "stop"}
WAYS = ("plain", "negated", "reported")
KINDS = tuple(f"{match}_{way}" for match in ("targeted", "bare", "threat") for way in WAYS)
FEATURES = ("matched", *KINDS)  # a kind that no labelled text has still counts as matched
DEVIATION = 0.1  # a kind's weight departs from the common one only as far as many labelled texts ask for it
REACH = 4  # words from an insult or a threat to its target, at most
PORTION = 1 << 21


@dataclass(frozen=True)
class Fit:
    fit_rows: int = 20_000
    stem_lengths: tuple[int, ...] = (4, 5, 6)
    least_docs: int = 3  # toxic texts that an entry must cover anew
    clean_rate: float = 0.05  # of an entry's rate in toxic texts, at most, in clean ones
    common_rate: float = 0.1  # entries in so many toxic texts are taken anyway


def _features(text: str, lengths: tuple[int, ...]) -> set[str]:
    """A text's words, and stems of them with a star at the end."""
    words = set(LETTERS.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in lengths if len(w) > n}


class Lexicon:
    """The lexical transducer: class of a word."""

    def __init__(self, insults: list[str]):
        self.words = {w: "insult" for w in insults if not w.endswith("*")}
        self.stems = {w[:-1] for w in insults if w.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        for kind, own in (
            ("threat", THREATS), ("negation", NEGATIONS), ("report", REPORTS), ("target", TARGETS), ("conjunction", CONJUNCTIONS),
        ):
            for w in own:
                self.words.setdefault(w, kind)

    def __call__(self, word: str) -> str:
        if word in MARKS:
            return MARKS[word]
        if any(word[:n] in self.stems for n in self.lengths if n < len(word)):
            return "insult"
        return self.words.get(word, "other")

    def finder(self):
        """An automaton over characters that finds texts where anything can match."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for w in [*self.stems, *(w for w, k in self.words.items() if k in ("insult", "threat"))]:
            found.add_word(w, len(w))
        found.make_automaton()
        return found


class Scope:
    """Classes to classes with a way: (head, way) for insults and threats. States: (negated, reported)."""

    start = (False, False)

    def step(self, state: tuple, symbol: str) -> tuple[tuple, list]:
        negated, reported = state
        if symbol in ("insult", "threat"):
            return state, [(symbol, "reported" if reported else "negated" if negated else "plain")]
        if symbol == "stop":
            return self.start, [symbol]
        negated = symbol == "negation" or (negated and symbol not in ("conjunction", "pause"))
        return (negated, reported or symbol == "report"), [symbol]


class Target:
    """Heads and classes to kinds. States: (words that the last target still reaches, the head that waits for one
    and for how many words, whether another word has been there)."""

    start = (0, None, 0, False)

    def step(self, state: tuple, symbol) -> tuple[tuple, list]:
        near, head, left, others = state
        out = []

        def alone() -> None:
            if head and head[0] == "insult" and others:
                out.append(f"bare_{head[1]}")

        def match(own: tuple) -> None:
            out.append(f"{'threat' if own[0] == 'threat' else 'targeted'}_{own[1]}")

        if symbol == "stop":
            alone()
            return self.start, out
        if isinstance(symbol, tuple):  # a head
            alone()
            if near:
                match(symbol)
                return (near - 1, None, 0, others), out
            return (0, symbol, REACH, others), out
        others = others or symbol != "pause"
        if symbol == "target":
            if head:
                match(head)
            return (REACH, None, 0, others), out
        if head and left == 1:
            alone()
            head = None
        return (max(near - 1, 0), head, left - 1 if head else 0, others), out


def compose(first, second, symbols=CLASSES) -> list[dict[str, tuple[int, tuple[str, ...]]]]:
    """The machine that feeds what the first gives off to the second: by state (0 is the start) and symbol."""
    numbers = {(first.start, second.start): 0}
    table, open_ = [], [(first.start, second.start)]
    for a, b in open_:  # grows while it is read
        row = {}
        for symbol in symbols:
            next_a, middle = first.step(a, symbol)
            next_b, out = b, []
            for m in middle:
                next_b, more = second.step(next_b, m)
                out += more
            after = (next_a, next_b)
            if after not in numbers:
                numbers[after] = len(numbers)
                open_.append(after)
            row[symbol] = (numbers[after], tuple(out))
        table.append(row)
    return table


def clauses(text: str, lexicon: Lexicon, machine: list) -> Counter:
    """Matched clauses of a lower-case text by kind."""
    counts: Counter = Counter()
    state = 0
    for m in WORD.finditer(text):
        state, found = machine[state][lexicon(m.group())]
        counts.update(found)
    counts.update(machine[state]["stop"][1])
    return counts


class Scorer:
    def __init__(self, insults: list[str]):
        self.lexicon = Lexicon(insults)
        self.finder = self.lexicon.finder()
        self.machine = compose(Scope(), Target())

    def counts(self, text: str | None) -> list[float]:
        """Logarithms of one more than the document's matched clauses, in all and by kind."""
        lower = (text or "").lower()
        for end, length in self.finder.iter(lower):
            begin = end - length
            if begin < 0 or not lower[begin].isalpha():  # a word begins here
                found = clauses(lower, self.lexicon, self.machine)
                return [math.log1p(n) for n in (sum(found.values()), *(found[k] for k in KINDS))]
        return [0.0] * len(FEATURES)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """(text, toxic) of the rows to learn from: their ids, a bounded number, are broadcast."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, fit.fit_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def learn_insults(rows: DataFrame, fit: Fit) -> list[str]:
    """Words and stems, picked so that each covers toxic texts which those before do not."""
    lengths = fit.stem_lengths

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for texts, toxic in rows_of(batches, ["text", "toxic"], PORTION, "text"):
            for text, label in zip(texts, toxic):
                seen[label > 0].update(_features(text or "", lengths))
        keys = list(seen[1])  # an entry that no toxic text of this task has still counts for its clean texts
        keys += [k for k in seen[0] if k not in seen[1]]
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            columns = [pa.array(part), pa.array([seen[1][k] for k in part]), pa.array([seen[0][k] for k in part])]
            yield pa.RecordBatch.from_arrays(columns, ["entry", "bad", "good"])

    totals = {r["toxic"] > 0: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not totals.get(True) or not totals.get(False):
        return []
    counted = rows.mapInArrow(count, "entry string, bad bigint, good bigint").groupBy("entry")
    counted = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(f"bad >= {fit.least_docs}")
    rare = F.col("good") / totals[False] <= fit.clean_rate * F.col("bad") / totals[True]
    # Entries that neither the greedy choice nor the common ones can ever take stay in Spark.
    common = max(fit.least_docs, fit.common_rate * totals[True])
    coverer = F.col("bad") - 10 * F.col("good") >= fit.least_docs
    frequent = (F.col("bad") >= common) & (50 * F.col("good") <= F.col("bad"))
    kept = counted.where(rare & (coverer | frequent)).collect()  # what at most fit_rows texts have in common
    good = {r["entry"]: r["good"] for r in kept}

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows_of(batches, ["text"], PORTION, "text"):
            own = [sorted(_features(t or "", lengths) & good.keys()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], ["entries"])

    toxic = rows.where("toxic > 0").select("text").mapInArrow(cover, "entries array<string>").collect()
    where: dict[str, set[int]] = {}
    for i, r in enumerate(toxic):  # at most fit_rows rows
        for e in r["entries"]:
            where.setdefault(e, set()).add(i)
    chosen, open_ = [], set(range(len(toxic)))
    # The most texts less what it would catch of clean ones; a short stem before a long one. Gains only
    # fall, so an entry whose gain has not changed since it was put back is the best.
    ranked = sorted(where, key=lambda e: (len(where[e]), -len(e), e), reverse=True)
    heap = [(10 * good[e] - len(where[e]), i) for i, e in enumerate(ranked)]
    heapq.heapify(heap)
    while heap:
        loss, i = heapq.heappop(heap)
        now = 10 * good[ranked[i]] - len(where[ranked[i]] & open_)
        if now > loss:
            if -now >= fit.least_docs:
                heapq.heappush(heap, (now, i))
            continue
        if -now < fit.least_docs:
            break
        open_ -= where.pop(ranked[i])
        chosen.append(ranked[i])
    # Few labels are covered before all common entries are seen.
    return chosen + sorted(e for e, own in where.items() if len(own) >= common and 50 * good[e] <= len(own))


def count_clauses(docs: DataFrame, keep: list[str], insults: list[str], fit: Fit) -> DataFrame:
    """The kept columns with one column of clause counts per kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(insults)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = np.array([scorer.counts(t.as_py()) for t in texts], np.float64).reshape(-1, len(FEATURES))
            own = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found.T)], [*keep, *FEATURES])

    rows = docs.select(*keep, F.col("text").cast("string"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep]
    return rows.mapInArrow(run, ", ".join([*kept, *(f"`{k}` double" for k in FEATURES)]))


def fit_weights(rows: DataFrame, insults: list[str], fit: Fit) -> tuple[list[float], float]:
    """Weights by kind, and the intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counted = stored(count_clauses(rows, ["toxic"], insults, fit))
    scales = [DEVIATION if k in KINDS else 1.0 for k in FEATURES]
    scaled = counted.select("toxic", *[(F.col(k) * c).alias(k) for k, c in zip(FEATURES, scales)])
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(scaled)
    ready = ready.withColumn("label", (F.col("toxic") > 0).cast("double"))
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-5, maxIter=50, standardization=False).fit(ready)
    return [float(w) * c for w, c in zip(model.coefficients, scales)], float(model.intercept)


def toxicity(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """(doc_id, score) of all docs."""
    rows = stored(labelled(docs, labels, fit))
    insults = learn_insults(rows, fit)
    if not insults:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    weights, intercept = fit_weights(rows, insults, fit)
    total = sum((F.col(k) * w for k, w in zip(FEATURES, weights)), F.lit(intercept))
    found = count_clauses(docs, ["doc_id"], insults, fit)
    return found.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity(docs, labels)
    predicted = (F.col("score") >= 0.7).cast("int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
