"""Toxicity by a weighted lexicon that is learned from labelled rows.

Texts are folded: compatibility forms, lower case, look-alike letters and
digits that stand for letters. Lexicon entries are whole words and word
beginnings that are far likelier in toxic documents; their weight is the
log-odds. An Aho-Corasick automaton finds them, the longest entry counts
where several begin together, and matches inside an exception phrase
(words and word pairs that only clean documents have) do not. A logistic
curve over the weight sum, alone and by document length, gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.llm.common import fold_of, small_slices
from affinium.llm.registry import query, table
from affinium.session import materialise

# The classifier is fitted on this many labelled rows at most, the first by a hash of their id.
SAMPLE_ROWS = 20_000
LEXICON_SIZE = 500
EXCEPTIONS_SIZE = 500
LEAST_DOCUMENTS = 3
LEAST_ODDS = 3.0
SHORTEST, LONGEST = 5, 9
# Terms that a task holds before it hands over their counts, and text bytes handled at once.
HELD_TERMS = 100_000
SLICE_BYTES = 1 << 20
# Length, in words, that a very short text is taken to have besides its own.
LENGTH_PRIOR = 20

# Letters that look like Latin ones, and digits and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FOLDS = str.maketrans(LOOK_ALIKES | DIGITS)
GAPS = re.compile(r"\W+")


def fold(text: str | None) -> str:
    """Words of a text, folded, with one space around each."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    # A sign inside a word stands for a letter; elsewhere folding it changes no word much.
    return f" {GAPS.sub(' ', text.lower().translate(FOLDS)).strip()} "


class Lexicon:
    """Entries (` word ` or ` beginning`) with weights, exception phrases and the curve's coefficients."""

    def __init__(self, weights: dict[str, float], exceptions: list[str] = (), curve: tuple = (0.0, 0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.curve = dict(weights), list(exceptions), tuple(curve)

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def machine(self):
        if not hasattr(self, "_machine"):
            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(entry, (len(entry), weight, entry))
            for phrase in self.exceptions:
                # An entry that is an exception too is no entry.
                self._machine.add_word(phrase, (len(phrase), None, phrase))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, str, float]]:
        """(start, entry, weight) of what counts, from left to right."""
        machine = self.machine()
        if not len(machine):
            return []
        best: dict[int, tuple[str, float]] = {}
        exempt: list[tuple[int, int]] = []
        for end, (length, weight, entry) in machine.iter(folded):
            start = end + 1 - length
            if weight is None:
                exempt.append((start, end))
            elif start not in best or length > len(best[start][0]):
                best[start] = (entry, weight)
        if exempt:
            # A phrase ends with a space that a beginning never has, so what starts inside it ends there too.
            # Phrases come by rising end; the farthest end among those that begin up to a place tells whether one covers it.
            exempt.sort()
            starts = [a for a, _ in exempt]
            reach = list(accumulate((b for _, b in exempt), max))
            covered = lambda s: (i := bisect_right(starts, s)) > 0 and s < reach[i - 1]
            return [(s, e, w) for s, (e, w) in sorted(best.items()) if not covered(s)]
        return [(s, e, w) for s, (e, w) in sorted(best.items())]

    def features(self, folded: str, found: list) -> list[float]:
        total, words = sum(w for _, _, w in found), folded.count(" ") - 1
        return [1.0, 10 * total / (words + LENGTH_PRIOR), math.log1p(total), math.log1p(words)]

    def score(self, folded: str, found: list) -> float:
        x = sum(c * f for c, f in zip(self.curve, self.features(folded, found)))
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _entries(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    return out


def _contexts(lexicon: Lexicon, folded: str) -> set[str]:
    out = set()
    for start, _, _ in lexicon.matches(folded):
        stop = folded.index(" ", start + 1)
        word = folded[start : stop + 1]
        before = folded.rfind(" ", 0, start)
        after = folded.find(" ", stop + 1)
        out.add(word)
        if before >= 0:
            out.add(folded[before:start] + word)
        if after >= 0:
            out.add(word + folded[stop + 1 : after + 1])
    return out


def _count(terms_of) -> object:
    """Documents with each term, by label, totalled before the shuffle as far as HELD_TERMS reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in small_slices(batches, "text", SLICE_BYTES):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic].update(terms_of(fold(text)))
            if len(counts[0]) + len(counts[1]) > HELD_TERMS:
                yield _counted(counts)
                counts = (Counter(), Counter())
        yield _counted(counts)

    return run


def _counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(terms, pa.string()),
            pa.array([counts[0][t] for t in terms], pa.int64()),
            pa.array([counts[1][t] for t in terms], pa.int64()),
        ],
        ["term", "clean", "toxic"],
    )


def _totals(sample: DataFrame, terms_of) -> DataFrame:
    counted = sample.mapInArrow(_count(terms_of), "term string, clean long, toxic long")
    return counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _newton(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 30) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = x.T @ (x * (p * (1 - p))[:, None]) + decay * np.eye(len(w))
        w += np.linalg.solve(bend, x.T @ (y - p) - decay * w)
    return w.tolist()


def learn(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = SAMPLE_ROWS,
) -> Lexicon:
    """Lexicon, exceptions and curve from labelled rows, at most `rows` different (key, text).

    A document with several labels has the highest; null labels and keys are
    left out, a null text is an empty one, repeated rows count once. Ties between equally telling entries go by the entry.
    Without labels of both kinds the lexicon is empty and the score constant.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("toxic"))
    known = known.where("key is not null").orderBy(F.xxhash64("key"), "key").limit(rows)
    known = known.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    # At most `rows` rows in either step, so the broadcasts are bounded; a repeated id may bring many texts.
    texts = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(known), "key").withColumn("digest", F.sha2("text", 256))
    order = F.xxhash64("key", "digest")
    chosen = texts.select("key", "digest").distinct().orderBy(order, "key", "digest").limit(rows)
    sample = texts.join(F.broadcast(chosen), ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"])
    sample = materialise(sample.select("text", "toxic").repartition(64), "toxicity-sample")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    if not clean or not toxic:
        chance = (toxic + 0.5) / (toxic + clean + 2)
        return Lexicon({}, [], (math.log(chance / (1 - chance)), 0.0, 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    expected = (F.col("toxic") + F.col("clean")) * (toxic / (toxic + clean))
    telling = _totals(sample, _entries).withColumn("odds", odds).withColumn(
        "gain", (F.col("toxic") - expected) ** 2 / expected
    )
    best = (
        telling.where((F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("odds") > math.log(LEAST_ODDS)))
        .orderBy(F.desc("gain"), "term").limit(LEXICON_SIZE).collect()
    )
    weights = {r.term: r.odds for r in best}
    first = Lexicon(weights)
    exempt = (
        _totals(sample, lambda folded: _contexts(first, folded))
        .where(f"toxic = 0 and clean >= {LEAST_DOCUMENTS}").orderBy(F.desc("clean"), "term").limit(EXCEPTIONS_SIZE)
    )
    exceptions = [r.term for r in exempt.collect()]
    second = Lexicon({t: w for t, w in weights.items() if t not in exceptions}, exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", SLICE_BYTES):
            folded = [fold(t) for t in batch.column("text").to_pylist()]
            values = np.array([second.features(f, second.matches(f)) for f in folded]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.float64()), *[pa.array(values[:, i]) for i in range(4)]],
                ["toxic", "a", "b", "c", "d"],
            )

    measured = sample.mapInArrow(measure, "toxic double, a double, b double, c double, d double").toArrow()
    columns = [measured.column(c).to_numpy() for c in ["a", "b", "c", "d"]]
    second.curve = tuple(_newton(np.stack(columns, axis=1), measured.column("toxic").to_numpy()))
    return second


def score_toxicity(documents: DataFrame, lexicon: Lexicon, text: str = "text", prefix: str = "") -> DataFrame:
    """Rows with score (0 to 1) and terms, the entries that counted, in order.

    A null or empty text has no terms and a score like any text without
    words. Rows stay as they are, repeated ones too; columns called score
    or terms are replaced unless a prefix is given.
    """
    score, terms = f"{prefix}score", f"{prefix}terms"
    kept = [c for c in documents.columns if c not in (score, terms)]
    # The text goes through once; the other columns beside it.
    others = F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in kept if c != text])
    packed = documents.select(others.alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in small_slices(batches, "text", SLICE_BYTES):
            scores, found_terms = [], []
            for body in batch.column("text"):
                folded = fold(body.as_py())
                found = lexicon.matches(folded)
                scores.append(lexicon.score(folded, found))
                found_terms.append([e.strip() for _, e, _ in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(found_terms, pa.list_(pa.string()))],
                ["row", "text", "score", "terms"],
            )
            del batch
            pool.release_unused()

    schema = packed.select("row", "text", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("terms")).schema
    scored = packed.mapInArrow(run, schema)
    return scored.select(
        *[(F.col("text") if c == text else F.col("row").getField(c)).alias(c) for c in kept],
        F.col("score").alias(score), F.col("terms").alias(terms),
    )


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(fold_of("doc_id", 5) != 0)
    lexicon = learn(documents, labels)
    scored = score_toxicity(documents, lexicon)
    return scored.select(
        "doc_id",
        (fold_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
