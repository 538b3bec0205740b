"""Language identification of whole texts, also of mixed ones.

Every word gets a score for each language: the log-likelihood of its
character n-grams. Its script narrows the candidates to the languages that
were seen in that script. A Viterbi pass over the words, with a penalty for
switching, labels spans; a text's language is the one with most letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.llm.common import CHUNK_BYTES, fold_of, small_slices
from affinium.llm.registry import query, table

# The classifier is fitted on this many labelled rows at most, the first by a hash of their id.
SAMPLE_ROWS = 20_000
UNDETERMINED = "und"
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SMOOTHING = 0.5
# A word's n-grams overlap, so their log-likelihoods count by this share.
EVIDENCE = 0.5
SWITCH_PENALTY = 8.0
# Share of a language's words that must be in a script for the language to be a candidate there.
SCRIPT_SHARE = 0.01
FORBIDDEN = -1e6

# First code points of script ranges, each up to the next one. 0 stands for all others.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"),
    (0x1780, "Khmer"), (0x1800, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"),
    (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
    (0x20000, "Han"), (0x32000, "other"),
]
STARTS = np.array([s for s, _ in SCRIPT_STARTS])
SCRIPTS = sorted({n for _, n in SCRIPT_STARTS})
SCRIPT_OF = np.array([SCRIPTS.index(n) for _, n in SCRIPT_STARTS])

NOT_LETTERS = r"[^\p{L}]+"


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased runs of letters, how many each text has, and the text of each word."""
    whole = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    split = pc.split_pattern_regex(pc.utf8_lower(whole), pattern=NOT_LETTERS)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    words = split.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)[full]
    return words.filter(pa.array(full)), np.bincount(owner, minlength=len(counts)), owner


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of all n-grams of some words, edges marked, and each word's script."""
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    edge = points == 32
    owner = np.cumsum(edge) - 1
    first = np.flatnonzero(edge)[:-1] + 1
    script = SCRIPT_OF[np.searchsorted(STARTS, points[first], side="right") - 1]
    owners, buckets = [], []
    for n in GRAMS:
        room = len(points) - n + 1
        if room < 1:
            continue
        code = np.full(room, n, np.uint64)
        inner = np.zeros(room, bool)
        for i in range(n):
            code = (code ^ points[i : i + room]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
            if n == 1 or 0 < i < n - 1:
                inner |= edge[i : i + room]
        fine = np.flatnonzero(~inner)
        # A window belongs to the word it starts in; an edge starts the next one.
        owners.append(owner[fine])
        buckets.append((code[fine] >> np.uint64(40)) % np.uint64(BUCKETS))
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64), script


class Model:
    """Log-likelihoods per n-gram bucket and language, and each script's candidates."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        """grams: counts by bucket and language; scripts: words by script and language."""
        self.languages = languages
        totals = grams.sum(axis=0, keepdims=True) + SMOOTHING * BUCKETS
        self.table = (EVIDENCE * np.log((grams + SMOOTHING) / totals)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        allowed = share >= SCRIPT_SHARE
        allowed[~allowed.any(axis=1)] = True
        self.barred = np.where(allowed, 0, FORBIDDEN).astype(np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        owners, buckets, script = grams_of(words)
        out = np.stack(
            [np.bincount(owners, weights=self.table[buckets, k], minlength=len(words))
             for k in range(len(self.languages))], axis=1,
        )
        return out.astype(np.float32) + self.barred[script]


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of every word; texts run side by side, longest first."""
    path = np.zeros(len(scores), np.int64)
    if not len(scores):
        return path
    order = np.argsort(-counts, kind="stable")
    begin, length = (np.cumsum(counts) - counts)[order], counts[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")
    came = np.empty(scores.shape, np.int16)
    value = scores[begin[: active[0]]].copy()
    states = np.arange(scores.shape[1])
    for t in range(1, length[0]):
        n = active[t]
        value = value[:n]
        best = value.argmax(axis=1)
        jump = value[np.arange(n), best][:, None] - penalty
        stay = value >= jump
        at = begin[:n] + t
        came[at] = np.where(stay, states, best[:, None])
        value = np.where(stay, value, jump)
        # Only differences count, so the sum stays small over long texts.
        value -= value.max(axis=1, keepdims=True)
        value += scores[at]
        path_end = np.flatnonzero(length[:n] == t + 1)
        if len(path_end):
            path[begin[path_end] + t] = value[path_end].argmax(axis=1)
    ones = np.flatnonzero(length == 1)
    path[begin[ones]] = scores[begin[ones]].argmax(axis=1)
    for t in range(length[0] - 1, 0, -1):
        at = begin[: active[t]] + t
        path[at - 1] = came[at, path[at]]
    return path


def _count(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((BUCKETS + len(SCRIPTS), len(languages)), np.int64)
        for batch in small_slices(batches, "text"):
            words, _, owner = letter_words(batch.column("text"))
            language = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)[owner]
            for k in np.unique(language):
                values = words.filter(pa.array(language == k)).value_counts()
                often = values.field("counts").to_numpy()
                owners, buckets, script = grams_of(values.field("values").to_pylist())
                totals[:BUCKETS, k] += np.bincount(buckets, weights=often[owners], minlength=BUCKETS).astype(np.int64)
                totals[BUCKETS:, k] += np.bincount(script, weights=often, minlength=len(SCRIPTS)).astype(np.int64)
        slot, language = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(language), pa.array(totals[slot, language])], ["slot", "language", "n"]
        )

    return run


def learn(
    documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS
) -> Model:
    """Model from rows with key, text and language, at most `rows` different ones.

    Rows without one of them are left out, repeated rows count once. Without any the model knows only
    `und`.
    """
    known = documents.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    known = known.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.where("key is not null").withColumn("digest", F.sha2("text", 256))
    named = ["key", "digest", "lang"]
    # At most `rows` rows, so the broadcast is bounded; the text decides too, so that one key cannot fill the sample.
    chosen = known.select(*named).distinct().orderBy(F.xxhash64("key", "digest"), *named).limit(rows)
    sample = known.join(F.broadcast(chosen), named, "left_semi").dropDuplicates(named)
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return Model([UNDETERMINED], np.zeros((BUCKETS, 1)), np.zeros((len(SCRIPTS), 1)))
    counted = sample.select("text", "lang").mapInArrow(_count(languages), "slot long, language long, n long")
    totals = counted.groupBy("slot", "language").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    counts[totals.column("slot").to_numpy(), totals.column("language").to_numpy()] = totals.column("n").to_numpy()
    return Model(languages, counts[:BUCKETS], counts[BUCKETS:])


SPANS = "array<struct<lang:string,start:long,stop:long>>"


def identify(
    documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = SWITCH_PENALTY
) -> DataFrame:
    """Rows (key, lang_pred, score, spans), one per document.

    spans are runs of words, numbered from 0, in one language; score is the
    share of letters in the predicted one. Ties go to the first language by
    name. A text that is null or has no letter is `und` with score 0.
    Repeated rows are judged alike; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    # Scores take a number per word and language.
    limit = max(1 << 18, CHUNK_BYTES * 8 // max(8, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small_slices(batches, "text", limit):
            words, counts, owner = letter_words(batch.column("text"))
            coded = words.dictionary_encode()
            place = coded.indices.to_numpy(zero_copy_only=False)
            scores = known.word_scores(coded.dictionary.to_pylist())[place] if len(words) else np.zeros((0, 1))
            path = viterbi(scores, counts, penalty)
            letters = pc.utf8_length(words).to_numpy(zero_copy_only=False)
            amount = np.bincount(
                owner * len(known.languages) + path, weights=letters, minlength=len(counts) * len(known.languages)
            ).reshape(len(counts), -1)
            best, all_ = amount.argmax(axis=1), amount.sum(axis=1)
            begin = np.cumsum(counts) - counts
            turn = np.ones(len(path), bool)
            turn[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(turn)
            stop = np.append(at[1:], len(path))
            names = pa.array(known.languages, pa.string())
            spans = pa.StructArray.from_arrays(
                [names.take(pa.array(path[at])), pa.array(at - begin[owner[at]]), pa.array(stop - begin[owner[at]])],
                ["lang", "start", "stop"],
            )
            edges = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(counts)))])
            label = [known.languages[b] if n else UNDETERMINED for b, n in zip(best, all_)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pa.array(label, pa.string()),
                    pa.array(amount.max(axis=1) / np.maximum(all_, 1)),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans),
                ],
                ["key", "lang_pred", "score", "spans"],
            )

    found = rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, spans {SPANS}")
    return found.withColumnRenamed("key", key)


@query("op4_language_id")
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = learn(documents.where(fold_of("doc_id", 4) != 2))
    found = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
