"""Toxicity scores by weak supervision.

1. Two arrays of fixed size count in how many toxic and clean training texts each hashed feature (a word, or its first
   4, 5 or 6 bytes) occurs. Features that tell the classes apart are candidates.
2. Voters are a fixed lexicon, learned lexicons (one candidate each, chosen greedily by the toxic texts that no earlier
   voter covers) and patterns (shouting, symbol noise). A generative model with the class as its latent variable gives
   each voter's rates of firing in both classes by expectation maximisation; voters that fire together within a class
   more than independence allows share their weight. The annotator is one more voter, as fallible as the others.
3. A logistic regression over the voters' features is trained on the posterior labels, and scores every whole text.

The model is fitted on at most ``most_rows`` labelled training rows, those of the least hashes of the id (a documented
bound, so that fitting moves no text but these rows'); of each, the driver gets CANDIDATES bits. Labels are read from
the rows of the training side alone; label, lang, source and doc_id are no features.

Edge cases: null and empty texts get the score of a text without features; without labelled training rows the fixed
lexicon alone decides; null labels are skipped; repeated rows are scored once each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import array_sum
from .common import id_text, load, map_rows, thrifty, written
from .shingles import _LOWER, CHUNK, SEED, U, byte_chunks, runs, span_hashes

# The fixed lexicon (fixed values): insults in English.
LEXICON = ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting", "imbecile", "dumb"]
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
CANDIDATES, VOTERS, MOST_ROWS = 1024, 256, 30_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "!#$%&*@^~|<>{}[]\\"]] = True
#: Patterns: share of capitals among bytes, share of symbols among bytes.
PATTERNS = 2


class Features:
    """Hashed features of each text of a chunk."""

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, document of each feature, its bucket, pattern values) for ranges of texts."""
        for a, b, data, offsets in byte_chunks(texts, CHUNK):
            n = len(data)
            start, stop = runs(_LETTER[data], offsets)
            doc, low = np.searchsorted(offsets, start, "right") - 1, _LOWER[data]
            docs, buckets = [doc], [span_hashes(low, start, stop)[0] >> U(44)]
            for k in PREFIXES:
                long = np.flatnonzero(stop - start > k)
                docs.append(doc[long])
                buckets.append(span_hashes(low, start[long], start[long] + k, SEED + k)[0] >> U(44))
            size = np.maximum(1, np.diff(offsets))
            count = [np.diff(np.concatenate(([0], np.cumsum(mark[data])))[offsets]) for mark in (_CAPITAL, _SYMBOL)] if n else [np.zeros(b - a)] * 2
            yield a, b, np.concatenate(docs), np.concatenate(buckets).astype(np.int64), np.stack([c / size for c in count])

    def of_words(self, words: list[str]) -> np.ndarray:
        """The bucket of each word itself."""
        (_, _, doc, bucket, _), *_ = self.chunks(pa.array(words))
        return bucket[: len(words)]


def present(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a document once."""
    both = np.unique(doc * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def fired(values: np.ndarray) -> np.ndarray:
    """Pattern voters: more than half of all bytes are capitals; more than a fifth are symbols."""
    return np.stack([values[0] > 0.5, values[1] > 0.2])


def training_counts(train: DataFrame) -> np.ndarray:
    """(2, BUCKETS): in how many clean and toxic training texts each bucket occurs; the sums are in the last two places."""

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        features, total = Features(), None
        for batch in batches:
            total = np.zeros(2 * BUCKETS + 64, dtype=np.int64) if total is None else total
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            total[2 * BUCKETS : 2 * BUCKETS + 2] += np.bincount(toxic, minlength=2)
            for a, b, doc, bucket, _ in features.chunks(batch.column(0)):
                doc, bucket = present(doc, bucket)
                total[: 2 * BUCKETS] += np.bincount(toxic[a:b][doc] * BUCKETS + bucket, minlength=2 * BUCKETS)
        return total

    return array_sum(train.select("text", "toxic"), 2 * BUCKETS + 64, fill)


def candidates(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """The buckets of the largest log-likelihood ratio among those that occur more often in toxic texts."""
    p, q = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    both = (toxic + clean + 1) / (n_toxic + n_clean + 2)

    def part(k: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
        rate = np.clip(rate, 1e-12, 1 - 1e-12)
        return k * np.log(rate) + (n - k) * np.log1p(-rate)

    gain = part(toxic, n_toxic, p) + part(clean, n_clean, q) - part(toxic, n_toxic, both) - part(clean, n_clean, both)
    gain[(p <= q) | (toxic < 3)] = 0
    best = np.argsort(-gain, kind="stable")[:CANDIDATES]
    return best[gain[best] > 3]


def chosen_voters(hits: np.ndarray, label: np.ndarray, most: int = VOTERS) -> list[int]:
    """Greedy cover: the candidate that finds most toxic rows not yet found twice, less five times its clean rows."""
    found, out = np.zeros(len(label)), []
    clean = hits[label == 0].sum(axis=0)
    toxic = hits[label == 1]
    found = np.zeros(len(toxic))
    while len(out) < most:
        gain = toxic[found < 2].sum(axis=0) - 5.0 * clean
        gain[out] = 0
        j = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[j] < 1:
            break
        out.append(j)
        found += toxic[:, j]
    return out


def label_model(votes: np.ndarray, annotator: np.ndarray, strong: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of the toxic class for each row.

    votes (rows x voters, 0/1), annotator (0, 1, or -1 where there is none), strong: voters that the prior trusts.
    """
    n, v = votes.shape
    votes = votes.astype(np.float64)
    has = annotator >= 0
    posterior = np.where(has, 0.9 * (annotator == 1) + 0.05, np.where(votes[:, strong].any(axis=1), 0.9, 0.05))
    for _ in range(rounds):
        w, u = posterior.sum() + 1, (1 - posterior).sum() + 1
        rate1 = (posterior @ votes + 0.5) / (w + 1)
        rate0 = ((1 - posterior) @ votes + 0.05) / (u + 1)
        sensitive = ((posterior * has) @ (annotator == 1) + 1) / ((posterior * has).sum() + 1.1)
        false = (((1 - posterior) * has) @ (annotator == 1) + 0.1) / (((1 - posterior) * has).sum() + 2)
        # correlations within the classes: voters that fire together more than their rates explain share their weight
        residual = votes - np.outer(posterior, rate1) - np.outer(1 - posterior, rate0)
        scale = np.sqrt((residual**2).mean(axis=0)) + 1e-9
        rho = np.abs(residual.T @ residual) / n / np.outer(scale, scale)
        np.fill_diagonal(rho, 0)
        share = 1 / (1 + np.where(rho > 0.2, rho, 0).sum(axis=1))
        on, off = np.log(rate1 / rate0), np.log((1 - rate1) / (1 - rate0))
        score = np.log(w / u) + votes @ (share * on) + (1 - votes) @ (share * off)
        score += np.where(annotator == 1, np.log(sensitive / false), np.where(annotator == 0, np.log((1 - sensitive) / (1 - false)), 0))
        fresh = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(fresh - posterior).max() < 1e-6:
            break
        posterior = fresh
    return posterior


def linear_classifier(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by accelerated gradient descent."""
    n, d = x.shape
    x = x.astype(np.float32)
    w, bias, step = np.zeros(d), -2.0, 4.0 / max(1.0, float((x.sum(axis=1) + 1).mean() * 4))
    back, at, bias_at, t = w, w.copy(), bias, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at.astype(np.float32) + bias_at, -30, 30)))
        gap = (p - target).astype(np.float32)
        rate = step * 20
        fresh = np.maximum(at - rate * ((x.T @ gap) + ridge * 0.01 * at) / n, 0)  # candidates speak for the toxic class alone
        fresh_bias = bias_at - rate * float(gap.sum()) / n
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, bias_at = fresh + (t - 1) / after * (fresh - back), fresh_bias + (t - 1) / after * (fresh_bias - bias)
        back, bias, t = fresh, fresh_bias, after
    return back, bias


def fit(train: DataFrame) -> tuple[np.ndarray, float]:
    """A weight for each bucket, and the bias. train: text, toxic (0 or 1), bounded."""
    # equal texts once: a group of copies isn't evidence many times over
    train = written(train.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "training")
    counts = training_counts(train)
    n_clean, n_toxic = (int(x) for x in counts[2 * BUCKETS : 2 * BUCKETS + 2])
    fixed = np.unique(Features().of_words(LEXICON))
    places = np.unique(np.concatenate([candidates(counts[:BUCKETS], counts[BUCKETS : 2 * BUCKETS], n_clean, n_toxic), fixed]))
    shared = train.sparkSession.sparkContext.broadcast(places)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, places = Features(), shared.value
        for batch in batches:
            out = []
            for a, b, doc, bucket, values in features.chunks(batch.column(0)):
                at = np.minimum(np.searchsorted(places, bucket), len(places) - 1)
                row = np.zeros((b - a, len(places)), dtype=bool)
                known = places[at] == bucket
                row[doc[known], at[known]] = True
                out += [np.packbits(np.concatenate([r, f])).tobytes() for r, f in zip(row, fired(values).T, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["toxic", "hits"])

    got = train.select("text", "toxic").mapInArrow(hits, "toxic int, hits binary").collect()  # a bounded number of rows of CANDIDATES bits
    label = np.array([r.toxic for r in got], dtype=np.int64)
    width = len(places) + PATTERNS
    bits = np.zeros((0, width), dtype=np.uint8)
    if got:
        bits = np.unpackbits(np.frombuffer(b"".join(bytes(r.hits) for r in got), dtype=np.uint8).reshape(len(got), -1), axis=1)[:, :width]
    weight = np.zeros(BUCKETS, dtype=np.float32)
    lexicon = np.searchsorted(places, fixed)
    if not len(got):
        weight[fixed] = 4.0
        return weight, -3.0
    x = bits[:, : len(places)]
    learned = chosen_voters(x.astype(np.float32), label)
    voters = np.unique(np.concatenate([lexicon, np.array(learned, dtype=np.int64), len(places) + np.arange(PATTERNS)]).astype(np.int64))
    posterior = label_model(bits[:, voters], label, np.isin(voters, lexicon))
    use = voters[voters < len(places)]
    w, bias = linear_classifier(x[:, use], posterior)
    weight[places[use]] = w
    unseen = places[use][(x[:, use].sum(axis=0) == 0) & np.isin(places[use], fixed)]
    weight[unseen] = max(1.0, 1.5 - bias)  # the fixed lexicon holds where no training text has its word
    return weight, bias


class Scorer:
    """Scores of a column of texts."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.features, self.weight, self.bias = Features(), weight, bias

    def __call__(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for a, _, doc, bucket, _ in self.features.chunks(texts):
            known = self.weight[bucket] > 0
            doc, bucket = present(doc[known], bucket[known])
            np.add.at(total, a + doc, self.weight[bucket])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scores(docs: DataFrame, weight: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score, predicted, for each row of docs."""
    src = id_text(docs).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bias)
        for batch in batches:
            score = scorer(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(thrifty(run), SCORED)


def mark_toxic(docs: DataFrame, weight: np.ndarray, bias: float, text_col: str = "text", score_col: str = "toxic_score") -> DataFrame:
    """docs, all columns kept, with a score."""
    shared, at = docs.sparkSession.sparkContext.broadcast(weight), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer(batch.column(at)))], [f"c{i}" for i in range(batch.num_columns + 1)])

    return map_rows(docs, run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def not_toxic(docs: DataFrame, weight: np.ndarray, bias: float, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under at_least, all columns kept, whatever they are called."""
    score = "toxic_score"
    while score in docs.columns:
        score += "_"
    return mark_toxic(docs, weight, bias, text_col, score).where(F.col(score) < at_least).drop(score)


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """text, toxic of at most most_rows labelled rows of the training side: crc32 of the id as text isn't divisible by 5."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = [tuple(r) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).collect()]
    some = labels.sparkSession.createDataFrame(rows, "doc_id long, toxic int")
    return id_text(docs).join(F.broadcast(some), "doc_id").where("text is not null").select("text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, *fit(training_rows(docs, labels)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
