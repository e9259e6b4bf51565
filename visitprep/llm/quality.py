"""Quality classifier on supervised subword embeddings.

Every white-space token contributes a vector of its own and one for each of its character n-grams, and
every pair of neighbouring tokens one for the word bigram, all learned and found by hash.  A token that
repeats the one before it adds a back reference, one vector for all such pairs.  A document is the
average of these vectors, and a softmax over the average gives the class.  Training is stochastic gradient
descent in numpy on a bounded, documented sample of labelled rows.  The average is linear, so scoring adds up, for each token, a sum of class
scores and a number of features that a worker computes once for each distinct token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, DIM = 1 << 16, 8
GRAMS = (1, 2, 3, 4)
EPOCHS, RATE, SEED = 4, 2.0, 7
#: Buckets of tokens and their n-grams come first, then the back reference, then word bigrams.
REPEAT = BUCKETS
#: Most labelled rows that training uses: the sample's bound.
TRAINING_ROWS = 2000
#: A document is accepted from this score on.
THRESHOLD = 0.3
#: Tokens a worker keeps; further ones are computed anew in each step.
CACHE_TOKENS = 300_000
#: Tokens whose features are computed at a time.
STEP_TOKENS = 20_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def features(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each token, one after another, and the number of each token's features.

    A token is framed as ``<token>``; its features are the frame and the n-grams inside it.
    """
    framed = [b"<" + t + b">" for t in tokens]
    sizes = np.array([len(t) for t in framed], np.int64)
    data = np.frombuffer(b"".join(framed), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    prefix = common.prefix_hash(data)
    parts, owners = [common.span_hash(prefix, starts, ends)], [np.arange(len(tokens))]
    owner = np.repeat(np.arange(len(tokens)), sizes)
    at = np.arange(len(data))
    for n in GRAMS:
        ok = at + n <= ends[owner]
        parts.append(common.span_hash(prefix, at[ok], at[ok] + n))
        owners.append(owner[ok])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    ids = (np.concatenate(parts)[order] % np.uint64(BUCKETS)).astype(np.int64)
    return ids, np.bincount(owners, minlength=len(tokens))


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    data = b" ".join(tokens)
    sizes = np.array([len(t) for t in tokens], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    return common.word_hashes(data, starts, starts + sizes)


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbours in a sequence of token hashes."""
    with np.errstate(over="ignore"):
        return (common.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C55) + hashes[1:]) % np.uint64(BUCKETS)).astype(np.int64) + REPEAT + 1


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dim
    output: np.ndarray  # dim x 2
    prior: np.ndarray  # 2

    def weights(self) -> np.ndarray:
        """Of each bucket, the difference of the two class scores."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)


def training_rows(docs: DataFrame, labels: DataFrame, *, rows: int = TRAINING_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents that are not held out, those with the smallest hashes.

    The labels are sampled first, so the documents are joined with a small table of known size.
    Null labels and null or repeated ids of labels do not take part.
    """
    ids = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = ids.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # repeated ids count once


def train(sample: DataFrame, *, rows: int = TRAINING_ROWS) -> Model:
    """Fit on the driver from at most ``rows`` rows (``doc_id``, ``text``, ``quality``), those of smallest hashes."""
    got = sample.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows).select("doc_id", "text", "quality").toArrow()
    ids, labels, texts = (got.column(c) for c in ("doc_id", "quality", "text"))
    order = sorted(range(got.num_rows), key=lambda i: zlib.crc32(str(ids[i]).encode()))
    model = fit((texts[i].as_py().encode().split(), int(labels[i].as_py())) for i in order)
    del got, ids, labels, texts
    common.trim()
    return model


def fit(docs: Iterable[tuple[list[bytes], int]]) -> Model:
    """Stochastic gradient descent over documents (tokens, class), which are kept as numbers of tokens."""
    rng = np.random.default_rng(SEED)
    vectors = (rng.random((2 * BUCKETS + 1, DIM)) - 0.5).astype(np.float32) / DIM
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    number: dict[bytes, int] = {}
    numbered = [(np.array([number.setdefault(t, len(number)) for t in tokens], np.int32), label) for tokens, label in docs]
    distinct = list(number)
    number.clear()
    hashes = token_hashes(distinct)
    parts = [features(distinct[i : i + STEP_TOKENS]) for i in range(0, len(distinct), STEP_TOKENS)]
    ids = np.concatenate([np.zeros(0, np.int32), *[p.astype(np.int32) for p, _ in parts]])
    sizes = np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]])
    ends = np.cumsum(sizes)
    prepared = []
    for at, label in numbered:
        if len(at):
            own, times = np.unique(at, return_counts=True)
            flat = np.concatenate([ids[ends[i] - sizes[i] : ends[i]] for i in own])
            bucket, inverse = np.unique(flat, return_inverse=True)
            weight = np.bincount(inverse, np.repeat(times, sizes[own])).astype(np.float32)
            if repeats := int((at[1:] == at[:-1]).sum()):
                bucket, weight = np.append(bucket, np.int32(REPEAT)), np.append(weight, np.float32(repeats))
            pairs, times = np.unique(bigrams(hashes[at]), return_counts=True)
            bucket, weight = np.append(bucket, pairs.astype(np.int32)), np.append(weight, times.astype(np.float32))
            prepared.append((bucket, weight / weight.sum(), label))
    steps, done = max(1, EPOCHS * len(prepared)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(prepared)):
            bucket, weight, label = prepared[i]
            rate = np.float32(RATE * (1 - done / steps))
            hidden = weight @ vectors[bucket]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            step = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= rate * np.float32(0.02) * p
            # Each feature moves by its share; the scale keeps rare and frequent features moving alike.
            vectors[bucket] -= rate * np.outer(np.minimum(weight * np.float32(20), 1), step)
            done += 1
    return Model(vectors, output, bias)


class Scorer:
    """Scores of token lists, with the class-score sums and feature counts of tokens kept."""

    def __init__(self, weights: np.ndarray, prior: float):
        self.weights, self.prior = weights, prior
        self.known: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def _learn(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes = features(tokens)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return np.add.reduceat(self.weights[ids], ends[:-1]), sizes.astype(np.float64), token_hashes(tokens)

    def score(self, texts: list[bytes]) -> np.ndarray:
        docs = [t.split() for t in texts]
        new = list({t for tokens in docs for t in tokens if t not in self.known})
        if new and len(self.known) + len(new) > CACHE_TOKENS:
            self._forget()
            new = list({t for tokens in docs for t in tokens})
        if new:
            sums, counts, hashes = zip(*(self._learn(new[i : i + STEP_TOKENS]) for i in range(0, len(new), STEP_TOKENS)), strict=True)
            self.known.update(zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True))
            self.sums, self.counts, self.hashes = np.concatenate([self.sums, *sums]), np.concatenate([self.counts, *counts]), np.concatenate([self.hashes, *hashes])
        out, known = np.zeros(len(docs)), self.known
        for i, tokens in enumerate(docs):
            at = np.array([known[t] for t in tokens], np.int64)
            repeats = np.count_nonzero(at[1:] == at[:-1])
            pairs = self.weights[bigrams(self.hashes[at])]
            out[i] = (self.sums[at].sum() + repeats * self.weights[REPEAT] + pairs.sum()) / max(1.0, self.counts[at].sum() + repeats + len(pairs))
        return 1 / (1 + np.exp(-(out + self.prior)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Score and decision for every document; the columns of ``keep`` (default: the id) come along.

    Only the text enters the score.  Null and empty texts get the score of a document without
    features, the model's prior; repeated rows get equal scores; an empty table gives no rows.  A kept
    column called ``held_out``, ``score`` or ``predicted``, or kept twice, raises; other names are free.
    """
    kept = common.kept_columns(keep or [id_col], ("held_out", "score", "predicted"))
    hidden = common.free_name("__text", [*kept, *docs.columns])
    ident = common.free_name("__id", [*kept, *docs.columns])
    weights, prior = model.weights(), float(model.prior[1] - model.prior[0])
    version = f"{zlib.crc32(weights.tobytes())}-{prior}"
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size: one number a bucket
    given = docs.select(*[F.col(c) for c in kept], F.col(id_col).cast("string").alias(ident), F.col(text_col).alias(hidden))
    fields = given.drop(hidden, ident).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = common.hold(f"scorer {version}", lambda: Scorer(shared.value, prior))
        for batch in batches:
            texts = common.utf8(batch, hidden)
            ids = [zlib.crc32(x.encode()) % 5 == 0 if x is not None else None for x in common.column(batch, ident).to_pylist()]
            parts = [scorer.score(texts[a:b]) for a, b in common.steps([len(t) for t in texts], 4 * common.STEP_BYTES)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(ids, pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[*batch.schema.names[:-2], "held_out", "score", "predicted"],
            )
        common.trim()

    return given.mapInArrow(run, schema)
