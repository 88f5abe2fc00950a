"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Texts become hashed counts of three kinds of terms: shapes of tokens (letters folded to one
sign of their case), letter trigrams, and repetitions. A truncated singular value
decomposition of a bounded labelled sample gives the latent space. The labelled vectors, at
most a few MB, are broadcast; every document's vector is compared with all of them by exact
cosines, block by block, and the nearest vote with their similarity as weight.

Defined results: a text without terms (null, empty, white space) has no neighbours and gets
the share of good labels in the sample; so does every text if no label could be learned from,
with a share of 0.5. Ties between neighbours are broken by the order of the sample, which is
sorted. Extra columns pass through; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.bytewords import LOWER, VISIBLE, find_words, mix, pieces

# Bound of the labelled sample, and so of the broadcast: SAMPLE x RANK numbers.
SAMPLE = 2_400
RANK = 48
NEIGHBOURS = 11
SHAPES, TRIGRAMS, REPEATS = 512, 1_024, 8
TERMS = SHAPES + TRIGRAMS + REPEATS
# Documents compared at a time.
BLOCK = 512

# One sign for each kind of byte; other signs stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")
_KIND[128:] = ord("a")


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def counts(column: pa.Array) -> np.ndarray:
    """Terms of each text: one row of ``TERMS`` counts for each."""
    n = len(column)
    words = find_words(column, VISIBLE, lower=False)
    if not len(words.start):
        return np.zeros((n, TERMS), np.float32)
    # Shapes: a token's kinds of bytes, runs of one kind counted once.
    kinds = _KIND[words.data]
    size = words.end - words.start
    at = np.repeat(words.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    token = np.repeat(np.arange(len(size)), size)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (kinds[at[1:]] != kinds[at[:-1]]) | (token[1:] != token[:-1])
    kept, owner = kinds[at][fresh].astype(np.uint64), token[fresh]
    begin = np.searchsorted(owner, np.arange(len(size)))
    place = np.arange(len(owner)) - begin[owner]
    shape = np.bitwise_xor.reduceat(mix(kept * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), begin)
    out = np.bincount(words.text * SHAPES + (shape % np.uint64(SHAPES)).astype(np.int64), minlength=n * SHAPES)
    shapes = out.reshape(n, SHAPES)
    # Trigrams of lower-cased bytes inside tokens.
    low = LOWER[words.data].astype(np.uint32)
    inside = at[:-2][token[2:] == token[:-2]] if len(at) > 2 else at[:0]
    gram = (low[inside] * np.uint32(0x9E3779B1) + low[inside + 1]) * np.uint32(0x85EBCA77) + low[inside + 2]
    gram = ((gram * np.uint32(0xC2B2AE3D)) >> np.uint32(22)).astype(np.int64)
    text_at = np.searchsorted(words.first, token[:-2][token[2:] == token[:-2]], "right") - 1 if len(at) > 2 else gram
    trigrams = np.bincount(text_at * TRIGRAMS + gram, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    # Repetitions: a token like the one one to four places before.
    repeats = np.zeros((n, REPEATS))
    for back in range(1, min(5, len(size))):
        same = (words.hash[back:] == words.hash[:-back]) & (words.text[back:] == words.text[:-back])
        repeats[:, back - 1] = np.bincount(words.text[back:][same], minlength=n)
    repeats[:, 5] = words.counts
    return np.concatenate([shapes, trigrams, repeats], axis=1).astype(np.float32)


def weighed(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts by inverse document frequency, each kind of term scaled to the same length."""
    out = np.log1p(found) * idf
    for lo, hi in ((0, SHAPES), (SHAPES, SHAPES + TRIGRAMS), (SHAPES + TRIGRAMS, TERMS)):
        length = np.linalg.norm(out[:, lo:hi], axis=1, keepdims=True)
        out[:, lo:hi] /= np.where(length > 0, length, 1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``(text, quality)`` of about ``most`` labelled documents, half of each label if there are
    enough: rows of ``labels (doc_id, quality)`` with the lowest hashes, the same on every run."""
    sizes = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    share = F.lit(0.0)
    for value, n in sorted(sizes.items()):
        share = F.when(F.col("quality") == value, F.lit(most / len(sizes) / n)).otherwise(share)
    point = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    some = labels.where(point < share).dropDuplicates(["doc_id"])
    # At most a few thousand narrow rows by the shares above, so they may be broadcast.
    return docs.join(F.broadcast(some), "doc_id").select("text", "quality")


def learn(train: DataFrame, rank: int = RANK) -> Model:
    """Fit on ``train (text, quality)``: a bounded set of labelled rows, see ``labelled_sample``."""

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = counts(piece.column("text"))
                blobs = pa.array([row.tobytes() for row in found], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("quality"), blobs], ["quality", "terms"])

    rows = train.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(
        vectorise, "quality int, terms binary"
    )
    got = sorted((r["quality"], bytes(r["terms"])) for r in rows.collect())
    labels = np.array([g[0] for g in got], np.float32)
    if not len(got):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    terms = np.stack([np.frombuffer(g[1], np.float32) for g in got])
    idf = np.log((1 + len(got)) / (1 + (terms > 0).sum(axis=0))).astype(np.float32) + 1
    matrix = weighed(terms, idf)
    # Randomised truncated decomposition with a fixed seed: two power steps are plenty.
    basis = matrix.T @ np.random.default_rng(7).standard_normal((len(got), rank)).astype(np.float32)
    for _ in range(3):
        basis = matrix.T @ (matrix @ np.linalg.qr(basis)[0])
    axes = np.linalg.qr(basis)[0].astype(np.float32)
    return Model(idf, axes, _unit(matrix @ axes), labels, float((labels > 0).mean()))


def vote(found: np.ndarray, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of texts with the given counts: nearest labelled vectors by exact cosines."""
    out = np.full(len(found), model.prior)
    k = min(neighbours, len(model.labels))
    if not k:
        return out
    for start in range(0, len(found), BLOCK):
        block = found[start : start + BLOCK]
        near = _unit(weighed(block, model.idf) @ model.axes) @ model.vectors.T
        best = np.argpartition(near, len(model.labels) - k, axis=1)[:, len(model.labels) - k :]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** 8
        total = weight.sum(axis=1)
        share = (weight * (model.labels[best] > 0)).sum(axis=1) / np.where(total > 0, total, 1)
        some = (block.sum(axis=1) > 0) & (total > 0)
        out[start : start + BLOCK] = np.where(some, np.clip(share, 0, 1), model.prior)
    return out


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= ``cut``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            table = pa.RecordBatch.from_arrays([batch], ["text"])
            scores = [vote(counts(p.column("text")), shared.value) for p in pieces(table, "text")]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    judged = docs.drop("score", "predicted").withColumn("score", judge(F.col("text")))
    return judged.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
