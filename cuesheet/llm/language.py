"""Language identification by words first, character n-grams second.

A known word scores by its log frequency in each language. An unseen word is scored by the
longest character n-grams of it that are known, from ``MAX_GRAM`` letters down to one.

Defined results: null text and text without a letter give ``und`` and 0; so does every text if
nothing was learned. Empty tables give empty results. Ties go to the first language in code
point order. Extra columns pass through; columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

UNKNOWN = "und"
MAX_GRAM = 5
# Bounds of the learned model, which is broadcast: the documents of each language counted, the
# words and the n-grams of each length kept for each language.
TRAIN_DOCS = 1_500
KEPT_WORDS = 20_000
KEPT_GRAMS = 8_000
# Unseen words remembered by a task.
REMEMBERED = 200_000
# Words of evidence after which the score stops getting surer.
SURE_WORDS = 40
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray


def sampled(train: DataFrame, label: str, most: int) -> DataFrame:
    """About ``most`` rows of each label, the same on every run: rows whose hash is low enough."""
    sizes = train.groupBy(label).count().collect() if label else []
    share = F.coalesce(*[F.when(F.col(label) == r[label], F.lit(most / r["count"])) for r in sizes], F.lit(0.0))
    point = (F.pmod(F.xxhash64(*train.columns), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    return train.where(point < share)


def learn(train: DataFrame, docs_per_language: int = TRAIN_DOCS) -> Model:
    """Count words and n-grams of ``train`` rows ``(doc key..., text, lang)`` in Spark.

    Documents are a bounded sample, ``docs_per_language`` of each language; only the most
    frequent words and n-grams, bounded in number, come to the driver.
    """
    train = train.where("text is not null and lang is not null")
    some = sampled(train, "lang", docs_per_language).select("text", "lang")
    words = (
        some.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    lengths = F.sequence(F.lit(1), F.lit(MAX_GRAM))
    grams = (
        words.where(F.length("word") <= 40)
        .select("lang", "n", F.explode(lengths).alias("size"), marked.alias("_w"))
        .where("length(_w) >= size")
        .select("lang", "n", "size", F.explode(F.expr("transform(sequence(1, length(_w) - size + 1), i -> substring(_w, i, size))")).alias("gram"))
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counted = words.select("lang", F.lit(0).alias("size"), F.col("word").alias("gram"), "n").unionByName(grams)
    rank = F.expr("row_number() over (partition by lang, size order by n desc, gram)")
    kept = counted.withColumn("_rank", rank).where(
        (F.col("_rank") <= KEPT_GRAMS) | ((F.col("size") == 0) & (F.col("_rank") <= KEPT_WORDS))
    )
    rows = kept.select("lang", "size", "gram", "n").collect()
    languages = sorted({r["lang"] for r in rows})
    place = {name: i for i, name in enumerate(languages)}
    total: dict[tuple[int, int], int] = {}
    for r in rows:
        key = (place[r["lang"]], r["size"])
        total[key] = total.get(key, 0) + r["n"]
    counts: list[dict[str, np.ndarray]] = [{}, {}]
    for r in rows:
        table = counts[r["size"] > 0]
        if r["gram"] not in table:
            table[r["gram"]] = np.zeros(len(languages))
        table[r["gram"]][place[r["lang"]]] = r["n"]

    def logs(table: dict[str, np.ndarray], size_of) -> np.ndarray:
        out = np.zeros((len(table), len(languages)), np.float32)
        for i, (gram, n) in enumerate(table.items()):
            sums = np.array([total.get((k, size_of(gram)), 0) for k in range(len(languages))], float)
            out[i] = np.log((n + 0.5) / (sums + 0.5 * len(table) + 1.0))
        return out

    return Model(
        languages,
        {w: i for i, w in enumerate(counts[0])},
        {g: i for i, g in enumerate(counts[1])},
        logs(counts[0], lambda g: 0),
        logs(counts[1], len),
    )


class _Rows(dict):
    """Word to row of ``logs``; an unseen word gets a row by backing off when first met."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.known = model, len(model.words)
        self.logs = np.zeros((self.known + REMEMBERED, len(model.languages)), np.float32)
        self.logs[: self.known] = model.word_logs

    def __missing__(self, word: str) -> int:
        marked, row, grams = f"^{word}$", len(self), self.model.grams
        for size in range(min(MAX_GRAM, len(marked)), 0, -1):
            found = [at for i in range(len(marked) - size + 1) if (at := grams.get(marked[i : i + size])) is not None]
            if found:
                self.logs[row] = self.model.gram_logs[found].mean(axis=0)
                break
        else:
            self.logs[row] = 0.0
        self[word] = row
        return row

    def forget(self) -> None:
        """Start over with the learned words before the remembered ones outgrow their place."""
        self.clear()
        self.update(self.model.words)


def classify(text: str | None, rows: _Rows) -> tuple[str, float]:
    words = _WORD.findall(text.lower()) if text else []
    languages = rows.model.languages
    if not words or not languages or not any(c.isalpha() for w in words for c in w):
        return UNKNOWN, 0.0
    sums, step = np.zeros(len(languages)), REMEMBERED // 4
    for start in range(0, len(words), step):
        part = words[start : start + step]
        if len(rows) + len(part) > len(rows.logs):
            rows.forget()
        at = np.fromiter(map(rows.__getitem__, part), np.int64, len(part))
        sums += rows.logs[at].sum(axis=0, dtype=np.float64)
    mean = sums / len(words) * min(len(words), SURE_WORDS)
    best = int(mean.argmax())
    return languages[best], 1.0 / float(np.exp(mean - mean[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, judged by ``text`` alone."""
    # Plain values only: a class in a broadcast would have to be installed on the executors.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("given"))
    place = kept.index("text")

    # Rows pass through the judge, so a filter on its verdict cannot make Spark ask it twice.
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(Model(*shared.value))
        for batch in batches:
            found = [classify(x.as_py(), rows) for x in batch.column(0).field(place)]
            verdict = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *verdict], ["given", "lang_pred", "score"])

    schema = StructType().add("given", given.schema["given"].dataType).add("lang_pred", StringType()).add("score", DoubleType())
    return given.mapInArrow(judge, schema).select("given.*", "lang_pred", "score")
