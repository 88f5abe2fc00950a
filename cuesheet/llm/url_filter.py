"""URL filter: host and path rules first, a learned judge for every URL no rule fits.

The judge is a logistic regression on hashed character n-grams of host and path. It learns
from a small labelled table of URLs, here the bounded sample of URLs that rules decide.

Defined results: a null URL or one without ``://`` has an empty host and path and is judged
like any other. If nothing was learned, the verdict is ``allow``; with one label only, that
label. Of rules that fit, the longest wins; equally long ones in order of the list. Extra
columns pass through; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.bytewords import mix, utf8

FEATURES = 4_096
GRAMS = (2, 3, 4)
# Bound of the labelled table: different hosts and paths of each verdict.
TRAIN_URLS = 2_000
STEPS = 150
# URLs judged at a time.
BLOCK = 2_048

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    known = F.instr(url, "://") > 0
    host = F.when(known, F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1))
    path = F.when(known, F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1))
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_name(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.lit(r.name)).otherwise(chosen)
    return chosen


def _grams(column: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    found, owner = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        inside = row[: len(data) - n + 1] == row[n - 1 :]
        code = np.full(len(data) - n + 1, n + 16 * salt, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + data[k : len(data) - n + 1 + k]
        found.append(mix(code[inside]) % np.uint64(FEATURES))
        owner.append(row[: len(data) - n + 1][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def features(host: pa.Array, path: pa.Array) -> np.ndarray:
    """Which hashed n-grams each URL has, scaled to length one."""
    out = np.zeros((len(host), FEATURES), np.float32)
    for column, salt in ((host, 1), (path, 2)):
        gram, row = _grams(column, salt)
        out[row, gram] = 1
    length = np.sqrt(out.sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def learn(labelled: DataFrame) -> Model:
    """Fit on a small table ``(host, path, blocked int)``; it comes to the driver, so bound it."""
    rows = sorted(tuple(r) for r in labelled.select("host", "path", "blocked").collect())
    if not rows:
        return Model(np.zeros(FEATURES, np.float32), -1.0)
    x = features(pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()))
    y = np.array([r[2] for r in rows], np.float32)
    if y.min() == y.max():
        return Model(np.zeros(FEATURES, np.float32), 1.0 if y[0] else -1.0)
    # Both verdicts weigh the same; gradient steps with momentum.
    part = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)
    weights, bias, speed, bias_speed = np.zeros(FEATURES, np.float32), 0.0, np.zeros(FEATURES, np.float32), 0.0
    for _ in range(STEPS):
        wrong = (1 / (1 + np.exp(-(x @ weights + bias))) - y) * part
        speed = 0.9 * speed - 8.0 * (x.T @ wrong + 1e-5 * weights)
        bias_speed = 0.9 * bias_speed - 2.0 * float(wrong.sum())
        weights, bias = weights + speed, bias + bias_speed
    return Model(weights, bias)


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    Without a model one is learned from the URLs the rules decide: about ``TRAIN_URLS``
    different hosts and paths of each verdict, however often each is in the table.
    """
    host, path = host_and_path(F.col("url"))
    kept = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    read = pages.select(*kept, host.alias("host"), path.alias("path"))
    read = read.withColumn("rule", rule_name(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r.name for r in rules if r.verdict == "block"])
    if model is None:
        # Each host and path counts once: copies must not thin out what is learned from.
        known = read.where("rule is not null").select("host", "path", blocked.cast("int").alias("blocked")).distinct()
        counted = {r["blocked"]: r["count"] for r in known.groupBy("blocked").count().collect()}
        point = (F.pmod(F.xxhash64("host", "path"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
        share = F.when(F.col("blocked") == 1, TRAIN_URLS / max(1, counted.get(1, 0)))
        share = share.otherwise(TRAIN_URLS / max(1, counted.get(0, 0)))
        model = learn(known.where(point < share))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def block_score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            out = []
            for at in range(0, len(hosts), BLOCK):
                seen = features(hosts.slice(at, BLOCK), paths.slice(at, BLOCK))
                out.append(1 / (1 + np.exp(-(seen @ shared.value.weights + shared.value.bias))))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    by_rule = F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow"))
    scored = read.withColumn("block_score", block_score("host", "path"))
    return scored.withColumn("verdict", F.coalesce(by_rule, learned))
