"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Every source's documents are put in a fixed shuffled order and cut into blocks of equally many
words. The schedule has one slot for each block the mix takes: slot ``t`` looks at the
golden-ratio point ``frac(t * phi)``, finds the source whose stretch of the cumulative weights
holds it, and takes that source's next block, starting over when all were taken. So every
stretch of the schedule, not only the whole, is close to the weights.

No step gathers a source: ranks and running sums are taken in two levels, inside small parts
of a source (a hash part of its documents, a chunk of its slots) and then over the parts.

Defined results: a null text has size 0; zero-size documents and sources are never taken;
null sources are one source, ordered last; equal rows are independent rows. No document
is taken more than ``MOST_TIMES`` times. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.session import stored

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
# Words of a block. Rows of the schedule are words / BLOCK_WORDS: raise it for larger corpora.
BLOCK_WORDS = 64
CHUNK_SLOTS = 4_096
# Weight units of one slot, so that cumulative weights are exact whole numbers.
UNITS = 1 << 20
# Parts of the cumulative weights that a point is looked up by.
LOOKUP = 1_024
GOLDEN = (math.sqrt(5) - 1) / 2
GOLDEN_HIGH = 0.607787409740351  # fractional part of GOLDEN * 2**20


@dataclass
class Mix:
    """``sources``: key, size, target, blocks; ``slots``: slot, key, block; ``documents``: key,
    doc_id, size and the words ``start`` to ``stop`` it fills in its source's shuffled order."""

    sources: DataFrame
    slots: DataFrame
    documents: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _running(df: DataFrame, part: str, order: str, values: dict[str, str], group: str | None = None) -> DataFrame:
    """Add, for each ``{new: column}``, the sum over all rows before: inside ``part`` (whose
    order is that of the rows), plus all earlier parts."""
    by = f"partition by {group + ', ' if group else ''}"
    inside = df.withColumns(
        {f"_{n}": F.expr(f"coalesce(sum({c}) over ({by}{part} order by {order} rows between unbounded preceding and 1 preceding), 0)") for n, c in values.items()}
    )
    keys = [part, *([group] if group else [])]
    sums = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_{n}") for n, c in values.items()])
    over = f"over ({'partition by ' + group if group else ''} order by {part} rows between unbounded preceding and 1 preceding)"
    before = sums.select(*keys, *[F.expr(f"coalesce(sum(_{n}) {over}, 0)").alias(f"_{n}_before") for n in values])
    joined = inside.join(before, keys)
    return joined.withColumns({n: F.col(f"_{n}") + F.col(f"_{n}_before") for n in values}).drop(
        *[f"_{n}" for n in values], *[f"_{n}_before" for n in values]
    )


def _level(sources: DataFrame, total: int) -> float:
    """Words per weight at which the targets, capped, add up to ``total``.

    The capped sources' excess is shared again until no target is above its cap: every round
    is one aggregation over the sources and caps at least one more of them.
    """
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if not row["open"]:
            return level or 0.0
        raised = (total - row["fixed"]) / row["open"]
        if raised == level:
            return level
        level = raised


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> Mix:
    """Plan the mix of stored rows ``(key, doc_id, size)``."""
    by_source = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    # Sources in order: the range part goes first, so parts are ordered as their rows.
    ranged = stored(by_source.repartitionByRange("key").withColumn("_part", F.spark_partition_id()))
    placed = _running(ranged.withColumn("_one", F.lit(1)), "_part", "key", {"_place": "_one"})
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    placed = placed.select(
        "key",
        "source_size",
        "_part",
        F.element_at(cycle, (F.col("_place") % len(weights) + 1).cast("int")).cast("bigint").alias("weight"),
        (F.col("source_size") * MOST_TIMES).alias("cap"),
    )
    placed = stored(placed)
    total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level = _level(placed, total)
    blocks = F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.floor(F.col("source_size") / block_words + 0.5)))
    sources = placed.select(
        "key",
        "source_size",
        "_part",
        F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"),
        F.coalesce(blocks, F.lit(0)).cast("bigint").alias("blocks"),
    )
    wanted = F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("units", F.floor(wanted * UNITS + 0.5).cast("bigint"))
    sources = stored(_running(sources, "_part", "key", {"units_before": "units"}))
    units = sources.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("n")).first()["n"]
    slots = _schedule(sources, units)

    # The shuffled order is that of a digest; its first three digits are the part.
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    docs = sized.where("size > 0").withColumn("_digest", digest).withColumn("_hash_part", F.substring("_digest", 1, 3))
    documents = _running(docs, "_hash_part", "_digest, doc_id, size", {"start": "size"}, "key")
    documents = documents.select("key", "doc_id", "size", "start", (F.col("start") + F.col("size")).alias("stop"))
    return Mix(sources, slots, documents)


def _schedule(sources: DataFrame, units: int) -> DataFrame:
    """Slots in order, each with its source and the block of it to take."""
    n = (units + UNITS // 2) // UNITS
    low, high = F.col("slot") % UNITS, F.floor(F.col("slot") / UNITS)
    turn = low * F.lit(GOLDEN) + high * F.lit(GOLDEN_HIGH)
    point = F.least(F.floor((turn - F.floor(turn)) * float(units)).cast("bigint"), F.lit(max(units - 1, 0)))
    width = max(1, -(-units // LOOKUP))
    slots = (
        sources.sparkSession.range(n)
        .withColumnRenamed("id", "slot")
        .withColumn("point", point)
        .withColumn("lookup", F.expr(f"point div {width}"))
    )
    stretch = sources.where("units > 0").select(
        "key",
        "blocks",
        "units_before",
        (F.col("units_before") + F.col("units")).alias("units_to"),
        F.explode(F.expr(f"sequence(units_before div {width}, (units_before + units - 1) div {width})")).alias("lookup"),
    )
    inside = (F.col("point") >= F.col("units_before")) & (F.col("point") < F.col("units_to"))
    chosen = slots.join(stretch, "lookup").where(inside).select(
        "slot", "key", "blocks", F.expr(f"slot div {CHUNK_SLOTS}").alias("_chunk"), F.lit(1).alias("_one")
    )
    ranked = _running(chosen, "_chunk", "slot", {"rank": "_one"}, "key")
    return ranked.where(F.col("rank") < F.col("blocks") * MOST_TIMES).select(
        "slot", "key", (F.col("rank") % F.col("blocks")).alias("block")
    )


def pieces_of(mix: Mix) -> DataFrame:
    """Documents cut at block borders: ``key, block, doc_id, size, start, words``."""
    shape = mix.sources.select(
        "key", F.expr("source_size div blocks").alias("_q"), F.expr("source_size % blocks").alias("_r"), "blocks"
    ).where("blocks > 0")
    # The first _r blocks have one word more than the others.
    at = "if({p} < _r * (_q + 1), {p} div (_q + 1), _r + ({p} - _r * (_q + 1)) div greatest(_q, 1))"
    lo = "(block * _q + least(block, _r))"
    hi = "((block + 1) * _q + least(block + 1, _r))"
    joined = mix.documents.join(shape, "key")
    cut = joined.withColumn("block", F.explode(F.expr(f"sequence({at.format(p='start')}, {at.format(p='(stop - 1)')})")))
    return cut.select(
        "key", "block", "doc_id", "size", "start", F.expr(f"least(stop, {hi}) - greatest(start, {lo})").alias("words")
    )


def mixture(mix: Mix) -> DataFrame:
    """The mix itself: ``slot, key, block, doc_id, start, words``, to be read in order of slots."""
    return mix.slots.join(pieces_of(mix), ["key", "block"]).select("slot", "key", "block", "doc_id", "start", "words")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Words the mix takes of each row of ``docs (doc_id, text, source)``.

    Columns: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    sized = stored(docs.select("doc_id", key.alias("key"), word_count(F.col("text")).alias("size")))
    mix = plan(sized, weights, block_words)
    times = mix.slots.groupBy("key", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (
        pieces_of(mix)
        .join(times, ["key", "block"], "left")
        .groupBy("key", "start", "doc_id", "size")
        .agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("bigint").alias("taken"))
        .select("key", "doc_id", "size", "taken")
    )
    nothing = sized.where("size = 0").select("key", "doc_id", "size", F.lit(0).cast("bigint").alias("taken"))
    out = stored(taken.unionByName(nothing))
    return out.join(mix.sources.select("key", "source_size", "target"), "key").select(
        "doc_id",
        F.when(F.col("key") != "1", F.expr("substring(key, 2)")).alias("source"),
        "size",
        "source_size",
        "target",
        "taken",
    )
