"""Registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm import centroids, decontaminate, integers, language, line_dedup, mixing, near_dedup, neighbours, oracles
from cuesheet.llm import paragraph_dedup, passages, pieces, pii, quality, url_filter, vector_codes, vector_oracles
from cuesheet.llm.url_filter import Rule

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fold(column: str, folds: int):
    """Fold of a row by its id, as the contracts deal rows to learning and holding out."""
    return F.crc32(F.col(column).cast("string")) % folds


@query("op1_decontaminate", oracles.CONTAMINATION)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(load(spark, folder, "documents"), load(spark, folder, "benchmark")).drop(
        "hit_ranges", "hit_items"
    )


@query("op4_url_filter")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge(load(spark, folder, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


@query("op5_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    labels = load(spark, folder, "labels").where("quality is not null").select("doc_id", "quality").where(fold("doc_id", 5) != 0)
    model = quality.learn(quality.labelled_sample(docs, labels))
    scored = quality.score(docs, model)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", "predicted")


@query("op6_mix_sources", oracles.MIX)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(load(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_pii")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(load(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("op9_language")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    model = language.learn(docs.select("doc_id", "text", "lang").where(fold("doc_id", 4) != 2))
    judged = language.predict(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return judged.select("doc_id", held, "lang_pred", "score")


@query("op2_near_duplicates", oracles.NEAR_DUPLICATES)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, folder, "documents"))


@query("op3_paragraph_dedup", oracles.PARAGRAPHS)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    cut = paragraph_dedup.drop_repeated_paragraphs(load(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_paragraphs", "n_removed", F.array_join("removed", ",").alias("removed"), "text")


def ranges(column: str):
    """Ranges of words as one string."""
    return F.array_join(F.transform(column, lambda r: F.concat_ws("-", r["start"], r["end"])), ",")


@query("op3_repeated_passages", oracles.PASSAGES)
def op3_passages(spark: SparkSession, folder: str) -> DataFrame:
    cut = passages.drop_repeated_passages(load(spark, folder, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_words", "n_repeated", "n_removed", ranges("repeated").alias("repeated"), ranges("removed").alias("removed"), "text"
    )


@query("op10_line_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    cut = line_dedup.drop_common_blocks(load(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), "text")


@query("op8_nearest_neighbours")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(load(spark, folder, "embeddings"), every=100)


@query("op11_pieces")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(load(spark, folder, "documents").select("doc_id", "text"), model, packed=True)
    digested = encoded.select("doc_id", "ids", F.sha2("packed", 256).alias("ids_sha256"))
    return pieces.decode(digested, model).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids_sha256",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def digest(numbers: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


@query("op12_vector_codes", vector_oracles.CODES)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress(load(spark, folder, "embeddings"))
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    entries = [x for book in books.parts for entry in book.tolist() for x in entry]
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))


@query("op13_centroids", vector_oracles.CENTROIDS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(load(spark, folder, "embeddings"))
    # A value for each centroid, of which there are few.
    sums = [min(i, integers.LONGEST) for i in found.inertias]
    of_cluster = F.lit(sums).cast("array<bigint>")
    names = F.lit([digest(c) for c in found.centroids.tolist()]).cast("array<string>")
    at = F.col("cluster") + 1
    return found.vectors.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(of_cluster, at).alias("cluster_inertia"),
        F.lit(min(sum(found.inertias), integers.LONGEST)).cast("bigint").alias("inertia"),
        F.element_at(names, at).alias("centroid_sha256"),
    )
