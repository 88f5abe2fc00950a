"""Typed readers and JSON ingest (S family).

Every ``parse_*`` takes JSON text in a column, so it works on a file, a table or a stream, and
returns good rows and quarantined rows; ``read_*`` wrap files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.functions.structs import is_json
from cuesheet.operators.ranking import strongest_boxes
from cuesheet.sources import shapes

VIDEO_ID_CHARS = 11
SEGMENTS = "array<struct<from_sec:double,to_sec:double,text:string>>"
BOOK = (
    "struct<collection_id:string,center_goal:string,segments:array<struct<video_id:string,"
    "from_sec:double,to_sec:double,title:string,text:string,relevance_pct:double,"
    "has_visual_structure:boolean>>>"
)
MANIFEST = (
    "struct<manifest_id:string,schema_version:string,video_id:string,"
    "summary:struct<total:bigint,verified:bigint,unverified:bigint,dropped:bigint,redrawn:bigint,keyframes:bigint>,"
    "figures:array<struct<figure_id:string,kind:string,verification_status:string,extraction_confidence:double,"
    "png_300dpi_url:string,vector_pdf_url:string,vector_svg_url:string,drop_reason:string,"
    "source_atom_refs:array<int>,source_extraction_data:variant,timestamp_sec:double,dpi:int>>>"
)
OUTLINE = (
    "struct<video_id:string,generator_version:string,lang:string,v2_fingerprint:string,"
    "slides:array<struct<position:int,layout:string,title:string>>>"
)
BOXES = (
    "struct<image:struct<w:int,h:int>,model_version:string,boxes:array<struct<bbox:"
    "struct<x:double,y:double,w:double,h:double>,cls:string,score:double>>>"
)
SUMMARY = (
    "struct<video_id:string,template_version:string,source_language:string,quality_flag:string,"
    "transcript_used:boolean,core:struct<one_liner:string,domain:string,depth_level:string,"
    "content_type:string,target_audience:string>,analysis:struct<core_argument:string,"
    "key_concepts:array<struct<term:string,definition:string>>,entities:array<struct<name:string,type:string>>>,"
    "segments:struct<sections:array<struct<idx:int,from_sec:double,to_sec:double,title:string,summary:string,"
    "relevance_pct:double,key_points:array<struct<text:string,timestamp_sec:double>>>>,"
    "atoms:array<struct<idx:int,type:string,text:string,timestamp_sec:double,entity_refs:array<string>>>>,"
    "mandala_relevance_pct:double>"
)
_MAYBE = {"required": False, "nullable": True}
# Fields of a summary that are consumed, in the order they are checked.
SUMMARY_SHAPE = shapes.record(
    {
        "video_id": shapes.text(lambda v: F.length(v) == VIDEO_ID_CHARS),
        "template_version": shapes.text(lambda v: v == "v2"),
        "source_language": shapes.text(**_MAYBE),
        "quality_flag": shapes.text(lambda v: v == "pass"),
        "transcript_used": shapes.flag(True),
        "core": shapes.record({n: shapes.text() for n in ("one_liner", "domain", "depth_level", "content_type", "target_audience")}),
        "analysis": shapes.record(
            {
                "core_argument": shapes.text(required=False),
                "key_concepts": shapes.listed(shapes.record({"term": shapes.text(), "definition": shapes.text()}), **_MAYBE),
                "entities": shapes.listed(shapes.record({"name": shapes.text(), "type": shapes.text()}), **_MAYBE),
            }
        ),
        "segments": shapes.record(
            {
                "sections": shapes.listed(
                    shapes.record(
                        {
                            "idx": shapes.number(**_MAYBE),
                            "from_sec": shapes.number(),
                            "to_sec": shapes.number(),
                            "title": shapes.text(),
                            "summary": shapes.text(**_MAYBE),
                            "relevance_pct": shapes.number(),
                            "key_points": shapes.listed(
                                shapes.record({"text": shapes.text(), "timestamp_sec": shapes.number(**_MAYBE)}), **_MAYBE
                            ),
                        }
                    ),
                    **_MAYBE,
                ),
                "atoms": shapes.listed(
                    shapes.record(
                        {
                            "idx": shapes.number(**_MAYBE),
                            "type": shapes.text(),
                            "text": shapes.text(),
                            "timestamp_sec": shapes.number(**_MAYBE),
                            "entity_refs": shapes.listed(shapes.text(), **_MAYBE),
                        }
                    ),
                    **_MAYBE,
                ),
            },
            **_MAYBE,
        ),
        "mandala_relevance_pct": shapes.number(**_MAYBE),
    }
)
MANIFEST_VERSIONS = ("1.0",)


def load_captions(captions: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Caption segments of known videos, one row each; unreadable rows in quarantine.

    ``captions(caption_id, video_id, segments)``; of several rows per video the lowest id is
    taken. ``videos(id, external_id)``.
    """
    first = Window.partitionBy("video_id").orderBy("caption_id")
    chosen = (
        captions.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        .join(videos, captions["video_id"] == videos["id"])
        .select("caption_id", "external_id", "segments")
    )
    parsed, bad = parse_json(chosen, SEGMENTS, "segments")
    good = parsed.select("external_id", F.posexplode("doc").alias("ord", "_s"))
    return good.select("external_id", F.col("ord").cast("bigint").alias("ord"), "_s.*"), bad


def parse_summaries(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries whose consumed fields all fit; others in quarantine with ``bad_path``.

    The path is that of the first field, in document order, that is missing or of a wrong kind:
    ``$.segments.sections[2].title``; ``$`` is a text that is not one JSON value. Other fields pass.
    """
    parsed = texts.withColumn("_v", F.try_parse_json("raw"))
    judged = parsed.withColumn("bad_path", shapes.first_bad(F.col("_v"), SUMMARY_SHAPE)).drop("_v")
    good = judged.where("bad_path is null").select(F.from_json("raw", SUMMARY).alias("doc")).select("doc.*")
    return good, judged.where("bad_path is not null")


def summary_sections(summaries: DataFrame) -> DataFrame:
    """Sections by position in the document, not by their stored number."""
    return summaries.select(
        "video_id", F.posexplode("segments.sections").alias("index", "_s")
    ).select("video_id", "index", "_s.from_sec", "_s.to_sec", "_s.title", "_s.summary", "_s.relevance_pct")


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, its text in ``raw``."""
    return spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "raw")


def parse_json(texts: DataFrame, schema: str, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """``doc`` for readable rows; rows that are not one JSON value in quarantine.

    A field of the wrong type reads as null, so checks on required fields catch it.
    """
    readable = is_json(F.col(column))
    # Exploding an array of one keeps later filters from parsing every text again.
    doc = F.array_compact(F.array(F.when(readable, F.from_json(column, schema))))
    return texts.select("*", F.explode(doc).alias("doc")), texts.where(~readable)


def parse_book_index(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of a book with their position."""
    good, bad = parse_json(texts, BOOK)
    rows = good.select(
        "doc.collection_id", "doc.center_goal", F.posexplode("doc.segments").alias("pos", "_s")
    ).select("collection_id", "center_goal", "pos", "_s.*")
    return rows, bad.unionByName(good.where("doc.segments is null").drop("doc"))


def sample_set(entries: DataFrame) -> DataFrame:
    """Entries ``(index, video_id)``; raises when an index occurs twice."""
    repeated = entries.groupBy("index").count().where("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"duplicate sample index: {sorted(str(r['index']) for r in repeated)}")
    return entries


def parse_manifests(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests of a supported version; others in quarantine with the failing stage."""
    good, bad = parse_json(texts, MANIFEST)
    known = F.coalesce(F.col("doc.schema_version").isin(*MANIFEST_VERSIONS), F.lit(False))
    rejected = bad.withColumn("stage", F.lit("manifest_parse")).unionByName(
        good.where(~known).drop("doc").withColumn("stage", F.lit("manifest_version_check"))
    )
    return good.where(known).select("doc.*"), rejected


def parse_outlines(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outlines whose video id has the fixed length; others in quarantine."""
    good, bad = parse_json(texts, OUTLINE)
    fits = F.coalesce(F.length("doc.video_id") == VIDEO_ID_CHARS, F.lit(False))
    return good.where(fits).select("doc.*"), bad.unionByName(good.where(~fits).drop("doc"))


def ingest_boxes(replies: DataFrame, k: int = 50, min_score: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Detector replies ``(frame_id, raw)`` to one row per box: strong ones, strongest first, capped.

    Unreadable replies in quarantine.
    """
    good, bad = parse_json(replies, BOXES)
    rows = good.select(
        "frame_id", "doc.image", F.posexplode("doc.boxes").alias("box_index", "_b")
    ).select(
        "frame_id", "box_index", "_b.bbox.x", "_b.bbox.y", "_b.bbox.w", "_b.bbox.h", "_b.cls", "_b.score",
        F.col("image.w").alias("img_w"), F.col("image.h").alias("img_h"),
    )
    return strongest_boxes(rows, k, min_score), bad
