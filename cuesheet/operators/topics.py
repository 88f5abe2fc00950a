"""Common and distinctive points of a sector (A20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators.similarity import THRESHOLD, similar_clusters


def common_and_distinctive(points: DataFrame, top_k: int, threshold: float = THRESHOLD) -> DataFrame:
    """Clusters of alike points per sector, common ones and each video's own.

    ``points(sector_id, video_id, ord, relevance_pct, embedding)``, ``ord`` naming the point. Points
    are clustered by similarity (see ``similar_clusters``); the source gives no threshold, so it is a
    parameter. A cluster of several videos is common core, one of a single video is distinctive.
    Per sector and kind the ``top_k`` clusters by their best relevance are kept.
    """
    clusters = (
        similar_clusters(points, ["sector_id"], "ord", "embedding", threshold)
        .groupBy("sector_id", "cluster")
        .agg(
            F.countDistinct("video_id").alias("n_videos"),
            F.count(F.lit(1)).alias("n_points"),
            F.max("relevance_pct").alias("relevance_pct"),
            F.min_by(F.struct("video_id", "ord"), F.struct(-F.col("relevance_pct"), "video_id", "ord")).alias("_best"),
        )
        .withColumn("kind", F.when(F.col("n_videos") > 1, "common").otherwise("distinctive"))
    )
    best = Window.partitionBy("sector_id", "kind").orderBy(F.col("relevance_pct").desc(), "cluster")
    return (
        clusters.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
        .select(
            "sector_id", "kind", "rank", "cluster", "n_videos", "n_points", "relevance_pct",
            F.col("_best.video_id").alias("video_id"), F.col("_best.ord").alias("ord"),
        )
    )
