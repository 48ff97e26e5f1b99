"""The vector index on disk: Parquet tables and a one-row table that is checked on opening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import SCALE

#: The mark of an index of this library, and the version of its layout.
MAGIC, VERSION = 0x4C4F4F4D, 7


def write_index(path: str, centroids: DataFrame, clusters: DataFrame, pages: DataFrame) -> None:
    """Pages are written sorted by cluster, a large cluster by several tasks, so that a reader skips row groups of other clusters."""
    spark = pages.sparkSession
    totals = clusters.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("b"), F.count("*").alias("k")).first()
    pages.repartitionByRange("cluster_id", "page").sortWithinPartitions("cluster_id", "page").write.option("parquet.block.size", 16 << 20).parquet(f"{path}/pages")
    clusters.coalesce(1).write.parquet(f"{path}/clusters")
    centroids.coalesce(1).write.parquet(f"{path}/centroids")
    meta = [(MAGIC, VERSION, int(totals["k"]), int(totals["n"]), int(totals["b"]), float(SCALE))]
    spark.createDataFrame(meta, "magic int, version int, k int, n long, n_blocks long, scale float").coalesce(1).write.parquet(f"{path}/index_meta")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(centroids, clusters, pages); raises ValueError if the table was not written by this format."""
    meta = spark.read.parquet(f"{path}/index_meta").limit(2).collect()
    if len(meta) != 1 or meta[0]["magic"] != MAGIC:
        raise ValueError("not an index")
    if meta[0]["version"] != VERSION:
        raise ValueError(f"index version {meta[0]['version']}, not {VERSION}")
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("centroids", "clusters", "pages"))
