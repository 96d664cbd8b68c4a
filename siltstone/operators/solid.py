"""Solid archives: unique chunks of a kind share a stream of one of three lanes, in segments of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shared import kept
from . import chunks, routing

#: Bytes that the streams of one segment have about.
SEGMENT_BYTES = 16 << 20


def write(entries: DataFrame, target: str, sizes: tuple[int, int, int] = (chunks.LEAST, chunks.AVERAGE, chunks.MOST), segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write entries (path, content), whose paths differ, as entries, occurrences and lanes below target.

    Chunks are spread over segments by their digests, so segments are alike in size whatever the input; within a segment each
    lane's chunks are coded as one stream in the order of their digests, which lie beside it. Null content is an empty entry.
    """
    content = F.coalesce(F.col("content"), F.lit(b""))
    pieces = kept(chunks.content_chunks(entries.select("path", content.alias("content")), "path", "content", *sizes, payload=True))
    unique = pieces.groupBy("digest", "size").agg(F.min("bytes").alias("bytes"))
    total = pieces.select("digest", "size").distinct().agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    routed = routing.sampled_lanes(unique, ["digest", "size"], "bytes", keep=True)
    placed = routed.withColumn("segment", F.pmod(F.xxhash64("digest"), F.lit(max(1, math.ceil(total / segment_bytes)))))
    entries.select("path", F.octet_length(content).cast("bigint").alias("size"), C.digest(content).alias("digest")).write.parquet(f"{target}/entries")
    pieces.drop("bytes").write.parquet(f"{target}/occurrences")
    routing.solid_lanes(placed, "segment", ["digest", "size"], "lane", "bytes").write.parquet(f"{target}/lanes")


def read(spark: SparkSession, source: str) -> DataFrame:
    """(path, content, intact): every entry again, and whether its size and digest are those that were written."""
    unique = routing.open_lanes(spark.read.parquet(f"{source}/lanes"), "segment", ["digest", "size"]).select("digest", "size", "bytes")
    back = chunks.restore(spark.read.parquet(f"{source}/occurrences"), unique, "path")
    joined = spark.read.parquet(f"{source}/entries").join(back, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    return joined.select("path", "content", ((F.octet_length("content") == F.col("size")) & (C.digest(F.col("content")) == F.col("digest"))).alias("intact"))


def lane_sizes(spark: SparkSession, source: str) -> DataFrame:
    """(lane, chunks, raw_bytes, payload_bytes) of an archive."""
    return spark.read.parquet(f"{source}/lanes").groupBy("lane").agg(F.sum("n").alias("chunks"), F.sum("raw_bytes").alias("raw_bytes"), F.sum(F.octet_length("payload")).cast("bigint").alias("payload_bytes"))
