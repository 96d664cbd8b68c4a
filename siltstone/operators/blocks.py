"""Fixed blocks, byte statistics and lanes of content columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import kernels as N

STATISTICS = [*N.FEATURES, "delta4_entropy"]


def fixed_blocks(entries: DataFrame, block: int, content: str = "content") -> DataFrame:
    """entries without content, one row per block: block_no, bytes. Empty or null content has none."""
    rows = entries.withColumn("_n", F.octet_length(content)).where("_n > 0")
    numbered = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block).cast("int"))).alias("block_no"))
    return numbered.select(*(c for c in entries.columns if c != content), "block_no", F.substring(F.col(content), F.col("block_no") * block + 1, F.lit(block)).alias("bytes"))


def block_statistics(entries: DataFrame, key: str, content: str, wanted: list[str] | None = None, also: list[str] = []) -> DataFrame:  # noqa: B006
    """A row per entry: key, size, the seven features, delta4_entropy, random_looking, rle_size, delta8_size and lane; of those
    after size only the wanted ones, if named, are worked out. also names columns that are kept behind them, content among them
    if it is wanted.

    Null content counts as empty: every statistic 0, lane standard. Rows are independent, so this never shuffles.
    """
    base = entries.select(F.col(key), F.col(content).alias("_content"), *(c for c in also if c != content))
    kinds = {**{n: T.DoubleType() for n in STATISTICS}, "random_looking": T.BooleanType(), "rle_size": T.LongType(), "delta8_size": T.LongType(), "lane": T.StringType()}
    names = [n for n in kinds if wanted is None or n in wanted]
    schema = T.StructType([T.StructField(key, base.schema[key].dataType), T.StructField("size", T.LongType()), *(T.StructField(n, kinds[n]) for n in names), *(T.StructField(c, entries.schema[c].dataType) for c in also)])
    places = [base.columns.index("_content" if c == content else c) for c in also]
    worked = {*names, "entropy_bits_per_byte", "delta4_entropy"} if "lane" in names else set(names)
    lanes = np.array(N.LANES, dtype=object)
    arrow = {T.DoubleType(): np.float64, T.BooleanType(): bool, T.LongType(): np.int64}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in N.pieces(batches, 1):
            s = N.statistics(*N.buffers(part.column(1)), worked)
            columns = [pa.array(lanes[N.exact_lanes(s)].tolist(), pa.string()) if n == "lane" else pa.array(s[n].astype(arrow[kinds[n]])) for n in names]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s["size"].astype(np.int64)), *columns, *(part.column(k) for k in places)], schema.names)

    return base.mapInArrow(apply, schema)


def byte_histogram(entries: DataFrame, by: str, content: str) -> DataFrame:
    """(by, byte, n): counts of byte values per group, combined in each batch before the shuffle."""
    base = entries.select(F.col(by).cast("string").alias(by), F.col(content).alias("_content"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in N.pieces(batches, 1):
            codes = part.column(0).dictionary_encode()
            of = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.zeros((len(codes.dictionary) + 1, 256), np.int64)
            np.add.at(counts, of, N.histogram(*N.buffers(part.column(1))))
            group, byte = np.nonzero(counts)
            labels = pa.concat_arrays([codes.dictionary, pa.nulls(1, pa.string())]).take(pa.array(group))
            yield pa.RecordBatch.from_arrays([labels, pa.array(byte.astype(np.int32)), pa.array(counts[group, byte])], [by, "byte", "n"])

    return base.mapInArrow(apply, f"{by} string, byte int, n bigint").groupBy(by, "byte").agg(F.sum("n").alias("n"))


def entropy_of(counts: DataFrame, by: str) -> DataFrame:
    """(by, entropy): bits per byte of a histogram."""
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("weighted"))
    return totals.select(by, (F.log2("total") - F.col("weighted") / F.col("total")).alias("entropy"))


def average_features(stats: DataFrame, *by: str) -> DataFrame:
    """Mean of each feature and the share of random-looking blocks, per group or, without by, over all (zeros if empty)."""
    means = [F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in N.FEATURES]
    return stats.groupBy(*by).agg(*means, F.coalesce(F.avg(F.col("random_looking").cast("double")), F.lit(0.0)).alias("random_looking_ratio"))


def candidate_codecs(smoothness: Column, size: Column, entropy: Column) -> Column:
    """The codecs that the balanced profile tries, in registry order."""
    return F.array_compact(F.array(F.lit("RAW"), F.lit("RLE"), F.when(smoothness >= 0.55, "DELTA8"), F.when((size >= 256) & (entropy < 7.75), "BYTE_RANS"), F.lit("DEFLATE")))


def scaled_frequencies(counts: DataFrame, by: str) -> DataFrame:
    """(by, byte, n, frequency, start): rANS frequencies that sum to 4096, and their running total below each byte.

    Groups are at most 256 rows; of a surplus, the largest frequencies give one each in turn.
    """

    def scale(pdf):
        from ..functions.codecs import frequencies

        f = frequencies(dict(zip(pdf["byte"].tolist(), pdf["n"].tolist())))
        pdf = pdf.sort_values("byte").assign(frequency=[f[b] for b in sorted(f)])
        return pdf.assign(start=pdf["frequency"].cumsum() - pdf["frequency"])

    kind = counts.schema[by].dataType.simpleString()
    return counts.groupBy(by).applyInPandas(scale, f"{by} {kind}, byte int, n bigint, frequency int, start int")


def padding(entries: DataFrame, size: str, block: int, *by: str) -> DataFrame:
    """Sums of raw and padded sizes and what padding adds."""
    return entries.groupBy(*by).agg(F.sum(size).cast("bigint").alias("raw_bytes"), F.sum(C.padded(F.col(size), block)).cast("bigint").alias("padded_bytes"), F.sum(C.padded(F.col(size), block) - F.col(size)).cast("bigint").alias("overhead_bytes"))
