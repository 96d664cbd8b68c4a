"""Content-defined chunks, exact deduplication of them, and restoring entries from the unique ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as N
from ..sources.shared import kept

LEAST, AVERAGE, MOST = 16 << 10, 64 << 10, 256 << 10


def content_chunks(entries: DataFrame, key: str, content: str, least: int = LEAST, average: int = AVERAGE, most: int = MOST, payload: bool = False) -> DataFrame:
    """(key, seq, off, size, digest[, bytes]): the content-defined chunks of each entry. Empty and null content has none."""
    N.check_sizes(least, average, most)
    base = entries.select(F.col(key), F.col(content).alias("_content"))
    fields = [T.StructField(key, base.schema[key].dataType), T.StructField("seq", T.IntegerType()), T.StructField("off", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("digest", T.StringType())]
    schema = T.StructType(fields + [T.StructField("bytes", T.BinaryType())] * payload)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in N.pieces(batches, 1):
            data, off = N.buffers(part.column(1))
            ends, counts = N.cuts_many(data, off, least, average, most)
            begin = np.r_[0, ends][: len(ends)]  # rows lie one after another, so chunks do
            owner = np.repeat(np.arange(part.num_rows), counts)
            seq = np.arange(len(ends)) - np.repeat(np.cumsum(counts) - counts, counts)
            view = memoryview(data)
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(begin.tolist(), ends.tolist())]
            columns = [part.column(0).take(pa.array(owner)), pa.array(seq.astype(np.int32)), pa.array(begin - off[owner]), pa.array((ends - begin).astype(np.int32)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [N.rows_of(data, np.r_[0, ends])] * payload, schema.names)

    return base.mapInArrow(apply, schema)


def canonical(occurrences: DataFrame, order: list[str], same: list[str] | None = None) -> DataFrame:
    """occurrences with first, the struct of the order columns of the first occurrence with the same digest and size; nulls
    are the same as nulls.

    The minimum is aggregated before it is joined back, so that a chunk that occurs everywhere doesn't gather in one task.
    """
    same = same or ["digest", "size"]
    firsts = occurrences.groupBy(*same).agg(F.min(F.struct(*order)).alias("first"))
    keys = firsts.select(*(F.col(c).alias(f"_same{k}") for k, c in enumerate(same)), "first")
    alike = [occurrences[c].eqNullSafe(keys[f"_same{k}"]) for k, c in enumerate(same)]
    return occurrences.join(keys, alike).select(*(occurrences[c] for c in occurrences.columns), "first")


def accounting(occurrences: DataFrame, order: list[str], owner: str, size: str = "size") -> DataFrame:
    """One row: logical, unique and duplicate counts and bytes saved, and of these what crosses owners.

    Content is counted by owner, then over owners: two combined aggregations, whatever occurs how often. Null digests are one
    content, a null owner is an owner, null sizes count as 0.
    """
    owned = occurrences.groupBy("digest", F.coalesce(size, F.lit(0)).alias("size"), owner).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    content = owned.groupBy("digest", "size").agg(F.sum("n").alias("n"), F.min(F.struct("first", "n")).alias("own"))
    total = lambda value: F.coalesce(F.sum(value), F.lit(0)).cast("bigint")
    again, cross = F.col("n") - 1, F.col("n") - F.col("own.n")
    return content.agg(
        total(F.col("n")).alias("logical_count"), F.count("*").alias("unique_count"), total(again).alias("duplicate_count"), total(again * F.col("size")).alias("saved_bytes"),
        total(cross).alias("cross_count"), total(cross * F.col("size")).alias("cross_saved_bytes"),
    )


def windowed_dedup(blocks: DataFrame, stream: str, off: str, digest: str, reach: int) -> DataFrame:
    """blocks with source_off: the latest earlier offset with the same digest in the stream, if it is within reach bytes."""
    w = Window.partitionBy(stream, digest).orderBy(off)
    before = F.lag(off).over(w)
    return blocks.withColumn("source_off", F.when(F.col(off) - before <= reach, before))


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with, for each name of sums, the sum of its value column over all rows before in order.

    One shuffle: rows are sorted into ranges, each range sums its own rows as it is written, and the ranges' totals, one row
    a partition, are summed apart and broadcast. What is summed is what was written, so no second partitioning can
    disagree. Null values count as 0, null keys come first; rows of equal keys come in any order, each after the others'
    values. Values are whole numbers.
    """
    width = len(rows.columns)
    base = rows.toDF(*(f"c{k}" for k in range(width)))
    place = {c: f"c{k}" for k, c in enumerate(rows.columns)}
    keyed = rows.select("*", *order).toDF(*base.columns, *(f"o{k}" for k in range(len(order))))
    keys = [f"o{k}" for k in range(len(order))]
    values = [F.col(place[v]).cast("bigint").alias(f"v{k}") for k, v in enumerate(sums)]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*base.columns, *values)
    totals = [f"s{k}" for k in range(len(sums))]
    schema = T.StructType([*placed.schema.fields[:width], T.StructField("part", T.IntegerType()), *(T.StructField(f"v{k}", T.LongType()) for k in range(len(sums))), *(T.StructField(s, T.LongType()) for s in totals)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, upto = TaskContext.get().partitionId(), np.zeros(len(sums), np.int64)
        for batch in batches:
            own = [batch.column(width + k).fill_null(0).to_numpy() for k in range(len(sums))]
            before = [t + np.cumsum(v) - v for t, v in zip(upto, own)]
            upto = upto + [int(v.sum()) for v in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(np.full(batch.num_rows, part, np.int32)), *map(pa.array, own), *map(pa.array, before)], schema.names)

    local = kept(placed.mapInArrow(run, schema))
    parts = local.groupBy("part").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(len(sums))))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("part").alias("of"), *(F.coalesce(F.sum(f"v{k}").over(upto), F.lit(0)).alias(f"b{k}") for k in range(len(sums))))
    out = local.join(F.broadcast(before), F.col("part") == F.col("of"))
    return out.select(*base.columns, *((F.col(s) + F.col(f"b{k}")).cast("bigint") for k, s in enumerate(totals))).toDF(*rows.columns, *sums.values())


def prefix_sum(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with name, the sum of value over all rows before in order; see prefix_sums."""
    return prefix_sums(rows, order, {value: name})


def restore(occurrences: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """(key, content): entries put together again from the unique (digest, size, bytes) in the order of seq.

    A chunk that unique lacks is an error. Chunks are joined in the sorted partition of their entry, so what a task holds is one
    entry's bytes.
    """
    stored = unique.select(F.col("digest").alias("_d"), F.col("size").alias("_n"), "bytes")
    parts = occurrences.select(key, "seq", "digest", "size").join(stored, (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_n")), "left").select(key, "seq", "bytes")
    schema = T.StructType([T.StructField(key, occurrences.schema[key].dataType), T.StructField("content", T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun, kind = None, [], None

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([b"".join(begun)], pa.binary())], schema.names)

        for batch in batches:
            who, kind = batch.column(0).to_pylist(), batch.column(0).type
            if not who:
                continue
            if batch.column(2).null_count:
                raise ValueError(f"entry {who[batch.column(2).is_null().index(True).as_py()]!r} lacks a chunk")
            data, off = N.buffers(batch.column(2))
            first = [0, *(k for k in range(1, len(who)) if who[k] != who[k - 1]), len(who)]
            if begun and who[0] == held:
                begun.append(data[: off[first[1]]].tobytes())
                first = first[1:]
            if len(first) > 1:
                if begun:
                    yield whole()
                if len(first) > 2:  # all entries but the last end here
                    at = off[first[:-1]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first[:-2])), N.rows_of(data[at[0] :], at - at[0])], schema.names)
                held, begun = who[first[-2]], [data[off[first[-2]] :].tobytes()]
        if begun:
            yield whole()

    return parts.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(join, schema)


def pack_segments(records: DataFrame, stream: str, order: str, size: str, most: int) -> DataFrame:
    """(stream, order, size, segment): greedy packing in order, a new segment where the next record would pass most bytes.

    A pass over the sorted partitions, linear and with no list of a stream's records; a null size counts as 0.
    """
    base = records.select(stream, order, size)
    schema = T.StructType([*base.schema.fields, T.StructField("segment", T.IntegerType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fill, segment, begun = None, 0, 0, False
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int32)
            for row, (who, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if not begun or who != held:
                    held, fill, segment, begun = who, 0, 0, True
                n = n or 0
                if fill and fill + n > most:
                    fill, segment = 0, segment + 1
                fill += n
                out[row] = segment
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], schema.names)

    return base.repartition(stream).sortWithinPartitions(stream, order).mapInArrow(pack, schema)
