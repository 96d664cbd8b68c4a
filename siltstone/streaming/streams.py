"""Incremental chunking, deduplication and order checks with Structured Streaming.

Every stream here can be run to the end of its input (available-now) into Parquet in the shared folder, with its checkpoint
beside it; a batch is committed whole or not at all.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels as N
from ..sources.shared import shared_dir


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    """A Parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives up to the end of its present input."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def chunk_parts(parts: DataFrame, key: str, least: int, average: int, most: int) -> DataFrame:
    """(key, seq, off, size, digest): content-defined chunks of byte streams that arrive in parts.

    parts: key, part_no, bytes, last. Parts of a key are taken in the order of part_no within a batch, and come in that
    order from batch to batch. What follows the last cut is kept as state (below most bytes) until the key's last part.
    """
    N.check_sizes(least, average, most)
    kind = parts.schema[key].dataType.simpleString()

    def cut(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seq, off = state.get if state.exists else (b"", 0, 0)
        pdf = pd.concat(frames)
        pdf = pdf.sort_values("part_no") if len(pdf) > 1 else pdf
        data = bytes(held) + b"".join(b for b in pdf["bytes"] if b is not None)
        ends = N.cuts(np.frombuffer(data, np.uint8), least, average, most)
        over = bool(pdf["last"].any())
        # the last cut is only sure where the fingerprint or the greatest size made it
        if not over and ends:
            begin = ends[-2] if len(ends) > 1 else 0
            sure = N.cuts(np.frombuffer(data[begin:] + bytes(1), np.uint8), least, average, most)[0] == len(data) - begin and len(data) - begin >= least
            ends = ends if sure else ends[:-1]
        rows, at = [], 0
        for end in ends:
            piece = data[at:end]
            rows.append((*who, seq, off, len(piece), hashlib.sha256(piece).hexdigest()))
            seq, off, at = seq + 1, off + len(piece), end
        if over:
            state.remove()
        else:
            state.update((data[at:], seq, off))
        yield pd.DataFrame(rows, columns=[key, "seq", "off", "size", "digest"])

    return parts.groupBy(key).applyInPandasWithState(cut, f"{key} {kind}, seq int, off bigint, size int, digest string", "held binary, seq int, off bigint", "append", GroupStateTimeout.NoTimeout)


def distinct_content(stream: DataFrame) -> DataFrame:
    """The first row of each (digest, size) over the whole stream; state grows with the distinct contents."""
    return stream.dropDuplicates(["digest", "size"])


def nearby_sources(stream: DataFrame, key: str, reach: int) -> DataFrame:
    """(key, off, digest, source_off): blocks (key, off, digest) with the latest earlier offset of equal content, if it is
    within reach bytes. Offsets of a key ascend from batch to batch; state holds the offsets still within reach."""
    kind = stream.schema[key].dataType.simpleString()

    def look(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*state.get)) if state.exists else {}
        rows, last = [], 0
        for off, digest in pd.concat(frames).sort_values("off")[["off", "digest"]].itertuples(index=False):
            old = seen.get(digest)
            rows.append((*who, off, digest, old if old is not None and off - old <= reach else None))
            seen[digest], last = off, off
        seen = {d: o for d, o in seen.items() if last - o <= reach}
        state.update((list(seen), list(seen.values())))
        yield pd.DataFrame(rows, columns=[key, "off", "digest", "source_off"]).astype({"source_off": "Int64"})

    return stream.groupBy(key).applyInPandasWithState(look, f"{key} {kind}, off bigint, digest string, source_off bigint", "digests array<string>, offs array<bigint>", "append", GroupStateTimeout.NoTimeout)


def consecutive(stream: DataFrame, key: str, index: str) -> DataFrame:
    """(key, index, want): frames whose index isn't the next of their stream, which begins at 0."""
    kind = stream.schema[key].dataType.simpleString()

    def check(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        want = state.get[0] if state.exists else 0
        rows = []
        for i in sorted(int(x) for f in frames for x in f[index]):
            if i != want:
                rows.append((*who, i, want))
            want = i + 1
        state.update((want,))
        yield pd.DataFrame(rows, columns=[key, index, "want"])

    return stream.groupBy(key).applyInPandasWithState(check, f"{key} {kind}, {index} bigint, want bigint", "want bigint", "append", GroupStateTimeout.NoTimeout)


def publish_at_end(stream: DataFrame, target: str) -> None:
    """Batches gather in a staging folder; target appears, in one rename, only when the stream has ended well."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path
    source, to = path(f"{folder}/rows"), path(target)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(to) or not files.rename(source, to):
        raise FileExistsError(target)


class Progress(StreamingQueryListener):
    """Calls tell(rows so far) after each batch; what it raises never reaches the query."""

    def __init__(self, tell: Callable[[int], None]):
        self.tell, self.rows = tell, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        try:
            self.tell(self.rows)
        except Exception:  # a callback mustn't harm the output
            pass

    def onQueryTerminated(self, event) -> None:
        pass


def conversation_parts(turns: DataFrame) -> DataFrame:
    """conversations as parts of byte streams, each of which stands for a stream of its own turn order."""
    return turns.select("conv_id", F.col("turn").alias("part_no"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("bytes"), F.lit(True).alias("last"))


def windowed_peaks(samples: DataFrame, by: str, at: str, value: str, every: str) -> DataFrame:
    """(by, at, samples, peak): the highest value of each group in windows of time, over the stream to the end of its present
    input. Each batch replaces the table of all windows, so late samples count; state is a row a group and window."""
    spark = samples.sparkSession
    folder = f"{shared_dir(spark)}/peaks-{uuid.uuid4().hex}"
    found = samples.groupBy(by, F.window(F.col(at).cast("timestamp"), every).alias("w")).agg(F.count("*").alias("samples"), F.max(value).alias("peak"))
    rows = found.select(by, F.col("w.start").alias(at if by != at else "at"), "samples", "peak").toDF(by, "at", "samples", "peak")
    rows.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows")).outputMode("complete").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")
