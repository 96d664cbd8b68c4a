"""Codec trials, routed encoding, lanes and sealing of blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs as X
from ..functions import kernels as N

PROFILES = ("fast", "balanced", "research")


def spread(rows: DataFrame, key: list[str], each: int = 4) -> DataFrame:
    """rows in four partitions a core, or each: what takes seconds a MB mustn't wait for the few row groups of a file."""
    return rows.repartition(each * rows.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*key))


def encode_blocks(blocks: DataFrame, key: list[str], content: str, profile: str = "balanced", payload: bool = True) -> DataFrame:
    """(key..., size, mode, payload_size[, payload]) with the smallest payload that the profile's codecs give."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    base = blocks.select(*key, F.col(content).cast("binary").alias("_content"))
    if profile == "research":
        base = spread(base, key)
    at = len(key)
    fields = [*(base.schema[k] for k in key), T.StructField("size", T.IntegerType()), T.StructField("mode", T.StringType()), T.StructField("payload_size", T.IntegerType())]
    schema = T.StructType(fields + [T.StructField("payload", T.BinaryType())] * payload)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in N.pieces(batches, at):
            s = N.statistics(*N.buffers(part.column(at)), {"delta_smoothness_ratio", "entropy_bits_per_byte"}) if profile == "balanced" else None
            texts = [b or b"" for b in part.column(at).to_pylist()]
            sizes = [len(b) for b in texts]
            names = [N.balanced_candidates(s["delta_smoothness_ratio"][i], n, s["entropy_bits_per_byte"][i]) if s else ["RAW", "DEFLATE"] if profile == "fast" else None for i, n in enumerate(sizes)]
            modes, payloads = zip(*X.smallest_many(texts, names))
            columns = [*part.columns[:at], pa.array(sizes, pa.int32()), pa.array(modes, pa.string()), pa.array([len(p) for p in payloads], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(payloads, pa.binary())] * payload, schema.names)

    return base.mapInArrow(apply, schema)


def decode_blocks(encoded: DataFrame, key: list[str]) -> DataFrame:
    """(key..., content) of encode_blocks' rows; a payload that its codec refuses is an error."""
    base = encoded.select(*key, "size", "mode", "payload")
    at = len(key)
    schema = T.StructType([*(base.schema[k] for k in key), T.StructField("content", T.BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [X.CODECS[m].decode(p, n) for n, m, p in zip(*(batch.column(at + k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.binary())], schema.names)

    return base.mapInArrow(apply, schema)


def trial_sizes(blocks: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key..., one column of payload sizes for every codec in the registry)."""
    base = spread(blocks.select(*key, F.col(content).cast("binary").alias("_content")), key)
    at = len(key)
    schema = T.StructType([*(base.schema[k] for k in key), *(T.StructField(n.lower(), T.IntegerType()) for n in X.CODECS)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in N.pieces(batches, at):
            texts = [b or b"" for b in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:at], *(pa.array(list(map(len, p)), pa.int32()) for p in X.encode_all(texts).values())], schema.names)

    return base.mapInArrow(apply, schema)


def sampled_lanes(blocks: DataFrame, key: list[str], content: str, keep: bool = False) -> DataFrame:
    """(key...[, content], lane) where windows of long blocks decide unless they are ambiguous."""
    base = blocks.select(*key, F.col(content).cast("binary").alias(content))
    at = len(key)
    schema = T.StructType([*(base.schema[k] for k in key), *[T.StructField(content, T.BinaryType())] * keep, T.StructField("lane", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in N.pieces(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns[: at + keep], pa.array([N.LANES[N.sampled_lane(b or b"")] for b in part.column(at).to_pylist()], pa.string())], schema.names)

    return base.mapInArrow(apply, schema)


def solid_lanes(chunks: DataFrame, group: str, order: list[str], lane: str, content: str) -> DataFrame:
    """(group, lane, n, raw_bytes, sizes, payload, keys...): chunks of a lane joined in order and coded as one stream. keys are
    the order columns of the chunks, an array each, under their names with _keys.

    Lanes are spread over all cores by a hash, 8 partitions a core as some get more lanes than others, and come to a task sorted,
    so it holds the bytes of one lane.
    """
    base = chunks.select(F.col(group), F.col(lane).alias("lane"), F.col(content).alias("_content"), *(F.col(k).alias(f"{k}_keys") for k in order))
    keys = base.columns[3:]
    schema = T.StructType([
        base.schema[group], T.StructField("lane", T.StringType()), T.StructField("n", T.LongType()), T.StructField("raw_bytes", T.LongType()), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
        *(T.StructField(k, T.ArrayType(base.schema[k].dataType)) for k in keys),
    ])

    def code(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts = [N.buffers(part.column(2)) for part in held]
        data, sizes = b"".join(x.tobytes() for x, _ in texts), np.concatenate([np.diff(off) for _, off in texts])
        name = held[0].column(1)[0].as_py()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays([part.column(3 + k) for part in held])) for k in range(len(keys))]
        one = [held[0].column(0).slice(0, 1), pa.array([name]), pa.array([len(sizes)], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([sizes], pa.list_(pa.int64())), pa.array([X.lane_encode(data, N.LANES.index(name))], pa.binary())]
        return pa.RecordBatch.from_arrays(one + lists, schema.names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for batch in batches:
            who = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            first = [k for k in range(len(who)) if not k or who[k] != who[k - 1]]
            for a, b in zip(first, [*first[1:], len(who)]):
                if held and who[a] != of:
                    yield code(held)
                    held = []
                of = who[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield code(held)

    return spread(base, [group, "lane"], 8).sortWithinPartitions(group, "lane", *keys).mapInArrow(apply, schema)


def open_lanes(lanes: DataFrame, group: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(group, lane, place, bytes, keys...): the chunks of solid_lanes again, by their place in the lane and by their keys."""
    base = lanes.select(group, "lane", "sizes", "payload", *(f"{k}_keys" for k in keys))
    kinds = [base.schema[f"{k}_keys"].dataType.elementType for k in keys]
    schema = T.StructType([base.schema[group], T.StructField("lane", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("bytes", T.BinaryType()), *map(T.StructField, keys, kinds)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lane, payload = (batch.column(k)[i].as_py() for k in (1, 3))
                data = X.lane_decode(payload, N.LANES.index(lane))
                ends = np.r_[0, np.cumsum(batch.column(2)[i].values.to_numpy())].astype(np.int64)
                if ends[-1] != len(data):
                    raise X.Malformed("a lane of another size")
                n = len(ends) - 1
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], n), pa.repeat(pa.scalar(lane), n), pa.array(np.arange(n, dtype=np.int32)), N.rows_of(data, ends), *(batch.column(4 + k)[i].values for k in range(len(keys)))], schema.names)

    return base.mapInArrow(apply, schema)


def seal(payload: Column, key: Column, frame: Column, prefix: bytes, bound: Column) -> Column:
    """AES-GCM of a payload under a 16, 24 or 32-byte key. The nonce is the archive's random prefix of 4 bytes and the frame
    number, which must be unique under the key; bound, text that says what the payload is, is authenticated with it."""
    nonce = F.concat(F.lit(prefix), F.unhex(F.lpad(F.hex(frame.cast("bigint")), 16, "0")))
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, F.encode(bound, "utf-8"))


def unseal(sealed: Column, key: Column, bound: Column) -> Column:
    """The payload, or null where the seal is broken or belongs to something else."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), F.encode(bound, "utf-8"))


def derive_key(password: str, salt: bytes, log_n: int = 15) -> bytes:
    """A 32-byte key by scrypt, once on the driver."""
    import hashlib

    return hashlib.scrypt(password.encode(), salt=salt, n=1 << log_n, r=8, p=1, maxmem=256 << 20, dklen=32)


def fuzz(payloads: DataFrame, key: str, cases: int, seed: int = 0) -> DataFrame:
    """(mode, case_no, outcome, n): damaged payloads of (key, size, mode, payload) that their codecs accept or reject."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for who, size, mode, payload in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for case in range(cases):
                    try:
                        X.CODECS[mode].decode(X.mutate(payload, seed + zlib.crc32(str(who).encode()), case), size)
                        rows.append((mode, case, "accepted"))
                    except X.Malformed:
                        rows.append((mode, case, "rejected"))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string())], ["mode", "case_no", "outcome"])

    tried = payloads.select(key, "size", "mode", "payload").mapInArrow(apply, "mode string, case_no int, outcome string")
    return tried.groupBy("mode", "case_no", "outcome").agg(F.count("*").alias("n"))
