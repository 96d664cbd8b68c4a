"""Where entries come from: the standard tables, file trees, framed files, process text and generated corpora."""

from __future__ import annotations

import hashlib
import hmac
import json
import random
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..operators.manifests import difference, json_keys

CATEGORIES = ("sparse", "random", "text", "tiny", "ramp", "empty", "records", "code", "deflated", "alphabets", "copies", "gradient", "table")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with content, the text's UTF-8 bytes, and size."""
    return _content(table(spark, sf_dir, "documents"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(table(spark, sf_dir, "pages"), "html")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(table(spark, sf_dir, "conversations"), "text")


def _content(rows: DataFrame, column: str) -> DataFrame:
    content = C.utf8(F.coalesce(F.col(column), F.lit("")))
    return rows.withColumn("content", content).withColumn("size", F.octet_length(content).cast("bigint"))


def tree(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """(path, depth, size, modified, content): the files below root, paths relative to it; only content is read lazily.

    Scans leave out files without bytes, so those come from the file listing that the driver holds anyway; their modified
    is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].rstrip("/")
    path = F.regexp_replace(F.col("path"), f"^.*?{_quoted(base)}/", "")
    found = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    listed = [(unquote(p).split(f"{base}/", 1)[1],) for p in files.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(found.select("path"), "path", "left_anti")
    every = found.unionAll(empty.select("path", F.lit(0).cast("bigint"), F.lit(None).cast("timestamp"), F.lit(b"")))
    out = every.select("path", F.size(F.split("path", "/")).alias("depth"), "size", "modified", "content")
    return out if contents else out.drop("content")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "/" else c for c in text)


def in_tree_order(entries: DataFrame, is_dir: Column | None = None) -> DataFrame:
    """entries sorted by depth, folded path, directories first, path."""
    path = F.col("path")
    return entries.orderBy(F.size(F.split(path, "/")), F.lower(path), F.desc(is_dir if is_dir is not None else F.lit(False)), path)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of files that differ in size or time between two scans of a tree."""
    mark = F.struct("size", "modified")
    return difference(before.withColumn("_m", mark), after.withColumn("_m", mark), ["path"], "_m")


def strict_json(rows: DataFrame, column: str, schema: StructType | str, expected: list[str]) -> DataFrame:
    """rows with parsed: an error unless every object has exactly the expected keys, once each, and the schema's types."""
    checked = json_keys(rows, column, expected)
    fine = F.assert_true(F.coalesce(F.col("keys_ok"), F.lit(False)), "an object with other keys")
    parsed = F.from_json(column, schema, {"mode": "FAILFAST"})
    return checked.withColumn("parsed", F.when(fine.isNull(), parsed)).drop("keys_ok")


def json_depth(text: Column) -> Column:
    """How deep the brackets of a JSON text nest, those in strings left out."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\\\.", ""), '"[^"]*"', "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), zero, step, lambda a: a["most"])


def process_stats(rows: DataFrame, column: str) -> DataFrame:
    """rows with pid, ppid, pgrp, start and rss_pages of a /proc stat line; the name may hold blanks and parentheses."""
    rest = F.split(F.regexp_extract(column, r"^\d+ \(.*\) (.*)$", 1), " ")
    return rows.select("*", F.regexp_extract(column, r"^(\d+)", 1).cast("int").alias("pid"), *(F.get(rest, F.lit(k)).cast("bigint").alias(n) for n, k in (("ppid", 1), ("pgrp", 2), ("start", 19), ("rss_pages", 21))))


def generated(spark: SparkSession, seed: int, unit: int, files: int = 6) -> DataFrame:
    """(category, path, content): a seeded corpus of the thirteen categories, the same for any partitioning."""
    names = list(CATEGORIES)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                category, number = names[k // files], k % files
                rows.append((category, f"{category}/{number:03d}.bin", _bytes(category, random.Random(f"{seed}/{category}/{0 if category == 'copies' else number}"), unit)))
            c = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.binary())], ["category", "path", "content"])

    return spark.range(len(names) * files).mapInArrow(make, "category string, path string, content binary")


def _bytes(category: str, rng: random.Random, unit: int) -> bytes:
    import zlib

    words = ["alpha", "beta", "gamma", "delta", "stone", "river", "cloud", "field"]
    if category == "empty":
        return b""
    if category in ("copies", "random"):
        return rng.randbytes(unit)
    if category == "deflated":
        return zlib.compress(rng.randbytes(unit), 9)
    if category == "ramp":
        return b"".join(struct.pack("<i", 3 * k) for k in range(unit // 4))
    if category == "gradient":
        return bytes((x + y) // 2 % 256 for y in range(max(1, unit // 256)) for x in range(256))
    if category == "sparse":
        out = bytearray(unit)
        for _ in range(unit // 512):
            out[rng.randrange(unit)] = rng.randrange(1, 256)
        return bytes(out)
    if category == "tiny":
        return f"{rng.randrange(10**6)},{rng.choice(words)}\n".encode()
    line = {
        "code": lambda: f"def {rng.choice(words)}_{rng.randrange(99)}(x):\n    return x + {rng.randrange(9)}\n",
        "records": lambda: json.dumps({"id": rng.randrange(10**6), "name": rng.choice(words), "ok": rng.random() < 0.5}) + "\n",
        "table": lambda: f"{rng.randrange(10**6)},{rng.choice(words)},{rng.random():.3f}\n",
        "text": lambda: " ".join(rng.choice(words) for _ in range(12)) + ".\n",
        "alphabets": lambda: "".join(rng.choice("äöüßéèçñλπ日本語 ") for _ in range(40)) + "\n",
    }[category]
    out, size = [], 0
    while size < unit:
        out.append(line().encode())
        size += len(out[-1])
    return b"".join(out)[:unit]


FRAME = struct.Struct(">QBI")
FRAME_MAGIC = b"SLT0"


def frame_bytes(payloads: list[bytes], key: bytes | None = None) -> bytes:
    """A framed file: a magic, then index, kind 0 and length before each payload, and a last frame of kind 1 whose payload is the
    SHA-256 of all before it, keyed where there is a key."""
    out = FRAME_MAGIC + b"".join(FRAME.pack(k, 0, len(p)) + p for k, p in enumerate(payloads))
    return out + FRAME.pack(len(payloads), 1, 32) + _seal_of(out, key)


def _seal_of(data: bytes, key: bytes | None) -> bytes:
    return hmac.new(key, data, hashlib.sha256).digest() if key else hashlib.sha256(data).digest()


def write_frames(path: str, payloads: list[bytes], key: bytes | None = None) -> None:
    """One framed file on this machine."""
    with open(path, "wb") as f:
        f.write(frame_bytes(payloads, key))


def frame_files(rows: DataFrame, stream: str, order: str, payload: str, key: bytes | None = None) -> DataFrame:
    """(stream, content): each stream's payloads in order as a framed file. A stream is one value; give streams of bounded size."""
    kind = rows.schema[stream].dataType.simpleString()

    def make(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        return pd.DataFrame({stream: [pdf[stream].iloc[0]], "content": [frame_bytes([bytes(p) if p is not None else b"" for p in pdf[payload]], key)]})

    return rows.select(stream, order, payload).groupBy(stream).applyInPandas(make, f"{stream} {kind}, content binary")


def parse_frames(name: str, data: bytes, most: int = 64 << 20, key: bytes | None = None) -> list[bytes]:
    """The payloads of a framed file; another magic, broken order, a long frame, a cut, bytes after the end and a digest that
    differs are errors."""
    if data[:4] != FRAME_MAGIC:
        raise ValueError(f"{name}: bad frame, no magic")
    out, at = [], 4
    while True:
        if at + FRAME.size > len(data):
            raise ValueError(f"{name}: cut before its end")
        index, kind, length = FRAME.unpack_from(data, at)
        if index != len(out) or kind > 1 or length > most or (kind == 1 and length != 32):
            raise ValueError(f"{name}: bad frame {len(out)}")
        payload = data[at + FRAME.size : at + FRAME.size + length]
        if len(payload) < length:
            raise ValueError(f"{name}: cut in frame {len(out)}")
        if kind == 1:
            if at + FRAME.size + 32 != len(data):
                raise ValueError(f"{name}: bytes after its end")
            if not hmac.compare_digest(payload, _seal_of(data[:at], key)):
                raise ValueError(f"{name}: not what was written")
            return out
        out.append(payload)
        at += FRAME.size + length


def read_frames(files: DataFrame, name: str = "path", content: str = "content", most: int = 64 << 20, key: bytes | None = None) -> DataFrame:
    """(name, frame_index, payload) of the framed files in a column, such as binaryFile gives of any file system."""
    kind = files.schema[name].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, data in zip(batch.column(0), batch.column(1).to_pylist()):
                payloads = parse_frames(str(who.as_py()), bytes(data or b""), most, key)
                yield pa.RecordBatch.from_arrays([pa.array([who.as_py()] * len(payloads), who.type), pa.array(range(len(payloads)), pa.int64()), pa.array(payloads, pa.binary())], [name, "frame_index", "payload"])

    return files.select(name, content).mapInArrow(parse, f"{name} {kind}, frame_index bigint, payload binary")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        import glob

        self.files, self.most = sorted(glob.glob(options["path"])), int(options.get("maxframe", 64 << 20))
        self.key = bytes.fromhex(options["key"]) if "key" in options else None

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for index, payload in enumerate(parse_frames(partition.path, f.read(), self.most, self.key)):
                yield partition.path, index, payload


class FrameSource(DataSource):
    """format("frames"): (path, frame_index, payload) of framed files that every executor sees under the same path, one task per
    file; read_frames() reads them from any file system."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "path string, frame_index bigint, payload binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FrameReader(self.options)


def soak(spark: SparkSession, seed: int, files: int, size: int) -> DataFrame:
    """(path, content): files of so many bytes for long runs, each from the seed and its number alone: half of them noise, half a
    repeated block, so that codecs and deduplication both have work."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rng = random.Random(f"{seed}/{k}")
                data = rng.randbytes(size) if k % 2 == 0 else (rng.randbytes(min(size, 4096)) * (size // 4096 + 1))[:size]
                yield pa.RecordBatch.from_arrays([pa.array([f"soak/{k:08d}.bin"]), pa.array([data], pa.binary())], ["path", "content"])

    return spark.range(files).mapInArrow(make, "path string, content binary")


def tool_versions(spark: SparkSession) -> DataFrame:
    """(tool, version) of what archives are made and compared with here."""
    import platform
    import zlib

    import pyspark
    import zstandard

    rows = [("python", platform.python_version()), ("spark", pyspark.__version__), ("arrow", pa.__version__), ("zlib", zlib.ZLIB_RUNTIME_VERSION), ("zstd", ".".join(map(str, zstandard.ZSTD_VERSION)))]
    return spark.createDataFrame(rows, "tool string, version string")
