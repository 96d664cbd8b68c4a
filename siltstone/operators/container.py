"""Archives as folders of Parquet: entries, occurrences, and the unique chunks, coded and optionally sealed.

A footer holds the counts, the bytes and a digest of every table's rows; with a password its code is keyed, and every chunk is
bound to the archive, its frame number and its digest. Rows that are dropped, added, exchanged or changed are an error on
reading, before any entry is given out.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shared import kept
from . import chunks, manifests, routing

VERSION = 2
LEAST_LOG_N, MOST_LOG_N = 14, 20
#: Rows that are digested together; digests of such groups are digested again.
GROUP_ROWS = 4096
#: What a row of each table says, for its digest.
LINES = {"entries": ("path", "size", "digest"), "occurrences": ("path", "seq", "off", "size", "digest"), "chunks": ("frame", "digest", "size", "mode", "payload_size", "payload_digest")}
HEADER = "version int, archive string, salt binary, nonce binary, sealed boolean, log_n int, profile string"
FOOTER = "name string, rows bigint, bytes bigint, digest string"


def rows_digest(rows: DataFrame, fields: tuple[str, ...]) -> tuple[int, str]:
    """(count, digest) of the rows as a bag: the same for any order and partitioning, another if a row is dropped, added or
    changed. Rows are digested in groups of about GROUP_ROWS by hash, groups in rounds, so no list grows with the table."""
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in fields]
    level = rows.select(F.sha2(C.length_prefixed(*texts), 256).alias("x"))
    n = count = level.count()
    while True:
        groups = max(1, n // GROUP_ROWS)
        level = level.groupBy(F.pmod(F.xxhash64("x"), F.lit(groups)).alias("g")).agg(F.sha2(F.encode(F.array_join(F.array_sort(F.collect_list("x")), "\n"), "utf-8"), 256).alias("x")).select(F.sha2(F.encode(F.concat_ws(":", "g", "x"), "utf-8"), 256).alias("x"))
        if groups == 1:
            found = level.first()
            return count, found.x if count else hashlib.sha256(b"").hexdigest()
        n = groups


def _secret(key: bytes) -> Column:
    """The key as a column that a worker gives, so that no plan shows it."""

    @F.pandas_udf("binary")
    def give(frames: pd.Series) -> pd.Series:
        return pd.Series([key] * len(frames))

    return give(F.col("frame"))


def _code(footer: list[tuple], header: tuple, key: bytes | None) -> str:
    text = repr((sorted(footer), header)).encode()
    return hmac.new(key, b"footer" + text, hashlib.sha256).hexdigest() if key else hashlib.sha256(text).hexdigest()


def _bound(archive: str) -> Column:
    return F.concat_ws(":", F.lit(archive), "frame", "digest", "size", "mode")


def _footer(tables: dict[str, DataFrame]) -> list[tuple]:
    out = []
    for name, rows in sorted(tables.items()):
        n, digest = rows_digest(rows, LINES[name])
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint")).first()[0]
        out.append((name, n, total, digest))
    return out


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    coded = spark.read.parquet(f"{folder}/chunks").withColumn("payload_digest", F.sha2("payload", 256))
    return {"entries": spark.read.parquet(f"{folder}/entries"), "occurrences": spark.read.parquet(f"{folder}/occurrences"), "chunks": coded}


def check_options(log_n: int, profile: str, sizes: tuple[int, int, int]) -> None:
    """Errors for options out of their ranges."""
    if not LEAST_LOG_N <= log_n <= MOST_LOG_N:
        raise ValueError(f"log_n must be from {LEAST_LOG_N} to {MOST_LOG_N}")
    if profile not in routing.PROFILES:
        raise ValueError(f"profile must be one of {routing.PROFILES}")
    chunks.N.check_sizes(*sizes)


def write(
    entries: DataFrame, target: str, password: str | None = None, sizes: tuple[int, int, int] = (chunks.LEAST, chunks.AVERAGE, chunks.MOST), profile: str = "balanced", log_n: int = 15, each_unique: Callable[[DataFrame], None] | None = None
) -> None:
    """Write entries (path, content) to target, which must not exist; it appears in one rename when all is written and found
    whole.

    Paths must be portable and differ, also when their case is folded. With a password every chunk is AES-GCM under a key
    derived once from a random salt; the nonce is a random prefix of the archive and the frame number, unique in it.
    each_unique is called with the unique chunks (digest, size, bytes) before they are coded.
    """
    spark = entries.sparkSession
    check_options(log_n, profile, sizes)
    if manifests.path_violations(entries.select("path"), "path").limit(1).count() or entries.where("path is null").limit(1).count():
        raise ValueError("paths must be portable and differ, in any case")
    folder = f"{target.rstrip('/')}.part-{uuid.uuid4().hex}"
    content = F.coalesce(F.col("content"), F.lit(b""))
    listed = entries.select("path", F.octet_length(content).cast("bigint").alias("size"), C.digest(content).alias("digest"))
    pieces = kept(chunks.content_chunks(entries.select("path", content.alias("content")), "path", "content", *sizes, payload=True))
    unique = pieces.groupBy("digest", "size").agg(F.min("bytes").alias("bytes"))
    if each_unique:
        each_unique(unique)
    # frames are numbered before anything is coded, so that sorting them moves no payload and codes none twice
    keys = pieces.select("digest", "size").distinct().withColumn("one", F.lit(1))
    frames = chunks.prefix_sum(keys, [F.col("digest")], "one", "frame").drop("one")
    numbered = routing.encode_blocks(unique.join(frames, ["digest", "size"]), ["digest", "frame"], "bytes", profile)
    archive, salt, nonce = uuid.uuid4().hex, os.urandom(16), os.urandom(4)
    key = routing.derive_key(password, salt, log_n) if password else None
    if key:
        numbered = numbered.withColumn("payload", routing.seal(F.col("payload"), _secret(key), F.col("frame"), nonce, _bound(archive)))
    listed.write.parquet(f"{folder}/entries")
    pieces.drop("bytes").write.parquet(f"{folder}/occurrences")
    numbered.write.parquet(f"{folder}/chunks")
    tables = _tables(spark, folder)
    counted = tables["chunks"].agg(F.count("*"), F.count_distinct("frame"), F.coalesce(F.max("frame") + 1, F.lit(0))).first()
    wanted = pieces.select("digest", "size").distinct().count()
    if {wanted} != set(counted):
        raise RuntimeError(f"{counted[0]} of {wanted} chunks were written")
    header = (VERSION, archive, salt, nonce, bool(password), log_n, profile)
    footer = _footer(tables)
    spark.createDataFrame([(*header[:2], bytearray(salt), bytearray(nonce), *header[4:])], HEADER).coalesce(1).write.parquet(f"{folder}/header")
    spark.createDataFrame([*footer, ("code", 0, 0, _code(footer, header, key))], FOOTER).coalesce(1).write.parquet(f"{folder}/footer")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(target)) or not files.rename(path(folder), path(target)):
        files.delete(path(folder), True)
        raise FileExistsError(target)


def header_violations(headers: DataFrame) -> DataFrame:
    """(rule, entity, detail): fields of archive headers (HEADER) that no writer gives; null fields too."""
    return manifests.rule_violations(
        headers, F.col("archive"),
        {
            "version": F.col("version") == VERSION, "archive": F.col("archive").rlike("^[0-9a-f]{32}$"), "salt": F.octet_length("salt") == 16, "nonce": F.octet_length("nonce") == 4,
            "sealed": F.col("sealed").isNotNull(), "log_n": F.col("log_n").between(LEAST_LOG_N, MOST_LOG_N), "profile": F.col("profile").isin(*routing.PROFILES),
        },
    )


def verify(spark: SparkSession, source: str, password: str | None = None) -> bytes | None:
    """The archive's key, None without a password, once its header is valid and every table is what the footer says."""
    heads = spark.read.schema(HEADER).parquet(f"{source}/header")
    wrong = header_violations(heads).collect()
    rows = heads.limit(2).collect()
    if wrong or len(rows) != 1:
        raise ValueError(f"a bad header: {', '.join(sorted(r.rule for r in wrong)) or len(rows)}")
    head = rows[0]
    if head.sealed and not password:
        raise ValueError("the archive is sealed")
    key = routing.derive_key(password, bytes(head.salt), head.log_n) if head.sealed else None
    said = {r.name: tuple(r) for r in spark.read.schema(FOOTER).parquet(f"{source}/footer").limit(9).collect()}
    code = said.pop("code", (0, 0, 0, ""))[3]
    header = (head.version, head.archive, bytes(head.salt), bytes(head.nonce), head.sealed, head.log_n, head.profile)
    if not hmac.compare_digest(code, _code(list(said.values()), header, key)):
        raise ValueError("a wrong password or a damaged footer")
    found = {row[0]: row for row in _footer(_tables(spark, source))}
    for name, row in found.items():
        if said.get(name) != row:
            raise ValueError(f"{name} are not what was written")
    return key


def _chunks(spark: SparkSession, source: str, key: bytes | None) -> DataFrame:
    rows = spark.read.parquet(f"{source}/chunks")
    if key:
        head = spark.read.parquet(f"{source}/header").first()
        opened = routing.unseal(F.col("payload"), _secret(key), _bound(head.archive))
        rows = rows.withColumn("payload", F.coalesce(opened, F.raise_error(F.lit("a damaged chunk")).cast("binary")))
    return rows


def read(spark: SparkSession, source: str, password: str | None = None) -> DataFrame:
    """(path, content, intact): every entry again, and whether its size and digest are those that were written."""
    coded = _chunks(spark, source, verify(spark, source, password))
    plain = routing.decode_blocks(coded, ["digest"]).select("digest", F.octet_length("content").alias("size"), F.col("content").alias("bytes"))
    back = chunks.restore(spark.read.parquet(f"{source}/occurrences"), plain, "path")
    joined = spark.read.parquet(f"{source}/entries").join(back, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    return joined.select("path", "content", ((F.octet_length("content") == F.col("size")) & (C.digest(F.col("content")) == F.col("digest"))).alias("intact"))


def inspect(spark: SparkSession, source: str, password: str | None = None) -> DataFrame:
    """One row, after all content has been decoded and checked: entries, bytes, chunks, what deduplication and codecs saved."""
    entries = read(spark, source, password).agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("bigint").alias("original_bytes"), F.count_if(~F.col("intact")).alias("damaged"))
    occ = spark.read.parquet(f"{source}/occurrences").agg(F.count("*").alias("logical_chunks"))
    coded = spark.read.parquet(f"{source}/chunks").agg(F.count("*").alias("unique_chunks"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("unique_bytes"), F.coalesce(F.sum("payload_size"), F.lit(0)).cast("bigint").alias("payload_bytes"))
    return entries.crossJoin(occ).crossJoin(coded).withColumn("ratio", C.ratio(F.col("payload_bytes"), F.col("original_bytes")))


def mode_distribution(spark: SparkSession, source: str) -> DataFrame:
    """(mode, n, payload_bytes) of an archive's chunks."""
    return spark.read.parquet(f"{source}/chunks").groupBy("mode").agg(F.count("*").alias("n"), F.sum("payload_size").cast("bigint").alias("payload_bytes"))
