"""Rules by which inputs, hosts, blocks, statistics and measurements are accepted, and tables made of what is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .manifests import difference, rule_violations

#: Patterns of typed text fields.
TYPES = {
    "sha256": "^[0-9a-f]{64}$",
    "commit": "^[0-9a-f]{40}$",
    "tag": "^v?[0-9]+([.][0-9]+){0,3}(-[0-9A-Za-z.]+)?$",
    "dns_label": "^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$",
    "spdx": "^[A-Za-z0-9][A-Za-z0-9.+-]*( (AND|OR|WITH) [A-Za-z0-9][A-Za-z0-9.+-]*)*$",
    "stable_id": "^[a-z][a-z0-9]*(-[a-z0-9]+)*$",
    "snapshot_id": "^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{6}Z)?$",
    "url": "^https?://[a-z0-9]([a-z0-9-]*[a-z0-9])?([.][a-z0-9]([a-z0-9-]*[a-z0-9])?)+(/[^?# ]*)?$",
}
#: What one product of versions may read and write: (format, version, reads, writes).
FORMATS = [("archive", 1, False, False), ("archive", 2, True, True), ("frames", 1, True, True)]


def typed(value: Column, kind: str) -> Column:
    """Whether a text field is of a kind of TYPES; null gives null."""
    return value.rlike(TYPES[kind])


def compatibility(spark) -> DataFrame:
    """(format, version, reads, writes) of every format there has been."""
    return spark.createDataFrame(FORMATS, "format string, version int, reads boolean, writes boolean")


def qualified(hosts: DataFrame, needs: list[str], least_cpus: int, system: str | None = None, machine: str | None = None) -> DataFrame:
    """hosts (host, controllers, cpus, ...) with lacking, the needed controllers that they don't have in alphabetical order, and
    qualified: nothing lacks, there are CPUs enough, and system and machine, where asked for, are those. Nulls don't qualify."""
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, needs)), F.coalesce("controllers", F.array().cast("array<string>"))))
    fine = (F.size(lacking) == 0) & (F.col("cpus") >= least_cpus)
    for name, want in (("system", system), ("machine", machine)):
        fine = fine & (F.col(name) == want) if want else fine
    return hosts.withColumn("lacking", lacking).withColumn("qualified", F.coalesce(fine, F.lit(False)))


def lock_violations(files: DataFrame, most_bytes: int = 64 << 30) -> DataFrame:
    """(rule, entity, detail) of locked files (path, bytes, digest, prepared): a path with several contents, a prepared path or
    a digest that several paths have, and more than most_bytes over distinct paths."""
    distinct = files.select("path", "bytes", "digest", "prepared").distinct()
    one = lambda name, key, what: distinct.groupBy(key).agg(F.count_distinct(F.struct(*what)).alias("n")).where("n > 1").select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("entity"), F.col("n").cast("string").alias("detail"))
    total = distinct.groupBy("path").agg(F.max("bytes").alias("b")).agg(F.sum("b").cast("bigint").alias("t")).where(F.col("t") > most_bytes)
    return one("identity", "path", ["bytes", "digest"]).unionAll(one("prepared", "prepared", ["path"])).unionAll(one("digest", "digest", ["path"])).unionAll(total.select(F.lit("total"), F.lit("all"), F.col("t").cast("string")))


def verified(declared: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(differences, sums): (path, status) of declared (path, bytes, digest) against files (path, content), each declared path
    once, and one row of how many files and bytes are as declared."""
    once = declared.dropDuplicates(["path", "bytes", "digest"]).select("path", F.struct(F.col("bytes").cast("bigint").alias("bytes"), "digest").alias("mark"))
    found = files.select("path", F.struct(F.octet_length("content").cast("bigint").alias("bytes"), C.digest(F.col("content")).alias("digest")).alias("mark"))
    same = once.join(found, ["path", "mark"], "left_semi").agg(F.count("*").alias("files"), F.coalesce(F.sum("mark.bytes"), F.lit(0)).cast("bigint").alias("bytes"))
    return difference(once, found, ["path"], "mark"), same


def block_violations(blocks: DataFrame, entries: DataFrame, key: str, most: int) -> DataFrame:
    """(rule, entity, detail) of inner blocks (key, block_no, size) of entries (key, original_size): sizes from 1 to most, only
    the last below most, numbers from 0 without gaps, and sums that are the original size."""
    last = blocks.groupBy(key).agg(F.max("block_no").alias("_last"), F.count("*").alias("_n"), F.count_distinct("block_no").alias("_kinds"), F.min("block_no").alias("_low"), F.sum("size").alias("_sum"))
    sized = blocks.join(last.select(key, "_last"), key)
    rows = rule_violations(sized, F.concat_ws(":", key, "block_no"), {"size": F.col("size").between(1, most), "full": (F.col("size") == most) | (F.col("block_no") == F.col("_last"))})
    whole = entries.join(last, key, "left").withColumn("_sum", F.coalesce("_sum", F.lit(0)))
    sums = rule_violations(whole, F.col(key), {"sum": F.col("_sum") == F.col("original_size"), "numbers": F.col("_n").isNull() | ((F.col("_low") == 0) & (F.col("_last") == F.col("_n") - 1) & (F.col("_kinds") == F.col("_n")))})
    return rows.unionAll(sums)


def statistic_violations(rows: DataFrame, entity: str, classes: list[str], total: str, part: str, whole: str, ratio: str) -> DataFrame:
    """(rule, entity, detail) of statistics: counts that are null or below 0, classes that don't add up to total, a ratio that
    isn't part / whole within 1e-12."""
    counts = {f"count:{c}": F.col(c) >= 0 for c in (*classes, total, part, whole)}
    added = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return rule_violations(rows, F.col(entity), counts | {"classes": added == F.col(total), "ratio": F.abs(C.ratio(F.col(part), F.col(whole)) - F.col(ratio)) <= 1e-12})


def accepted(measurements: DataFrame) -> DataFrame:
    """measurements (exited, status, timed_out, restored, expected) with accepted and reason, the first of: running, timed out,
    failed, differs. Nulls aren't accepted."""
    reason = (
        F.when(~F.coalesce("exited", F.lit(False)), "running").when(F.coalesce("timed_out", F.lit(True)), "timed out").when(F.coalesce(F.col("status") != 0, F.lit(True)), "failed")
        .when(F.coalesce(F.col("restored") != F.col("expected"), F.lit(True)), "differs")
    )
    return measurements.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def resolved(records: DataFrame, stream: str, off: str, distance: str, content: str) -> DataFrame:
    """records with source, the content of the record that lies distance before in its stream; null where distance is null or
    no record begins there."""
    at = records.select(F.col(stream).alias("_s"), F.col(off).alias("_o"), F.col(content).alias("source"))
    return records.join(at, (F.col(stream) == F.col("_s")) & (F.col(off) - F.col(distance) == F.col("_o")), "left").drop("_s", "_o")


def middle(values: Column) -> Column:
    """The middle of an odd number of values, as they are; null for an even number, and where one is null."""
    fine = (F.size(values) % 2 == 1) & ~F.exists(values, lambda v: v.isNull())
    return F.when(fine, F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")))


def run_order(runs: DataFrame, run: str, name: str) -> DataFrame:
    """(run, name) rows with place, from 0: by name in even runs, in the reverse of it in odd ones."""
    up = F.row_number().over(Window.partitionBy(run).orderBy(name)) - 1
    return runs.withColumn("place", F.when(F.col(run) % 2 == 0, up).otherwise(F.count("*").over(Window.partitionBy(run)) - 1 - up).cast("int"))


def comparators(raw: DataFrame, encrypted: DataFrame) -> DataFrame:
    """Both kinds of comparator rows as one table, with kind; columns are matched by name, missing ones are null."""
    return raw.withColumn("kind", F.lit("raw")).unionByName(encrypted.withColumn("kind", F.lit("encrypted")), allowMissingColumns=True)


def benchmark_rows(timed: DataFrame, memory: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a benchmark: timed runs (by..., original_size, archive_size, encode_seconds, decode_seconds, original_digest,
    restored_digest) with the peak of their separate memory runs (by..., peak_bytes), ratio, rates in MiB/s, and verified. A tool
    without a memory run has a null peak; one that gave no archive has null results and isn't verified."""
    peaks = memory.groupBy(*by).agg(F.max("peak_bytes").alias("peak_bytes"))
    none = F.col("archive_size").isNull()
    rate = lambda s: F.when(~none, C.mib_per_second(F.col("original_size"), F.col(s)))
    return timed.join(peaks, by, "left").select(
        *by, "original_size", "archive_size", F.when(~none, C.ratio(F.col("archive_size"), F.col("original_size"))).alias("ratio"), rate("encode_seconds").alias("encode_mib_s"), rate("decode_seconds").alias("decode_mib_s"), "peak_bytes",
        (~none & F.coalesce(F.col("original_digest") == F.col("restored_digest"), F.lit(False))).alias("verified"),
    )


def in_reverse_depth(entries: DataFrame, path: str = "path") -> DataFrame:
    """entries sorted so that what is inside a directory comes before it: deepest first, then by path."""
    return entries.orderBy(F.desc(F.size(F.split(path, "/"))), path)
