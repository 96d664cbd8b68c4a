"""spark-submit siltstone/__main__.py or python -m siltstone: archives of file trees, comparisons with common formats, checks."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.operators import acceptance, container, foreign, reports, stats
from siltstone.sources import entries
from siltstone.sources.shared import kept, new_folder, remove

VERBS = ("encode", "decode", "inspect", "verify", "benchmark", "sniff", "compatibility", "readiness")


def compared(spark: SparkSession, files: DataFrame, password: str | None, profile: str, runs: int) -> DataFrame:
    """(tool, run, original_size, archive_size, ratio, encode_mib_s, decode_mib_s, peak_bytes, verified) of the engine's own
    archive and of every common format over files (path, content), each run timed. Common formats take archives of a top
    folder each."""
    files = kept(files)
    rows = []
    own = files.select("path", C.digest(F.coalesce("content", F.lit(b""))).alias("digest"))
    same = lambda back: own.join(back.select("path", C.digest(F.col("content")).alias("digest")), ["path", "digest"], "left_anti").limit(1).count() == 0
    size = files.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    for run in range(runs):
        for tool in ["archive", *foreign.FORMATS]:
            target, grouped = new_folder(spark, "compared"), files.withColumn("part", F.split_part("path", F.lit("/"), F.lit(1)))
            began = time.perf_counter()
            if tool == "archive":
                container.write(files, target, password, profile=profile)
                archived = container.mode_distribution(spark, target).agg(F.sum("payload_bytes")).first()[0] or 0
            else:
                foreign.pack(grouped, "part", tool).write.parquet(target)
                archived = spark.read.parquet(target).agg(F.sum("archive_size")).first()[0] or 0
            between = time.perf_counter()
            back = container.read(spark, target, password) if tool == "archive" else foreign.unpack(spark.read.parquet(target), "part", tool)
            fine = same(back)
            rows.append((tool, run, size, archived, between - began, time.perf_counter() - between, "same", "same" if fine else "other"))
            remove(spark, target)
    timed = spark.createDataFrame(rows, "tool string, run int, original_size bigint, archive_size bigint, encode_seconds double, decode_seconds double, original_digest string, restored_digest string")
    return acceptance.benchmark_rows(timed, spark.createDataFrame([], "tool string, run int, peak_bytes bigint"), ["tool", "run"])


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone")
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("source", nargs="?")
    parser.add_argument("target", nargs="?")
    parser.add_argument("--profile", choices=["fast", "balanced", "research"], default="balanced")
    parser.add_argument("--runs", type=int, default=1)
    options = parser.parse_args(arguments)
    password = os.environ.get("SILTSTONE_PASSWORD") or None
    if options.verb != "compatibility" and not options.source:
        parser.error(f"{options.verb} needs a source")
    if options.verb in ("encode", "decode") and not options.target:
        parser.error(f"{options.verb} needs a target")
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    if options.verb == "inspect":
        print(reports.as_json(container.inspect(spark, options.source, password)).first().json)
    elif options.verb == "verify":
        damaged = container.inspect(spark, options.source, password).first().damaged
        print("damaged" if damaged else "intact")
        return int(damaged > 0)
    elif options.verb == "encode":
        container.write(entries.tree(spark, options.source).select("path", "content"), options.target, password, profile=options.profile)
    elif options.verb == "decode":
        container.read(spark, options.source, password).write.parquet(options.target)
    elif options.verb == "sniff":
        kinds = entries.tree(spark, options.source).groupBy(C.sniff(F.col("content")).alias("kind")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
        print(reports.as_markdown(kinds, ["kind"]))
    elif options.verb == "benchmark":
        print(reports.as_markdown(compared(spark, entries.tree(spark, options.source).select("path", "content"), password, options.profile, options.runs), ["run", "tool"]))
    elif options.verb == "compatibility":
        print(reports.as_markdown(acceptance.compatibility(spark), ["format", "version"]))
    else:  # readiness: a JSON file of {"gate": ..., "done": ...} a line
        gates = spark.read.schema("gate string, done boolean").option("mode", "FAILFAST").json(options.source)
        row = stats.readiness(gates).first()
        print(f"{row.completed} of {row.total}, {row.percent} %")
        return int(row.completed < row.total)
    return 0


if __name__ == "__main__":
    sys.exit(main())
