"""Registered queries against their SQL twins, streams against batches, sources, and the contract of the entry module."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.operators import chunks, routing, stats
from siltstone.plans import catalogue, checks  # noqa: F401
from siltstone.sources import entries as S
from siltstone.sources.shared import kept
from siltstone.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_twin(spark, duck, small, name):
    got = catalogue.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(repr(tuple(norm(r[c]) for c in columns)) for r in got.collect()) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_codec_trials_cover_documents(spark, small):
    ids = [r.doc_id for r in S.table(spark, small, "documents").select("doc_id").collect()]
    assert sorted(r.doc_id for r in catalogue.codec_trial_sizes(spark, small).collect()) == sorted(ids)
    assert catalogue.mutation_fuzz_summary(spark, small).agg(F.sum("n")).first()[0] == 16 * len(ids)


@pytest.mark.parametrize("work", [lambda d: routing.trial_sizes(d, ["doc_id"], "content"), lambda d: routing.encode_blocks(d, ["doc_id"], "content", "research")])
def test_heavy_work_leaves_few_row_groups(spark, small, work):
    """Documents of one row group are coded by all cores."""
    docs = work(S.documents(spark, small).coalesce(1)).withColumn("part", F.spark_partition_id())
    counts = [r["count"] for r in docs.groupBy("part").count().collect()]
    assert len(counts) > 16 and max(counts) < sum(counts) / 8


def test_entry(spark):
    assert entry.entry(spark).first().logical_count > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) == len(set(entry.queries()))


def test_stream_equals_batch(spark, small):
    as_rows = lambda df: sorted(map(tuple, df.select("doc_id", "seq", "off", "size", "digest").collect()))
    assert as_rows(catalogue.stream_cdc(spark, small)) == as_rows(catalogue.cdc_chunks(spark, small))


def test_whole_documents_need_no_state(spark, small, monkeypatch):
    """Documents that arrive whole are cut in Arrow batches on all cores, without a call or state for each."""
    kept = []
    monkeypatch.setattr(streams, "run_to_end", lambda stream: kept.append(stream) or stream)
    catalogue.stream_cdc(spark, small)
    plan = kept[0]._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "State" not in plan and "RepartitionByExpression" in plan


def parts_in_batches(spark, folder, rows, schema):
    """A stream whose files come one to a batch, in order."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("b"):
                os.rename(f"{folder}/{f}", f"{folder}/b{k:03d}-{f}")
                os.utime(f"{folder}/b{k:03d}-{f}", (k + 1e9, k + 1e9))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_chunks_across_batches(spark, small, tmp_path):
    texts = {r.doc_id: r.text.encode() for r in S.table(spark, small, "documents").orderBy("doc_id").limit(4).collect()}
    batches = [[(d, k, t[k * 700 : k * 700 + 700], (k + 1) * 700 >= len(t)) for d, t in texts.items() if k * 700 < len(t)] for k in range(max(map(len, texts.values())) // 700 + 1)]
    stream = parts_in_batches(spark, f"{tmp_path}/parts", [b for b in batches if b][:12], "doc_id bigint, part_no int, bytes binary, last boolean")
    got = {tuple(r) for r in streams.run_to_end(streams.chunk_parts(stream, "doc_id", 64, 128, 512)).collect()}
    whole = chunks.content_chunks(spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id bigint, content binary"), "doc_id", "content", 64, 128, 512)
    want = {tuple(r) for r in whole.select("doc_id", "seq", "off", "size", "digest").collect()}
    assert got <= want and {r for r in want if len(texts[r[0]]) <= 12 * 700} <= got


def test_nearby_and_order(spark, tmp_path):
    batches = [[("s", 0, "a"), ("s", 10, "b")], [("s", 20, "a"), ("s", 60, "b")], [("s", 70, "b"), ("t", 0, "a")]]
    stream = parts_in_batches(spark, f"{tmp_path}/blocks", batches, "s string, off bigint, digest string")
    assert {(r.s, r.off): r.source_off for r in streams.run_to_end(streams.nearby_sources(stream, "s", 30)).collect()} == {("s", 0): None, ("s", 10): None, ("s", 20): 0, ("s", 60): None, ("s", 70): 60, ("t", 0): None}
    frames = parts_in_batches(spark, f"{tmp_path}/frames", [[("x", 0), ("y", 1)], [("x", 1)], [("x", 3)]], "s string, i bigint")
    assert {tuple(r) for r in streams.run_to_end(streams.consecutive(frames, "s", "i")).collect()} == {("y", 1, 0), ("x", 3, 2)}
    assert streams.run_to_end(streams.distinct_content(parts_in_batches(spark, f"{tmp_path}/same", [[("a", 1)], [("a", 1), ("a", 2)]], "digest string, size int"))).count() == 2


def test_publish(spark, tmp_path):
    stream = lambda: parts_in_batches(spark, f"{tmp_path}/in", [[(1,)]], "v int")
    streams.publish_at_end(stream(), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    with pytest.raises(FileExistsError):
        streams.publish_at_end(stream(), f"file://{tmp_path}/out")


def test_tree(spark, tmp_path):
    for p in ("b.txt", "A/x.bin", "A/deep/y.bin", "a.txt"):
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_bytes(p.encode())
    tree = S.tree(spark, f"{tmp_path}/t")
    assert [r.path for r in S.in_tree_order(tree.drop("content")).collect()] == ["a.txt", "b.txt", "A/x.bin", "A/deep/y.bin"]
    before = kept(S.tree(spark, f"{tmp_path}/t", contents=False))
    (tmp_path / "t/b.txt").write_bytes(b"longer than before")
    (tmp_path / "t/a.txt").unlink()
    (tmp_path / "t/new").write_bytes(b"")
    assert {tuple(r) for r in S.changed(before, S.tree(spark, f"{tmp_path}/t", contents=False)).collect()} == {("b.txt", "changed"), ("a.txt", "missing"), ("new", "unexpected")}


def test_frames(spark, tmp_path):
    spark.dataSource.register(S.FrameSource)
    S.write_frames(f"{tmp_path}/one.frames", [b"a", b"", b"ccc"])
    want = [(0, b"a"), (1, b""), (2, b"ccc")]
    assert [(r.frame_index, bytes(r.payload)) for r in spark.read.format("frames").load(f"{tmp_path}/*.frames").orderBy("frame_index").collect()] == want
    files = spark.read.format("binaryFile").load(f"{tmp_path}/one.frames")
    assert [(r.frame_index, bytes(r.payload)) for r in S.read_frames(files).orderBy("frame_index").collect()] == want
    data = (tmp_path / "one.frames").read_bytes()
    damaged = bytearray(data)
    damaged[17] ^= 1
    for k, bad in enumerate((data[:-1], data + b"x", data[:4] + data[18:], data[:5], b"", bytes(damaged))):
        (tmp_path / f"bad{k}").write_bytes(bad)
        with pytest.raises(Exception, match="bad frame|cut|after its end|not what was written"):
            spark.read.format("frames").load(f"{tmp_path}/bad{k}").collect()
    rows = spark.createDataFrame([("s", 1, b"y"), ("s", 0, None), ("t", 0, b"z")], "s string, i int, p binary")
    made = S.frame_files(rows, "s", "i", "p", b"key")
    assert {(r.s, r.frame_index, bytes(r.payload)) for r in S.read_frames(made, "s", key=b"key").collect()} == {("s", 0, b""), ("s", 1, b"y"), ("t", 0, b"z")}
    with pytest.raises(Exception, match="not what was written"):
        S.read_frames(made, "s", key=b"other").collect()


def test_soak(spark):
    one, two = ({r.path: bytes(r.content) for r in S.soak(spark, seed, 6, 9000).collect()} for seed in (1, 1))
    assert one == two and all(len(c) == 9000 for c in one.values()) and len(set(one.values())) == 6
    assert S.tool_versions(spark).where("version is null").count() == 0


def test_generated(spark):
    one = {r.path: bytes(r.content) for r in S.generated(spark, 7, 2048).collect()}
    assert len(one) == 78 and one == {r.path: bytes(r.content) for r in S.generated(spark, 7, 2048).repartition(3).collect()}
    assert one["copies/000.bin"] == one["copies/005.bin"] and one["random/000.bin"] != one["random/001.bin"] and one["empty/000.bin"] == b""


def test_process_text(spark):
    line = "42 (a (odd) name) S 7 42 42 0 -1 4194304 1 0 0 0 2 3 0 0 20 0 1 0 999 1000 55 18446744073709551615"
    r = S.process_stats(spark.createDataFrame([(line,)], "l string"), "l").first()
    assert (r.pid, r.ppid, r.pgrp, r.start, r.rss_pages) == (42, 7, 42, 999, 55)


def test_partition_count_changes_nothing(spark, small):
    docs = S.documents(spark, small)
    few, many = (sorted(map(tuple, chunks.content_chunks(docs.repartition(n), "doc_id", "content", 64, 128, 512).collect())) for n in (1, 7))
    assert few == many


@pytest.mark.parametrize("partitions", [8, 32])
def test_cases_are_spread(spark, partitions):
    """Cases that were grouped by their key into as many partitions as they are spread over don't gather in one."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = spark.range(300).selectExpr("id % 100 AS k", "CAST(1 AS DOUBLE) AS a")
        cases = rows.groupBy("k").agg(F.collect_list("a").alias("candidate")).selectExpr("k", "CAST(k AS STRING) AS t", "candidate", "candidate AS comparator").withColumn("material", F.encode("t", "utf-8"))
        found = stats.bootstrap(cases, "k", 10).withColumn("part", F.spark_partition_id())
        assert found.select("part").distinct().count() > 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
