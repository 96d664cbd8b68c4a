"""Archives written, inspected and read again; reports and host facts."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from siltstone.operators import container, manifests, reports, routing


@pytest.mark.parametrize("password", [None, "a long secret"])
def test_archive(spark, tmp_path, password):
    noise = random.Random(1).randbytes(20_000)
    data = [("a.bin", noise), ("d/b.bin", b"x" * 370 + noise), ("empty", b""), ("null", None), ("text", b"the same words " * 900)]
    entries = spark.createDataFrame(data, "path string, content binary")
    target = f"{tmp_path}/archive"
    container.write(entries, target, password, (256, 1024, 4096), log_n=14)
    assert {r.path: (bytes(r.content), r.intact) for r in container.read(spark, target, password).collect()} == {p: (c or b"", True) for p, c in data}
    info = container.inspect(spark, target, password).first()
    assert info.damaged == 0 and info.entries == 5 and info.original_bytes - info.unique_bytes > 0.8 * 20_000 and info.logical_chunks > info.unique_chunks
    assert sum(r.n for r in container.mode_distribution(spark, target).collect()) == info.unique_chunks
    with pytest.raises(FileExistsError):
        container.write(entries, target)
    with pytest.raises(ValueError, match="portable"):
        container.write(spark.createDataFrame([("../up", b"x")], "path string, content binary"), f"{tmp_path}/no")
    if password:
        with pytest.raises(ValueError, match="sealed"):
            container.read(spark, target)
        with pytest.raises(ValueError, match="wrong password"):
            container.read(spark, target, "another")


@pytest.mark.parametrize("password", [None, "a long secret"])
def test_archive_as_a_whole(spark, tmp_path, password):
    """A row dropped, doubled, exchanged or changed in any table, and a changed header, are noticed before anything is read."""
    noise = random.Random(2).randbytes(30_000)
    seen = []
    container.write(spark.createDataFrame([("a", noise), ("b", noise[:9000]), ("c", b"")], "path string, content binary"), f"{tmp_path}/whole", password, (256, 1024, 4096), log_n=14, each_unique=lambda u: seen.append(u.count()))
    assert seen == [spark.read.parquet(f"{tmp_path}/whole/chunks").count()]
    swap = F.when(F.col("frame") == 0, 1).when(F.col("frame") == 1, 0).otherwise(F.col("frame"))
    damage = {
        "dropped": ("chunks", lambda t: t.where("frame > 0")), "exchanged": ("chunks", lambda t: t.withColumn("frame", swap.cast("bigint"))), "changed": ("chunks", lambda t: t.withColumn("payload", F.when(F.col("frame") == 2, F.concat("payload", F.lit(b"x"))).otherwise(F.col("payload")))),
        "doubled": ("occurrences", lambda t: t.unionAll(t.limit(1))), "entry": ("entries", lambda t: t.where("path <> 'c'")), "footer": ("footer", lambda t: t.withColumn("rows", F.when(F.col("name") == "chunks", F.col("rows") - 1).otherwise(F.col("rows")))), "header": ("header", lambda t: t.withColumn("profile", F.lit("fast"))), "version": ("header", lambda t: t.withColumn("version", F.lit(9))),
    }
    for name, (table, change) in damage.items():
        shutil.copytree(f"{tmp_path}/whole", f"{tmp_path}/{name}")
        rows = change(spark.read.parquet(f"{tmp_path}/whole/{table}"))
        shutil.rmtree(f"{tmp_path}/{name}/{table}")
        rows.write.parquet(f"{tmp_path}/{name}/{table}")
        with pytest.raises(ValueError, match="not what was written|damaged footer|bad header"):
            container.read(spark, f"{tmp_path}/{name}", password)
    assert container.read(spark, f"{tmp_path}/whole", password).where("intact").count() == 3


def test_large_archive(spark, tmp_path):
    """As many chunks as entries, over many partitions: every one is stored and read again."""
    entries = spark.range(60_000).select(F.concat(F.lit("d/"), "id").alias("path"), F.encode(F.sha2(F.col("id").cast("string"), 512), "utf-8").alias("content"))
    container.write(entries, f"{tmp_path}/many", None, (256, 1024, 4096), "fast")
    assert spark.read.parquet(f"{tmp_path}/many/chunks").count() == 60_000
    assert container.read(spark, f"{tmp_path}/many").where("intact").count() == 60_000


def test_chunks_are_coded_once(spark, tmp_path, monkeypatch):
    """Numbering the frames doesn't code the chunks for the sampling of their order."""
    coded, log = routing.encode_blocks, tmp_path / "rows"

    def logged(blocks, *args):
        def tell(batches):
            for batch in batches:
                with open(log, "a") as f:
                    f.write("x" * batch.num_rows)
                yield batch

        return coded(blocks, *args).mapInArrow(tell, coded(blocks, *args).schema)

    monkeypatch.setattr(container.routing, "encode_blocks", logged)
    entries = spark.range(500).select(F.concat(F.lit("d/"), "id").alias("path"), F.encode(F.sha2(F.col("id").cast("string"), 512), "utf-8").alias("content"))
    container.write(entries, f"{tmp_path}/once", "a long secret", (256, 1024, 4096), "fast", 14)
    assert log.stat().st_size == 500 == spark.read.parquet(f"{tmp_path}/once/chunks").count()


def test_option_ranges(spark, tmp_path):
    entries = spark.createDataFrame([("a", b"x")], "path string, content binary")
    for options in ({"log_n": 9}, {"log_n": 30}, {"profile": "none"}, {"sizes": (64, 100, 512)}):
        with pytest.raises(ValueError):
            container.write(entries, f"{tmp_path}/no", **options)


def test_reports(spark):
    df = spark.createDataFrame([("b|c", 2), ("a", None)], "name string, n int")
    assert reports.as_markdown(df, ["name"]) == "| name | n |\n|-|-|\n| a |  |\n| b\\|c | 2 |"
    assert {r.json for r in reports.as_json(df).collect()} == {'{"n":2,"name":"b|c"}', '{"name":"a"}'}
    sets = spark.createDataFrame([([7, 0, 1, 3, 2],), ([5],), ([],)], "x array<int>")
    text = reports.id_set_text(F.col("x"))
    assert [r[0] for r in sets.select(text).collect()] == ["0-3,7", "5", ""]
    assert [r[0] for r in sets.select(manifests.id_set(text)).collect()][:2] == [[0, 1, 2, 3, 7], [5]]
    host = spark.createDataFrame([("processor: 0\nmodel name\t: Some CPU @ 2GHz\n", "MemTotal:       16384 kB\nMemFree: 1 kB"), ("", "")], "c string, m string")
    assert [tuple(r) for r in host.select(reports.cpu_model(F.col("c")), reports.memory_bytes(F.col("m"))).collect()] == [("Some CPU @ 2GHz", 16384 * 1024), (None, None)]
