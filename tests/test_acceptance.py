"""Acceptance rules, foreign archives, text forms and the command line: nulls, empties, damage."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.__main__ import main
from siltstone.functions import columns as C
from siltstone.functions import text as U
from siltstone.operators import acceptance as A
from siltstone.operators import container, foreign, manifests, reports, stats
from siltstone.sources import shared


def test_unicode(spark):
    texts = ["é", "é", "Straße", "STRASSE", None, "", "ﬁ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(U.nfc(F.col("t")), U.folded(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("é", "é"), ("é", "é"), ("Straße", "strasse"), ("STRASSE", "strasse"), (None, None), ("", ""), ("ﬁ", "fi")]
    paths = spark.createDataFrame([("a/Straße",), ("a/STRASSE",), ("é",), ("é",), ("x",)], "path string")
    assert {(r.rule, r.entity) for r in manifests.path_violations(paths, "path").collect()} == {("collision", "a/strasse"), ("collision", "é")}


def test_strict_json(spark):
    texts = {'{"b":[{"y":1,"x":null}],"a":"é"}': None, '{"a":{"k":1,"k":2}}': "a key twice", '{"a":[NaN]}': "the constant NaN", "{": "no JSON", "": "no JSON", "[" * 100_000: "no JSON", "7": None, None: "null"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.f for r in df.select("t", U.json_fault(F.col("t")).alias("f")).collect()} == texts
    assert df.where("t like '%é%'").select(U.canonical_json(F.col("t"))).first()[0] == '{"a":"é","b":[{"x":null,"y":1}]}'
    rows = spark.createDataFrame([({"z": 1, "a": 2}, None)], "m map<string,int>, n int")
    assert rows.select(reports.canonical_digest("n", "m")).first()[0] == hashlib.sha256(b'{"m":{"a":2,"z":1},"n":null}').hexdigest()
    assert reports.as_json(rows).first().json == '{"m":{"a":2,"z":1}}'


def test_pad(spark):
    df = spark.createDataFrame([(b"",), (b"x" * 8,), (b"y" * 9,), (None,)], "c binary").withColumn("p", C.pad(F.col("c"), 16))
    rows = df.select("c", "p", C.unpad(F.col("p"), 16).alias("u"), C.unpad(F.concat("p", F.lit(b"0" * 16)), 16).alias("long")).collect()
    assert [len(r.p) for r in rows[:3]] == [16, 16, 32] and rows[3].p is None and all(r.u == r.c and r.long is None for r in rows)


def test_hosts_and_measurements(spark):
    hosts = spark.createDataFrame([("a", ["cpu", "mem"], 8, "linux"), ("b", ["cpu"], 8, "linux"), ("c", None, 8, "linux"), ("d", ["cpu", "mem"], None, "linux"), ("e", ["cpu", "mem"], 8, "other")], "host string, controllers array<string>, cpus int, system string")
    assert {r.host: (r.lacking, r.qualified) for r in A.qualified(hosts, ["mem", "cpu"], 4, "linux").collect()} == {"a": ([], True), "b": (["mem"], False), "c": (["cpu", "mem"], False), "d": ([], False), "e": ([], False)}
    m = spark.createDataFrame([(1, True, 0, False, "x", "x"), (2, None, 0, False, "x", "x"), (3, True, None, False, "x", "x"), (4, True, 0, True, "x", "x"), (5, True, 0, False, None, "x"), (6, True, 0, None, "x", "x")], "k int, exited boolean, status int, timed_out boolean, restored string, expected string")
    assert {r.k: r.reason for r in A.accepted(m).collect()} == {1: None, 2: "running", 3: "failed", 4: "timed out", 5: "differs", 6: "timed out"}


def test_small_rules(spark):
    one = spark.range(1)
    lists = [F.array(*map(F.lit, x)) for x in ([3, 1, 2], [1, 2], [5])] + [F.array(F.lit(1), F.lit(None), F.lit(2))]
    assert tuple(one.select(*(A.middle(x) for x in lists)).first()) == (2, None, 5, None)
    runs = spark.createDataFrame([(r, t) for r in range(2) for t in "abc"], "run int, tool string")
    assert {(r.run, r.tool): r.place for r in A.run_order(runs, "run", "tool").collect()} == {(0, "a"): 0, (0, "b"): 1, (0, "c"): 2, (1, "a"): 2, (1, "b"): 1, (1, "c"): 0}
    sides = stats.sides(spark.createDataFrame([([1.0, 9.0, 2.0, 4.0], []), (None, [3.0])], "candidate array<double>, comparator array<double>")).collect()
    assert (sides[0].candidate_median, sides[0].candidate_mad, sides[0].comparator_median) == (3.0, 1.5, None) and (sides[1].candidate_median, sides[1].comparator_median, sides[1].comparator_mad) == (None, 3.0, 0.0)
    heads = spark.createDataFrame([(container.VERSION, "0" * 32, bytes(16), bytes(4), False, 15, "fast"), (1, None, b"", bytes(4), None, 99, "?")], container.HEADER)
    assert sorted(r.rule for r in container.header_violations(heads).collect()) == ["archive", "log_n", "profile", "salt", "sealed", "version"]
    tree = spark.createDataFrame([("a",), ("a/b/c",), ("a/b",), ("z",)], "path string")
    assert [r.path for r in A.in_reverse_depth(tree).collect()] == ["a/b/c", "a/b", "a", "z"]


@pytest.mark.parametrize("kind", sorted(foreign.FORMATS))
def test_foreign(spark, kind):
    data = [("g", "d/one.txt", b"x" * 1000), ("g", "two", None), ("h", "empty", b"")]
    packed = foreign.pack(spark.createDataFrame(data, "g string, path string, content binary"), "g", kind)
    assert {(r.g, r.path): bytes(r.content) for r in foreign.unpack(packed, "g", kind).collect()} == {(g, p): c or b"" for g, p, c in data}
    assert {(r.g, bytes(r.archive)) for r in packed.collect()} == {(r.g, bytes(r.archive)) for r in packed.collect()}
    assert foreign.unpack(packed.limit(0), "g", kind).count() == 0
    with pytest.raises(Exception, match="damaged"):
        foreign.unpack(packed.withColumn("archive", F.substring("archive", 1, 20)), "g", kind).collect()
    for bad in (["../up"], ["a", "A"]):
        with pytest.raises(Exception, match="portable|twice"):
            foreign.pack(spark.createDataFrame([("g", p, b"") for p in bad], "g string, path string, content binary"), "g", kind).collect()


def test_unsafe_archives(spark, monkeypatch):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("../out", b"x")
    link = io.BytesIO()
    with tarfile.open(fileobj=link, mode="w:gz") as f:
        info = tarfile.TarInfo("l")
        info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
        f.addfile(info)
    for kind, data in (("zip", z.getvalue()), ("tar.gz", link.getvalue())):
        with pytest.raises(foreign.Unsafe):
            foreign.FORMATS[kind][1](data)
    monkeypatch.setattr(foreign, "MOST_BYTES", 100)
    for kind, (write, read) in foreign.FORMATS.items():
        with pytest.raises(foreign.Unsafe, match="more bytes"):
            read(write([("a", b"x" * 101)]))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "x.txt").write_bytes(b"the same words " * 99)
    (tmp_path / "in" / "y.gz").write_bytes(b"\x1f\x8bxxx")
    assert main(["encode", f"{tmp_path}/in", f"{tmp_path}/out"]) == 0 and main(["verify", f"{tmp_path}/out"]) == 0
    assert main(["decode", f"{tmp_path}/out", f"{tmp_path}/back"]) == 0 and spark.read.parquet(f"{tmp_path}/back").where("intact").count() == 2
    capsys.readouterr()
    main(["inspect", f"{tmp_path}/out"])
    assert json.loads(capsys.readouterr().out)["entries"] == 2
    main(["sniff", f"{tmp_path}/in"])
    assert "| gzip | 1 | 5 |" in capsys.readouterr().out
    main(["benchmark", f"{tmp_path}/in"])
    lines = capsys.readouterr().out.strip().split("\n")
    assert len(lines) == 2 + 1 + len(foreign.FORMATS) and all(x.endswith("| True |") for x in lines[2:])
    main(["compatibility"])
    assert "archive" in capsys.readouterr().out
    (tmp_path / "gates").write_text('{"gate":"a","done":true}\n{"gate":"b","done":false}\n')
    assert main(["readiness", f"{tmp_path}/gates"]) == 1 and "1 of 2" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["decode", "x"])


def test_kept_folders_go(spark, tmp_path):
    since = shared.mark(spark)
    first = shared.kept(spark.range(3))
    second = shared.kept(first.where("id > 0"), first)
    assert second.count() == 2 and shared.mark(spark) == since + 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist|FAILED_READ_FILE"):
        first.count()
    shared.release(spark, since)
    assert shared.mark(spark) == since
