"""Queries of acceptance rules, foreign archives and text forms over the standard tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as U
from ..operators import acceptance as A
from ..operators import blocks, container, foreign, solid
from ..sources import entries as S
from ..sources import shared
from ..streaming import streams
from .catalogue import _query, _rounded

_TEXT = "coalesce(text, '')"


@_query(
    "SELECT doc_id, "
    + ", ".join(
        f"regexp_matches({v}, '{A.TYPES[k]}') AS {k}_ok"
        for k, v in {"sha256": f"CASE WHEN doc_id % 3 = 0 THEN upper(sha256({_TEXT})) ELSE sha256({_TEXT}) END", "commit": f"left(sha256({_TEXT}), CAST(38 + doc_id % 4 AS INTEGER))", "tag": "'v' || doc_id || '.' || lang", "dns_label": "source || '-' || lang", "spdx": "source || ' AND ' || lang", "stable_id": "lang || '-' || source", "snapshot_id": "'2024-0' || (doc_id % 12) || '-11'", "url": "'https://' || lang || '.' || source"}.items()
    )
    + " FROM documents"
)
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    sha = C.digest(c("content"))
    values = {
        "sha256": F.when(c("doc_id") % 3 == 0, F.upper(sha)).otherwise(sha), "commit": F.substring(sha, F.lit(1), (c("doc_id") % 4 + 38).cast("int")), "tag": F.concat(F.lit("v"), c("doc_id"), F.lit("."), c("lang")), "dns_label": F.concat("source", F.lit("-"), "lang"), "spdx": F.concat("source", F.lit(" AND "), "lang"),
        "stable_id": F.concat("lang", F.lit("-"), "source"), "snapshot_id": F.concat(F.lit("2024-0"), c("doc_id") % 12, F.lit("-11")), "url": F.concat(F.lit("https://"), "lang", F.lit("."), "source"),
    }
    return S.documents(spark, sf_dir).select("doc_id", *(A.typed(v, k).alias(f"{k}_ok") for k, v in values.items()))


@_query("""
WITH h AS (SELECT user_id, list(DISTINCT event_type) AS have, count(*) AS cpus FROM events GROUP BY user_id),
n AS (SELECT list_sort(list(DISTINCT event_type))[1:3] AS needs FROM events)
SELECT user_id, cpus, array_to_string(list_sort(list_filter(needs, lambda x: NOT list_contains(have, x))), ',') AS lacking, len(list_filter(needs, lambda x: NOT list_contains(have, x))) = 0 AND cpus >= 12 AS qualified FROM h, n""")
def host_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as hosts, the kinds of their events as controllers and the number of these as CPUs."""
    events = S.table(spark, sf_dir, "events")
    needs = sorted(r[0] for r in events.select("event_type").distinct().collect())[:3]
    hosts = events.groupBy("user_id").agg(F.collect_set("event_type").alias("controllers"), F.count("*").alias("cpus"))
    return A.qualified(hosts, needs, 12).select("user_id", "cpus", F.array_join("lacking", ",").alias("lacking"), "qualified")


_LOCK = "SELECT url AS path, CAST(strlen(html) + CASE WHEN page_id % 31 = 4 THEN 1 ELSE 0 END AS BIGINT) AS bytes, sha256(html) AS digest, 'p' || (page_id - CASE WHEN page_id % 37 = 5 THEN 1 ELSE 0 END) AS prepared FROM pages"


@_query(f"""
WITH f AS ({_LOCK} UNION {_LOCK.replace('CASE WHEN page_id % 31 = 4 THEN 1 ELSE 0 END', '0')}),
t AS (SELECT CAST(sum(b) AS BIGINT) AS t FROM (SELECT max(bytes) AS b FROM f GROUP BY path))
SELECT 'identity' AS rule, path AS entity, CAST(count(DISTINCT (bytes, digest)) AS VARCHAR) AS detail FROM f GROUP BY path HAVING count(DISTINCT (bytes, digest)) > 1
UNION ALL SELECT 'prepared', prepared, CAST(count(DISTINCT path) AS VARCHAR) FROM f GROUP BY prepared HAVING count(DISTINCT path) > 1
UNION ALL SELECT 'digest', digest, CAST(count(DISTINCT path) AS VARCHAR) FROM f GROUP BY digest HAVING count(DISTINCT path) > 1
UNION ALL SELECT 'total', 'all', CAST(t AS VARCHAR) FROM t WHERE t > 100000""")
def lock_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as locked files, listed twice, some with another size or another's prepared path the second time."""
    pages, p = S.pages(spark, sf_dir), F.col("page_id")
    once = pages.select(F.col("url").alias("path"), F.col("size").alias("bytes"), C.digest(F.col("content")).alias("digest"), F.concat(F.lit("p"), p - F.when(p % 37 == 5, 1).otherwise(0)).alias("prepared"), p)
    again = once.withColumn("bytes", F.col("bytes") + F.when(p % 31 == 4, 1).otherwise(0))
    return A.lock_violations(once.unionAll(again), 100_000)


_HELD = f"SELECT 'd' || doc_id AS path, strlen({_TEXT}) AS bytes, sha256({_TEXT}) AS digest FROM documents"


@_query(f"""
WITH a AS ({_HELD}), d AS (SELECT 'd' || (doc_id + CASE WHEN doc_id % 41 = 7 THEN 5000000 ELSE 0 END) AS path, strlen({_TEXT}) + CASE WHEN doc_id % 43 = 9 THEN 1 ELSE 0 END AS bytes, sha256({_TEXT}) AS digest FROM documents)
SELECT coalesce(d.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN d.path IS NULL THEN 'unexpected' ELSE 'changed' END AS status FROM d FULL JOIN a ON d.path = a.path WHERE a.path IS NULL OR d.path IS NULL OR a.bytes <> d.bytes OR a.digest <> d.digest
UNION ALL SELECT 'verified', (SELECT count(*) || ':' || coalesce(sum(a.bytes), 0) FROM d JOIN a USING (path, bytes, digest))""")
def locked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, declared twice; some under another path or with another size. The last row sums what is as declared."""
    docs, d = S.documents(spark, sf_dir), F.col("doc_id")
    declared = docs.select(F.concat(F.lit("d"), d + F.when(d % 41 == 7, 5_000_000).otherwise(0)).alias("path"), (F.col("size") + F.when(d % 43 == 9, 1).otherwise(0)).alias("bytes"), C.digest(F.col("content")).alias("digest"))
    differs, same = A.verified(declared.unionAll(declared), docs.select(F.concat(F.lit("d"), d).alias("path"), "content"))
    return differs.select("path", "status").unionAll(same.select(F.lit("verified"), F.concat_ws(":", "files", "bytes")))


@_query(f"""
WITH e AS (SELECT doc_id, strlen({_TEXT}) AS n FROM documents),
b AS (SELECT doc_id, k, least(256, n - k * 256) + CASE WHEN doc_id % 47 = 3 AND k = 0 THEN 300 ELSE 0 END AS size FROM (SELECT doc_id, n, unnest(range(CAST(ceil(n / 256.0) AS BIGINT))) AS k FROM e WHERE n > 0) WHERE NOT (doc_id % 53 = 2 AND k = 1)),
l AS (SELECT doc_id, max(k) AS last, min(k) AS low, count(*) AS c, sum(size) AS s FROM b GROUP BY doc_id)
SELECT 'size' AS rule, doc_id || ':' || k AS entity, 'not met' AS detail FROM b WHERE size NOT BETWEEN 1 AND 256
UNION ALL SELECT 'full', b.doc_id || ':' || k, 'not met' FROM b JOIN l USING (doc_id) WHERE size <> 256 AND k <> last
UNION ALL SELECT 'sum', CAST(e.doc_id AS VARCHAR), 'not met' FROM e LEFT JOIN l USING (doc_id) WHERE coalesce(s, 0) <> n
UNION ALL SELECT 'numbers', CAST(e.doc_id AS VARCHAR), 'not met' FROM e JOIN l USING (doc_id) WHERE low <> 0 OR last <> c - 1""")
def inner_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents, some too long and some missing."""
    docs, d, k = S.documents(spark, sf_dir), F.col("doc_id"), F.col("block_no")
    rows = blocks.fixed_blocks(docs.select("doc_id", "content"), 256).select("doc_id", "block_no", F.octet_length("bytes").alias("size"))
    rows = rows.where(~((d % 53 == 2) & (k == 1))).withColumn("size", F.col("size") + F.when((d % 47 == 3) & (k == 0), 300).otherwise(0))
    return A.block_violations(rows, docs.select("doc_id", F.col("size").alias("original_size")), "doc_id", 256)


@_query("""
WITH s AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') - CASE WHEN o_custkey % 29 = 1 THEN 9 ELSE 0 END AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT 'count:p' AS rule, CAST(k AS VARCHAR) AS entity, 'not met' AS detail FROM s WHERE p < 0
UNION ALL SELECT 'classes', CAST(k AS VARCHAR), 'not met' FROM s WHERE f + o + p <> n
UNION ALL SELECT 'ratio', CAST(k AS VARCHAR), 'not met' FROM s WHERE k % 31 = 2""")
def statistic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer by status; some counts and ratios are wrong."""
    k, status = F.col("o_custkey"), F.col("o_orderstatus")
    counted = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(status == "F").alias("f"), F.count_if(status == "O").alias("o"), (F.count_if(status == "P") - F.max(F.when(k % 29 == 1, 9).otherwise(0))).alias("p"), F.count("*").alias("n"))
    rows = counted.withColumn("share", C.ratio(F.col("f"), F.col("n")) + F.when(k % 31 == 2, 1e-9).otherwise(0.0))
    return A.statistic_violations(rows, "o_custkey", ["f", "o", "p"], "n", "f", "n", "share")


@_query("""
WITH m AS (SELECT event_id, event_id % 5 <> 1 AS exited, event_id % 11 = 3 AS timed_out, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 7 // 6 END AS status, sha256(props) AS expected, sha256(CASE WHEN event_id % 13 = 5 THEN event_type ELSE props END) AS restored FROM events),
r AS (SELECT *, CASE WHEN NOT exited THEN 'running' WHEN timed_out THEN 'timed out' WHEN coalesce(status <> 0, true) THEN 'failed' WHEN coalesce(restored <> expected, true) THEN 'differs' END AS reason FROM m)
SELECT event_id, reason, reason IS NULL AS accepted FROM r""")
def measurement_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, sha = F.col("event_id"), lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    rows = S.table(spark, sf_dir, "events").select("event_id", (e % 5 != 1).alias("exited"), (e % 11 == 3).alias("timed_out"), F.when(e % 17 != 0, F.floor(e % 7 / 6)).alias("status"), sha("props").alias("expected"), sha(F.when(e % 13 == 5, F.col("event_type")).otherwise(F.col("props"))).alias("restored"))
    return A.accepted(rows).select("event_id", "reason", "accepted")


@_query("""
WITH b AS (SELECT doc_id, hex(encode(text)) AS h, unnest(range(CAST(ceil(strlen(text) / 64.0) AS BIGINT))) AS k FROM documents WHERE strlen(text) > 0),
o AS (SELECT doc_id, k * 64 AS off, sha256(substr(h, k * 128 + 1, 128)) AS d FROM b),
l AS (SELECT doc_id, off, d, off - lag(off) OVER (PARTITION BY doc_id, d ORDER BY off) AS distance FROM o)
SELECT l.doc_id, l.off, l.distance, s.d = l.d AS equal FROM l LEFT JOIN o s ON s.doc_id = l.doc_id AND s.off = l.off - l.distance""")
def history_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that refer to the latest equal one before by its distance, resolved by offset."""
    from pyspark.sql import Window

    rows = blocks.fixed_blocks(S.documents(spark, sf_dir).select("doc_id", "content"), 64)
    keyed = rows.select("doc_id", (F.col("block_no") * 64).cast("bigint").alias("off"), F.sha2(F.encode(F.hex("bytes"), "utf-8"), 256).alias("digest"))
    far = keyed.withColumn("distance", F.col("off") - F.lag("off").over(Window.partitionBy("doc_id", "digest").orderBy("off")))
    return A.resolved(far, "doc_id", "off", "distance", "digest").select("doc_id", "off", "distance", (F.col("source") == F.col("digest")).alias("equal"))


@_query("SELECT o_custkey, CASE WHEN count(*) % 2 = 1 THEN list_sort(list(CAST(floor(o_totalprice) AS BIGINT)))[CAST(count(*) // 2 + 1 AS INTEGER)] END AS middle FROM orders GROUP BY o_custkey")
def middle_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.floor("o_totalprice")).alias("x")).select("o_custkey", A.middle(F.col("x")).alias("middle"))


@_query("""
WITH r AS (SELECT DISTINCT l_linenumber AS run, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT run, name, CAST(CASE WHEN run % 2 = 0 THEN row_number() OVER (PARTITION BY run ORDER BY name) ELSE row_number() OVER (PARTITION BY run ORDER BY name DESC) END - 1 AS INTEGER) AS place FROM r""")
def alternating_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, supplier = S.table(spark, sf_dir, "lineitem"), S.table(spark, sf_dir, "supplier")
    runs = lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).select(F.col("l_linenumber").alias("run"), F.col("s_name").alias("name")).distinct()
    return A.run_order(runs, "run", "name")


@_query("""
WITH c AS (SELECT CAST(s_suppkey AS BIGINT) AS key, s_name AS name, s_acctbal AS balance, NULL AS segment, 'raw' AS kind FROM supplier UNION ALL SELECT CAST(c_custkey AS BIGINT), c_name, c_acctbal, c_mktsegment, 'encrypted' FROM customer)
SELECT kind, segment, count(*) AS n, round(min(balance), 6) AS least FROM c GROUP BY ALL""")
def comparator_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    sealed = S.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return _rounded(A.comparators(raw, sealed).groupBy("kind", "segment").agg(F.count("*").alias("n"), F.min("balance").alias("least")), "least")


@_query("""
WITH t AS (SELECT l_returnflag AS tool, l_linenumber AS run, CAST(sum(l_partkey) AS BIGINT) AS o, CASE WHEN l_returnflag <> 'R' OR l_linenumber < 5 THEN CAST(sum(l_suppkey) AS BIGINT) END AS a, avg(l_quantity) AS e, avg(l_tax) AS d, md5(l_returnflag) AS x, md5(CASE WHEN l_linenumber = 3 THEN 'Z' ELSE l_returnflag END) AS y FROM lineitem GROUP BY l_returnflag, l_linenumber),
p AS (SELECT l_returnflag AS tool, l_linenumber AS run, max(l_orderkey) AS peak FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_returnflag, l_linenumber)
SELECT tool, run, o AS original_size, a AS archive_size, round(a / o, 9) AS ratio, round(CASE WHEN a IS NOT NULL THEN o / 1048576.0 / e END, 9) AS encode_mib_s, round(CASE WHEN a IS NOT NULL THEN o / 1048576.0 / d END, 6) AS decode_mib_s, peak AS peak_bytes, a IS NOT NULL AND x = y AS verified FROM t LEFT JOIN p USING (tool, run)""")
def benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as timed runs of a tool by return flag; one tool has no memory runs, one gave no archive in some runs."""
    lines = S.table(spark, sf_dir, "lineitem").withColumns({"tool": F.col("l_returnflag"), "run": F.col("l_linenumber")})
    timed = lines.groupBy("tool", "run").agg(
        F.sum("l_partkey").alias("original_size"), F.sum("l_suppkey").alias("archive_size"), F.avg("l_quantity").alias("encode_seconds"), F.avg("l_tax").alias("decode_seconds"), F.md5(F.first("tool").cast("binary")).alias("original_digest"), F.md5(F.first(F.when(F.col("run") == 3, F.lit("Z")).otherwise(F.col("tool"))).cast("binary")).alias("restored_digest")
    )
    timed = timed.withColumn("archive_size", F.when((F.col("tool") != "R") | (F.col("run") < 5), F.col("archive_size")))
    memory = lines.where("tool <> 'N'").select("tool", "run", F.col("l_orderkey").alias("peak_bytes"))
    rows = A.benchmark_rows(timed, memory, ["tool", "run"])
    return _rounded(_rounded(rows, "ratio", "encode_mib_s", to=9), "decode_mib_s")


@_query(f"SELECT count(*) AS entries, count(*) AS equal, CAST(sum((strlen({_TEXT}) + 8 + 511) // 512 * 512) AS BIGINT) AS padded_bytes, count(*) AS whole FROM documents")
def pad_unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.documents(spark, sf_dir).withColumn("p", C.pad(F.col("content"), 512))
    cut = F.substring(F.col("p"), F.lit(1), F.octet_length("p") - 1)
    return rows.agg(F.count("*").alias("entries"), F.count_if(C.unpad(F.col("p"), 512) == F.col("content")).alias("equal"), F.sum(F.octet_length("p")).cast("bigint").alias("padded_bytes"), F.count_if(C.unpad(cut, 512).isNull()).alias("whole"))


@_query("SELECT doc_id, nfc_normalize(left(text, 200)) AS composed, strlen(nfc_normalize(text)) AS size FROM documents")
def composed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.documents(spark, sf_dir).withColumn("c", U.nfc(F.col("text")))
    return rows.select("doc_id", U.nfc(F.substring("text", 1, 200)).alias("composed"), F.octet_length("c").cast("bigint").alias("size"))


@_query(f"""
WITH k AS (SELECT unnest(['tar.gz', 'tar.xz', 'tar.zst', 'zip']) AS kind)
SELECT kind, count(*) AS files, count(*) AS equal, CAST(sum(strlen({_TEXT})) AS BIGINT) AS bytes FROM documents, k GROUP BY kind""")
def foreign_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in archives of 64 ids each, in every format, and their files again."""
    docs = S.documents(spark, sf_dir)
    files = docs.select(F.floor(F.col("doc_id") / 64).alias("part"), F.concat(F.lit("text/"), "doc_id", F.lit(".txt")).alias("path"), "content")
    out = None
    for kind in sorted(foreign.FORMATS):
        back = foreign.unpack(foreign.pack(files, "part", kind), "part", kind).withColumnRenamed("content", "again")
        one = files.join(back, ["part", "path"], "left").agg(F.lit(kind).alias("kind"), F.count("*").alias("files"), F.count_if(F.col("content") == F.col("again")).alias("equal"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))
        out = one if out is None else out.unionAll(one)
    return out


@_query(f"SELECT count(*) AS entries, count(*) AS intact, CAST(sum(strlen({_TEXT})) AS BIGINT) AS bytes FROM documents")
def solid_archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a solid archive of three lanes, and read again."""
    target = shared.new_folder(spark, "solid")
    solid.write(S.documents(spark, sf_dir).select(F.concat(F.lit("d/"), "doc_id").alias("path"), "content"), target, (64, 1024, 8192), 1 << 20)
    back = solid.read(spark, target)
    return back.agg(F.count("*").alias("entries"), F.count_if("intact").alias("intact"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


@_query(f"SELECT count(*) AS entries, count(*) AS intact, CAST(sum(strlen({_TEXT})) AS BIGINT) AS bytes FROM documents")
def sealed_archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a sealed archive, verified as a whole and read again."""
    target = shared.new_folder(spark, "sealed")
    container.write(S.documents(spark, sf_dir).select(F.concat(F.lit("d/"), "doc_id").alias("path"), "content"), target, "a test password", (64, 1024, 8192), "fast", 14)
    return container.read(spark, target, "a test password").agg(F.count("*").alias("entries"), F.count_if("intact").alias("intact"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


@_query(f"SELECT doc_id, CAST(k AS BIGINT) AS frame_index, substr(hex(encode({_TEXT})), CAST(k * 1024 + 1 AS BIGINT), 1024) AS payload FROM (SELECT doc_id, text, unnest(range(CAST(ceil(strlen({_TEXT}) / 512.0) AS BIGINT))) AS k FROM documents)")
def framed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as framed files under a key, and the frames that are read from them."""
    rows = blocks.fixed_blocks(S.documents(spark, sf_dir).select("doc_id", "content"), 512)
    files = S.frame_files(rows, "doc_id", "block_no", "bytes", b"a key")
    return S.read_frames(files, "doc_id", key=b"a key").select("doc_id", "frame_index", F.hex("payload").alias("payload"))


@_query("""
WITH r AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, page_id, url, len(string_split(url, '/')) AS depth FROM pages)
SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY depth DESC, url, page_id) AS place FROM r""")
def reverse_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = S.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), "page_id", "url")
    order = Window.partitionBy("host").orderBy(F.desc(F.size(F.split("url", "/"))), "url", "page_id")
    return rows.select("host", "page_id", F.row_number().over(order).cast("bigint").alias("place"))


@_query("SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS at, count(*) AS samples, round(max(value), 6) AS peak FROM events GROUP BY ALL")
def sampled_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of samples: the highest value of each kind in each ten minutes."""
    samples = streams.follow(spark, f"{sf_dir}/events.parquet")
    return _rounded(streams.windowed_peaks(samples, "event_type", "ts", "value", "10 minutes"), "peak")


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', {v}, {str(r).lower()}, {str(w).lower()})" for f, v, r, w in A.FORMATS) + ") t(format, version, reads, writes)")
def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.compatibility(spark)
