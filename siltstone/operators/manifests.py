"""Set-based validation: every rule is a query whose rows are the violations (rule, entity, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.text import folded
from ..sources.shared import kept
from .chunks import prefix_sum, prefix_sums


def framed(entries: DataFrame, order: str, size: str, frame: int) -> DataFrame:
    """entries with frame_count and first_frame, the number of frames of all entries before it in order."""
    counted = entries.withColumn("frame_count", F.ceil(F.col(size) / frame).cast("bigint"))
    return prefix_sum(counted, [F.col(order)], "frame_count", "first_frame")


def _violation(rows: DataFrame, rule: str, entity: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), detail.cast("string").alias("detail"))


def rule_violations(rows: DataFrame, entity: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, entity, detail) of each row and rule whose condition isn't true; a null condition isn't."""
    named = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(F.explode(named).alias("rule"), entity.cast("string").alias("entity")).select("rule", "entity", F.lit("not met").alias("detail"))


def path_violations(entries: DataFrame, path: str, is_dir: str | None = None) -> DataFrame:
    """Paths that aren't portable, that collide when composed and case-folded, or lack their parent."""
    p = F.col(path)
    bad = _violation(entries.where(~C.portable_path(p)), "path", p, F.lit("not portable"))
    twice = entries.groupBy(folded(p).alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    out = bad.unionAll(_violation(twice, "collision", F.col("k"), F.col("n")))
    if is_dir:
        parent = F.regexp_extract(p, "^(.*)/[^/]*$", 1)
        wanted = entries.select(parent.alias("parent")).where("parent <> ''").distinct()
        dirs = entries.where(F.col(is_dir)).select(p.alias("parent")).distinct()
        out = out.unionAll(_violation(wanted.join(dirs, "parent", "left_anti"), "parent", F.col("parent"), F.lit("missing")))
    return out


def range_violations(entries: DataFrame, order: str, first: str, count: str) -> DataFrame:
    """Entries whose range doesn't begin where the ranges before it end."""
    summed = prefix_sum(entries, [F.col(order)], count, "_before")
    return _violation(summed.where(F.col(first) != F.col("_before")), "range", F.col(order), F.col(first) - F.col("_before"))


def reference_violations(chunks: DataFrame) -> DataFrame:
    """(occ, source_index, digest, size) rows that refer forward, to a row that isn't its own source, or to other content."""
    source = chunks.select(F.col("occ").alias("s_occ"), F.col("source_index").alias("s_source"), F.col("digest").alias("s_digest"), F.col("size").alias("s_size"))
    joined = chunks.join(source, chunks["source_index"] == source["s_occ"], "left")
    reason = (
        F.when(F.col("source_index") > F.col("occ"), "forward").when(F.col("s_occ").isNull(), "absent").when(F.col("s_source") != F.col("s_occ"), "chained")
        .when((F.col("digest") != F.col("s_digest")) | (F.col("size") != F.col("s_size")), "content")
    )
    return _violation(joined.withColumn("_why", reason).where("_why is not null"), "reference", F.col("occ"), F.col("_why"))


def size_violations(entries: DataFrame, key: str, size: str, chunks: DataFrame) -> DataFrame:
    """Entries whose chunks don't add up to their size; an entry without chunks counts as 0."""
    sums = chunks.groupBy(key).agg(F.sum("size").alias("_sum"))
    joined = entries.join(sums, key, "left").withColumn("_sum", F.coalesce("_sum", F.lit(0)))
    return _violation(joined.where(F.col("_sum") != F.col(size)), "size", F.col(key), F.col("_sum") - F.col(size))


def limit_violations(frames: DataFrame, order: str, size: str, most_bytes: int, most_frames: int) -> DataFrame:
    """Frames at which the running output or the number of frames passes its limit."""
    summed = prefix_sums(frames.withColumn("_one", F.lit(1)), [F.col(order)], {size: "_bytes", "_one": "_frames"})
    over = F.when(F.col("_bytes") + F.col(size) > most_bytes, "bytes").when(F.col("_frames") + 1 > most_frames, "frames")
    return _violation(summed.withColumn("_why", over).where("_why is not null"), "limit", F.col(order), F.col("_why"))


def order_violations(frames: DataFrame, stream: str, index: str) -> DataFrame:
    """Frames whose index isn't the one after that of the frame before it in its stream, from 0."""
    w = Window.partitionBy(stream).orderBy(index)
    wrong = frames.withColumn("_want", F.row_number().over(w) - 1).where(F.col(index) != F.col("_want"))
    return _violation(wrong, "order", F.concat_ws(":", stream, index), F.col("_want"))


def dependency_violations(rows: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Keys that come with more than one value."""
    kinds = rows.groupBy(*key).agg(F.countDistinct(F.struct(*value)).alias("n")).where("n > 1")
    return _violation(kinds, "dependency", F.concat_ws(":", *key), F.col("n"))


def difference(declared: DataFrame, actual: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., status): what is missing, unexpected, or declared with another value; nulls compare equal to nulls."""
    a = declared.select(*key, F.col(value).alias("_d"), F.lit(True).alias("_in_d"))
    b = actual.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    status = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_d").isNull(), "unexpected").when(~F.col("_d").eqNullSafe(F.col("_a")), "changed")
    return a.join(b, key, "full_outer").select(*key, status.alias("status")).where("status is not null")


def incomplete(found: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Coordinates of the product of the dimensions that found lacks (missing) or has beyond it (unexpected)."""
    product = dimensions[0]
    for d in dimensions[1:]:
        product = product.crossJoin(d)
    have = found.select(*product.columns).distinct()
    return product.join(have, product.columns, "left_anti").withColumn("status", F.lit("missing")).unionAll(have.join(product, product.columns, "left_anti").withColumn("status", F.lit("unexpected")))


def json_keys(rows: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """rows with keys_ok: the object's top-level keys are the expected ones, each once. Null where it isn't an object."""
    keys = F.json_object_keys(column)
    fine = (F.size(keys) == F.size(F.array_distinct(keys))) & (F.size(F.array_except(keys, F.array(*map(F.lit, expected)))) == 0) & (F.size(keys) == len(expected))
    return rows.withColumn("keys_ok", F.when(keys.isNull(), None).otherwise(fine))


def id_set(text: Column) -> Column:
    """The numbers of a set like 0-3,7, ascending; null where it isn't one."""
    parts = F.transform(F.split(text, ","), lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    return F.when(text.rlike("^\\d+(-\\d+)?(,\\d+(-\\d+)?)*$"), F.array_sort(F.array_distinct(F.flatten(parts))))


def ancestry(processes: DataFrame, root: str = "pid", parent: str = "ppid") -> DataFrame:
    """(pid, ancestor, depth) of every process, itself at depth 0, by the shortest way; each round doubles the distance that
    is known and is kept, so long chains end in logarithmic time and cycles end at all."""
    edge = processes.select(F.col(root).cast("bigint").alias("pid"), F.col(parent).cast("bigint").alias("up")).where("pid is not null").distinct()
    real = edge.join(edge.select(F.col("pid").alias("up")).distinct(), "up", "left_semi").where("pid <> up")
    own = edge.select("pid", F.col("pid").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    known = kept(own.unionAll(real.select("pid", F.col("up").alias("ancestor"), F.lit(1))))
    size = known.count()
    while True:
        far = known.select(F.col("pid").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        longer = known.join(far, "ancestor").select("pid", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        known = kept(longer.groupBy("pid", "ancestor").agg(F.min("depth").alias("depth")), before=known)
        before, size = size, known.count()
        if size == before:
            return known
