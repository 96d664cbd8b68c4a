"""Robust summaries of repeated measurements, reproducible bootstrap intervals and verdicts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

RESAMPLES = 10_000
CONFIDENCE = 0.95
MEASURED = 11
#: Domains of case identities and of the bootstrap's index stream.
CASE_DOMAIN = "siltstone/case/1"
STREAM_DOMAIN = "siltstone/bootstrap-stream/1"
CASE_PREFIX = "case-1-"
CASE_FIELDS = ("contract_sha256", "corpus_manifest_sha256", "corpus_id", "input_sha256", "input_bytes", "thread_count", "metric")


def median_mad(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, median, mad): exact medians of groups and the unscaled median absolute deviation from them.

    Rows are counted by value first, so what is shuffled and joined are distinct values. Nulls are a group of by; null values
    aren't counted, and a group of nothing else has null results.
    """
    counts = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    medians = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("n"), F.expr("percentile(_v, 0.5, _n)").alias("median"))
    keys = medians.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), "n", "median")
    near = counts.join(keys, [counts[c].eqNullSafe(keys[f"_by{k}"]) for k, c in enumerate(by)])
    return near.groupBy(*by, "n", "median").agg(F.expr("percentile(abs(_v - median), 0.5, _n)").alias("mad"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated exact percentiles by name. Rows are counted by value before they are shuffled; the counts of distinct
    values are what a group keeps in memory."""
    counts = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(*(F.expr(f"percentile(_v, {s}, _n)").alias(name) for name, s in shares.items()))


def run_summary(runs: DataFrame, by: list[str], same: list[str], timings: list[str], peaks: list[str], size: str) -> DataFrame:
    """One row per group of runs: fields that must agree (null and consistent = false where they don't), median timings and
    their MADs, highest peaks, and size per median second in MiB."""
    agg = [F.count("*").alias("runs")]
    agg += [F.when(F.countDistinct(c) == 1, F.first(c)).alias(c) for c in same]
    agg += [F.expr(" AND ".join(f"count(DISTINCT {c}) = 1" for c in same) or "true").alias("consistent")]
    agg += [F.expr(f"percentile({c}, 0.5)").alias(f"median_{c}") for c in timings] + [F.max(c).alias(f"max_{c}") for c in peaks]
    out = runs.groupBy(*by).agg(*agg)
    return out.select("*", *(C.mib_per_second(F.col(size), F.col(f"median_{c}")).alias(f"mib_s_{c}") for c in timings))


def size_deltas(sizes: DataFrame, by: list[str], tool: str, size: str, candidate: str) -> DataFrame:
    """(by..., tool, size, delta_bytes, delta_ratio): every other tool against the candidate of its group."""
    own = sizes.where(F.col(tool) == candidate).select(*by, F.col(size).alias("_own"))
    return sizes.where(F.col(tool) != candidate).join(own, by).select(*by, tool, size, (F.col("_own") - F.col(size)).alias("delta_bytes"), C.ratio(F.col("_own") - F.col(size), F.col(size)).alias("delta_ratio"))


def least(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by..., name, value) with the least value, the first name of equals."""
    return rows.groupBy(*by).agg(F.min(F.struct(value, name)).alias("m")).select(*by, F.col(f"m.{name}").alias(name), F.col(f"m.{value}").alias(value))


def size_verdict(cases: DataFrame) -> DataFrame:
    """cases (input_bytes, candidate, best_raw, smallest_encrypted) with incompressible, allowance, limit_bytes and passed.

    A case is incompressible if even the best raw size is over 99 % of the input; then the candidate may reach, inclusively,
    both the input with its allowance and the smallest encrypted size. Otherwise it must be below every comparator.
    """
    n, own, raw, sealed = (F.col(c) for c in ("input_bytes", "candidate", "best_raw", "smallest_encrypted"))
    hard, room = raw * 100 > n * 99, n + C.allowance(n)
    return cases.select("*", hard.alias("incompressible"), C.allowance(n).alias("allowance"), F.when(hard, F.least(sealed, room)).otherwise(F.least(raw, sealed)).alias("limit_bytes"), F.when(hard, (own <= room) & (own <= sealed)).otherwise(own < F.least(raw, sealed)).alias("passed"))


def case_id(cases: DataFrame) -> Column:
    return F.concat(F.lit(CASE_PREFIX), F.sha2(C.length_prefixed(F.lit(CASE_DOMAIN), *(F.col(c).cast("string") for c in CASE_FIELDS)), 256))


def stream_material(comparator: Column) -> Column:
    """The bytes that seed a case's index stream."""
    return C.length_prefixed(F.lit(STREAM_DOMAIN), *(F.col(c).cast("string") for c in CASE_FIELDS), comparator)


#: Resamples whose arrays are made at once; they stay below the 128 KiB from which the allocator maps fresh pages each time.
AT_ONCE = 1000


def index_blocks(material: bytes, size: int, below: int) -> Iterator[np.ndarray]:
    """The index stream in blocks of size, without end: 64-bit words of SHA-256 over material and a counter, those beyond the
    last multiple of below rejected, the rest taken modulo below."""
    limit = (1 << 64) - (1 << 64) % below
    head, held, counter = hashlib.sha256(material), np.zeros(0, np.int64), 0
    while True:
        n = max(64, (size - len(held)) // 4 + 1)
        digests = bytearray()
        for k in range(counter, counter + n):
            block = head.copy()
            block.update(k.to_bytes(8, "big"))
            digests += block.digest()
        counter += n
        words = np.frombuffer(bytes(digests), ">u8").astype(np.uint64)
        if limit < 1 << 64:
            words = words[words < np.uint64(limit)]
        held = np.concatenate([held, (words % np.uint64(below)).astype(np.int64)])
        while len(held) >= size:
            yield held[:size]
            held = held[size:]


def indices(material: bytes, count: int, below: int) -> np.ndarray:
    """The first count indices of the stream."""
    return next(index_blocks(material, count, below)) if count else np.zeros(0, np.int64)


def resampled(material: bytes, ratios: np.ndarray, resamples: int) -> Iterator[np.ndarray]:
    """The medians of all resamples, up to AT_ONCE at a time."""
    width = len(ratios)
    blocks = index_blocks(material, AT_ONCE * width, width)
    for done in range(0, resamples, AT_ONCE):
        yield _medians(ratios, next(blocks)[: (resamples - done) * width].reshape(-1, width))


def _medians(ratios: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The median of ratios at each row of picks. Ranks are compared instead of ratios, a column of all rows at a time."""
    count = len(ratios)
    if count % 2 == 0 or count > 63 or np.isnan(ratios).any():
        return np.median(ratios[picks], axis=1)
    order = np.argsort(ratios, kind="stable")
    rank = np.empty(count, np.uint8)
    rank[order] = np.arange(count)
    lines = np.ascontiguousarray(rank[picks].T)
    least = np.empty(len(picks), np.uint8)
    for turn in range(count):  # odd-even transposition sorts each row
        for k in range(turn % 2, count - 1, 2):
            np.minimum(lines[k], lines[k + 1], out=least)
            np.maximum(lines[k], lines[k + 1], out=lines[k + 1])
            lines[k] = least
    return ratios[order][lines[count // 2]]


def bootstrap(cases: DataFrame, key: str, resamples: int = RESAMPLES, confidence: float = CONFIDENCE) -> DataFrame:
    """(key, ratio_median, lower, upper, passed) of cases (key, material, candidate, comparator): the paired ratios'
    median, the interval of resampled medians by linear interpolation, and whether its upper end is below 1.

    Cases are independent: a case is one row and its resamples are one array in the worker; the few rows are spread over all
    cores first.
    """
    tail = (1 - confidence) / 2

    def one(material: bytes, ratios: np.ndarray) -> tuple:
        picked = np.concatenate(list(resampled(material, ratios, resamples)))
        low, high = np.quantile(picked, [tail, 1 - tail])
        return float(np.median(ratios)), float(low), float(high), bool(high < 1)

    return _each_case(cases, key, one, {"ratio_median": "double", "lower": "double", "upper": "double", "passed": "boolean"})


def passes(material: bytes, ratios: np.ndarray, resamples: int = RESAMPLES, confidence: float = CONFIDENCE) -> bool:
    """Whether the interval's upper end is below 1, as bootstrap() has it. The upper end lies between two places of the sorted
    medians, so resampling ends as soon as so many medians are below 1, or aren't, that the rest can't change the answer;
    where both places differ in that, the whole interval is worked out."""
    upper = 1 - (1 - confidence) / 2
    place = (resamples - 1) * upper
    enough_below, enough_others = min(resamples, math.ceil(place + 1e-6) + 1), resamples - max(0, math.floor(place - 1e-6))
    picked, below, seen = [], 0, 0
    for medians in resampled(material, ratios, resamples):
        picked.append(medians)
        seen += len(medians)
        below += int((medians < 1).sum())
        if below >= enough_below:
            return True
        if seen - below >= enough_others and not np.isnan(ratios).any():
            return False
    return bool(np.quantile(np.concatenate(picked), [1 - upper, upper])[1] < 1)


def verdicts(cases: DataFrame, key: str) -> DataFrame:
    """(key, passed) of bootstrap()."""
    return _each_case(cases, key, lambda material, ratios: (passes(material, ratios),), {"passed": "boolean"})


def _each_case(cases: DataFrame, key: str, one: Callable[[bytes, np.ndarray], tuple], names: dict[str, str]) -> DataFrame:
    """(key, names...) that one gives of each case's material and paired ratios."""
    # by another expression than the cases are grouped by: else their shuffle may be taken for it and gathered in few tasks
    base = cases.select(key, "material", "candidate", "comparator").repartition(4 * cases.sparkSession.sparkContext.defaultParallelism, F.xxhash64(key))
    kinds = {"double": pa.float64(), "boolean": pa.bool_()}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(m, np.array(a, float) / np.array(b, float)) for m, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            c = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kinds[k]) for x, k in zip(c, names.values()))], [key, *names])

    return base.mapInArrow(apply, f"{key} {base.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in names.items()))


def index_stream(cases: DataFrame, key: str, count: int, below: int) -> DataFrame:
    """(key, i, pick): the first count indices of each case's stream."""
    kind = cases.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, material in enumerate(batch.column(1).to_pylist()):
                picks = indices(material, count, below).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[row], count), pa.array(np.arange(count)), pa.array(picks)], [key, "i", "pick"])

    return cases.select(key, "material").mapInArrow(apply, f"{key} {kind}, i bigint, pick int")


def _distance(name: str):
    return lambda v: F.abs(v - F.col(name))


def sides(cases: DataFrame) -> DataFrame:
    """cases with the median and the unscaled median absolute deviation of both sides' samples, null for no samples."""

    def median(x: Column) -> Column:
        ordered, n = F.array_sort(x), F.size(x)
        return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)

    out = cases
    for side in ("candidate", "comparator"):
        out = out.withColumn(f"{side}_median", median(F.col(side)))
        out = out.withColumn(f"{side}_mad", median(F.transform(side, _distance(f"{side}_median"))))
    return out


def overall(verdicts: DataFrame, *by: str) -> DataFrame:
    """Whether all verdicts passed, and how many did."""
    return verdicts.groupBy(*by).agg(F.bool_and("passed").alias("passed"), F.count_if("passed").alias("passed_count"), F.count("*").alias("total"))


def readiness(gates: DataFrame) -> DataFrame:
    """One row: completed, total and percent of (gate, done) rows."""
    return gates.agg(F.count_if("done").alias("completed"), F.count("*").alias("total"), F.round(F.coalesce(F.avg(F.col("done").cast("double")), F.lit(0.0)) * 100, 2).alias("percent"))


def peak_of_sums(samples: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """(group, peak): the highest over times of the sum over members."""
    return samples.groupBy(group, at).agg(F.sum(value).alias("s")).groupBy(group).agg(F.max("s").alias("peak"))


def running_share(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """rows with done, the running total of value in its group, and percent of the group's total (0 if that is 0)."""
    w = Window.partitionBy(by).orderBy(*order)
    whole = Window.partitionBy(by)
    return rows.withColumn("done", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("percent", F.round(C.ratio(F.col("done") * 100, F.sum(value).over(whole)), 4))
