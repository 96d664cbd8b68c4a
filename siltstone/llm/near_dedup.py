"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint is the sign of the sum of its distinct words' hashes: 64 bits to search by and 128 to verify.
The 64 bits fall into partitions of correlated bits; partition i has a threshold T_i of at least -1, and as the
thresholds add up to RADIUS - partitions + 1, two fingerprints within RADIUS differ by at most T_i in some partition i.
Dynamic programming picks the thresholds from the measured distribution of distances between partition values, and the
number of partitions with the least estimated cost. Each fingerprint probes for the values within T_i of its own; pairs
found are verified on the whole fingerprint, and documents linked by such pairs make a group.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .graph import components

BITS = 64
RADIUS = 8
#: Most bits that may differ among all 192.
VERIFY_RADIUS = 32
PARTITIONS = (3, 4, 5)
CHUNK = 11
#: Relative cost of a probe that is shuffled and of a candidate that is verified where it is found.
PROBE_COST, CANDIDATE_COST = 1.0, 0.05
SLICE = 1 << 20


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have words, their fingerprints as three 64-bit numbers each)."""
    h, _, _, first = K.word_hashes(column)
    owner = np.repeat(np.arange(len(column)), np.diff(first)).astype(np.uint64)
    keys = np.unique((owner << np.uint64(44)) | (h >> np.uint64(20)))  # a slice has far fewer than 2^20 texts
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    owner = (keys >> np.uint64(44)).astype(np.int64)
    word = keys & np.uint64((1 << 44) - 1)
    at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[at, len(keys)])
    out = np.empty((len(at), 3), np.int64)
    for k in range(3):
        with np.errstate(over="ignore"):
            bits = np.unpackbits(K.mix(word + np.uint64((k * 0xD1342543DE82EF95 + 1) & K.MASK)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[:, k] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
    return owner[at], out


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1, f2) of every document that has an id and a word."""

    def apply(batches):
        for part in K.slices(batches, "text", SLICE):
            for at in range(0, part.num_rows, 1 << 16):
                piece = part.slice(at, 1 << 16)
                rows, f = fingerprints(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(rows)), *(pa.array(f[:, k]) for k in range(3))], ["doc_id", "f0", "f1", "f2"])

    docs = K.only(docs, "doc_id", "text")
    texts = docs.select(K.integer_id(docs, "doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return texts.mapInArrow(apply, "doc_id bigint, f0 bigint, f1 bigint, f2 bigint")


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_moments(prints: DataFrame) -> np.ndarray:
    """How often each two bits are set together, over all fingerprints."""

    def apply(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = _bits(batch).astype(np.float32)
            total += x.T @ x
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for i, j, n in prints.select("f0").mapInArrow(apply, "i bigint, j bigint, n double").groupBy("i", "j").agg(F.sum("n")).collect():
        out[i, j] = n
    return out


def group_bits(moments: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in so many near-equal groups: each opens with a free bit and takes those most correlated with it."""
    p = np.diag(moments) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((moments / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation))
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - k)
        strength = tie[np.ix_(free, free)] - np.eye(len(free))
        group = [free.pop(int(strength.max(axis=1).argmax()))]
        while len(group) < width:
            group.append(free.pop(int(tie[np.ix_(free, group)].sum(axis=1).argmax())))
        groups.append(group)
    return groups


def distance_shares(prints: DataFrame, chunks: list[list[int]], n: int) -> list[np.ndarray]:
    """For each chunk of bits, the share of pairs of all fingerprints at distance 0, 1, ...: from the counts of its values
    by their autocorrelation (Walsh-Hadamard)."""

    def apply(batches):
        counts = [np.zeros(1 << len(c), np.int64) for c in chunks]
        for batch in batches:
            x = _bits(batch).astype(np.int64)
            for c, count in zip(chunks, counts):
                count += np.bincount(x[:, c] @ (1 << np.arange(len(c))), minlength=len(count))
        k = np.repeat(np.arange(len(chunks)), [len(c) for c in counts])
        v, flat = np.concatenate([np.arange(len(c)) for c in counts]), np.concatenate(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k[flat > 0]), pa.array(v[flat > 0]), pa.array(flat[flat > 0])], ["k", "v", "n"])

    counts = [np.zeros(1 << len(c)) for c in chunks]
    for k, v, m in prints.select("f0").mapInArrow(apply, "k bigint, v bigint, n bigint").groupBy("k", "v").agg(F.sum("n")).collect():
        counts[k][v] = m
    shares = []
    for c, x in zip(chunks, counts):
        for b in range(len(c)):
            y = x.reshape(-1, 2, 1 << b)
            x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).ravel()
        x = x * x
        for b in range(len(c)):
            y = x.reshape(-1, 2, 1 << b)
            x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).ravel() / 2
        weight = np.array([int(v).bit_count() for v in range(1 << len(c))])
        shares.append(np.bincount(weight, weights=np.maximum(x, 0), minlength=len(c) + 1) / max(n, 1) ** 2)
    return shares


def allocate(widths: list[int], within: list[np.ndarray], n: int, radius: int) -> tuple[float, list[int]]:
    """(estimated cost, thresholds): dynamic programming over partitions and the total of the thresholds so far, which
    must come to radius - partitions + 1; within[i][t] is the share of pairs that differ by at most t there."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for w, share in zip(widths, within):
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, min(w, radius) + 1):
                ball = sum(comb(w, d) for d in range(t + 1))
                more = cost + (n * ball * PROBE_COST + n * n * share[t] * CANDIDATE_COST if t >= 0 else 0.0)
                if total + t not in new or more < new[total + t][0]:
                    new[total + t] = (more, [*chosen, t])
        best = new
    return best[radius - len(widths) + 1]


def plan(prints: DataFrame, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition with a threshold of 0 or more."""
    moments = bit_moments(prints)
    options = [group_bits(moments, n, m) for m in PARTITIONS if m <= radius + 1]
    chunks = [[g[a : a + CHUNK] for a in range(0, len(g), CHUNK)] for groups in options for g in groups]
    shares = iter(distance_shares(prints, [c for x in chunks for c in x], n))
    pieces = iter(chunks)
    costs = []
    for groups in options:
        within = []
        for _ in groups:
            d = np.ones(1)
            for _ in next(pieces):
                d = np.convolve(d, next(shares))
            within.append(np.cumsum(d))
        cost, t = allocate([len(g) for g in groups], within, n, radius)
        costs.append((cost, [(g, x) for g, x in zip(groups, t) if x >= 0]))
    return min(costs, key=lambda x: x[0])[1]


def _value(bits: list[int]) -> str:
    return " | ".join(f"shiftleft(shiftrightunsigned(f0, {b}) & 1L, {k})" for k, b in enumerate(bits))


def near_pairs(prints: DataFrame, radius: int = RADIUS, verify_radius: int = VERIFY_RADIUS) -> DataFrame:
    """(a, b), a < b: links between representatives of fingerprints that are within radius in f0 and within verify_radius over
    all bits. prints: (rep, f0, f1, f2), a row per fingerprint. Exact: every pair of different f0 is there, and those of equal
    f0 are there or joined by others."""
    seeds = K.materialise(prints.select("f0").distinct())
    n = seeds.count()
    if not n:
        return prints.sparkSession.createDataFrame([], "a bigint, b bigint")
    index, probes = [], []
    for i, (bits, t) in enumerate(plan(seeds, n, radius)):
        key = f"(({_value(bits)}) | shiftleft({i}L, 40))"
        masks = [sum(1 << b for b in some) for d in range(t + 1) for some in combinations(range(len(bits)), d)]
        index.append(f"{key}")
        probes.append(f"transform(array({', '.join(f'{x}L' for x in masks)}), m -> m ^ {key})")
    # a number of partitions given by name isn't coalesced: probes are many for each small row
    spread = max(prints.sparkSession.sparkContext.defaultParallelism, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stored = seeds.select(F.col("f0").alias("y"), F.expr(f"explode(array({', '.join(index)}))").alias("key"))
    asked = seeds.repartition(spread, "f0").select(F.col("f0").alias("x"), F.expr(f"explode(concat({', '.join(probes)}))").alias("key"))
    close = asked.join(stored.hint("shuffle_hash"), "key").where(f"x < y and bit_count(x ^ y) <= {radius}").select("x", "y").distinct()
    left = prints.select(F.col("rep").alias("a"), F.col("f0").alias("x"), F.col("f1").alias("x1"), F.col("f2").alias("x2"))
    right = prints.select(F.col("rep").alias("b"), F.col("f0").alias("y"), F.col("f1").alias("y1"), F.col("f2").alias("y2"))
    apart = "bit_count(x ^ y) + bit_count(x1 ^ y1) + bit_count(x2 ^ y2)"
    verified = close.join(left, "x").join(right, "y").where(f"{apart} <= {verify_radius}").select("a", "b")
    pairs = verified.unionAll(_equal_in_f0(prints, verify_radius))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _equal_in_f0(prints: DataFrame, verify_radius: int) -> DataFrame:
    """(a, b): links that join all fingerprints that are equal in f0 and linked over all bits. The smallest of a value is linked
    with all that are near it; only the others, which unrelated texts alone can be, are compared with the rest."""
    pivots = prints.groupBy("f0").agg(F.count("*").alias("n"), F.min(F.struct("rep", "f1", "f2")).alias("p")).where("n > 1").select(F.col("f0").alias("pf"), "p")
    apart = F.bit_count(F.col("f1").bitwiseXOR(F.col("p.f1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("p.f2")))
    beside = prints.join(pivots, prints["f0"] == pivots["pf"]).where(F.col("rep") != F.col("p.rep")).select("rep", "f0", "f1", "f2", F.col("p.rep").alias("pivot"), (apart <= verify_radius).alias("near"))
    odd = beside.where("not near").select(F.col("rep").alias("a"), F.col("f0").alias("x"), F.col("f1").alias("x1"), F.col("f2").alias("x2"))
    others = beside.select(F.col("rep").alias("b"), F.col("f0").alias("y"), F.col("f1").alias("y1"), F.col("f2").alias("y2"), "near")
    rest = odd.join(others, odd["x"] == others["y"]).where(f"(near or a < b) and bit_count(x1 ^ y1) + bit_count(x2 ^ y2) <= {verify_radius}").select("a", "b")
    return beside.where("near").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).unionAll(rest)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, verify_radius: int = VERIFY_RADIUS) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that isn't the first of its group: groups are the connected documents of
    near pairs, the smallest doc_id of a group is kept.

    Texts that are null or without a word are nobody's copies, nor are rows with a null doc_id. Rows that share a doc_id
    are one document. Equal texts always share a group; a document of a group of one has no row; extra columns are
    ignored; an empty table gives no rows.
    """
    prints = K.materialise(fingerprint_table(docs))
    reps = K.materialise(prints.groupBy("f0", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    pairs = near_pairs(reps, radius, verify_radius)
    labels = components(pairs)
    one = prints.join(reps, ["f0", "f1", "f2"]).select("doc_id", "rep")
    # ids with several texts link their groups too
    linked = one.join(labels, one["rep"] == labels["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("kept_doc_id"))
    return linked.groupBy("doc_id").agg(F.min("kept_doc_id").alias("kept_doc_id")).where("doc_id <> kept_doc_id")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows whose doc_id near_duplicates() lists; a null doc_id stays. All columns as they were."""
    gone = near_duplicates(docs, **options).select(F.col("doc_id").alias("_gone"))
    base, name = K.numbered(docs)
    return base.join(gone, F.col(name["doc_id"]).cast("bigint") == F.col("_gone"), "left_anti").toDF(*docs.columns)
