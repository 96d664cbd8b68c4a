"""Vectorised text kernels over Arrow string buffers, shared by the operators of this subpackage.

A word is a maximal run of ASCII letters, digits and non-ASCII characters after case folding. Folding covers ASCII and
the Latin-1 letters, so byte lengths and offsets never change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept, mark, new_folder, release, remove, shared_dir  # noqa: F401

CHUNK = 1 << 20
PRIME = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_word = np.zeros(256, dtype=bool)
_is_word[48:58] = _is_word[65:91] = _is_word[97:123] = True
_is_word[128:] = True
_powers: list[np.ndarray] = []


def materialise(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage is cut and a lost executor loses nothing. before, a
    table materialised in an earlier round that nothing else reads, is removed."""
    return kept(df, before)


def only(rows: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name, whatever else rows has; of equal names the first."""
    apart = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    return apart.select(*(F.col(f"c{rows.columns.index(n)}").alias(n) for n in names))


def numbered(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """rows with its columns called c0, c1, ..., so that no other name can clash, and the place of each name; toDF(*rows.columns)
    brings the names back."""
    names = [f"c{i}" for i in range(len(rows.columns))]
    return rows.toDF(*names), dict(reversed(list(zip(rows.columns, names))))


def integer_id(df: DataFrame, name: str) -> Column:
    """The id column as bigint; a missing column is an error, a null stays null."""
    return F.col(f"`{name}`").cast("bigint").alias(name)


def slices(batches: Iterator[pa.RecordBatch], column: str | int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most max_bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, without a copy; nulls count as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes; lengths stay."""
    out = _lower[data]
    at = np.flatnonzero(data == 0xC3)
    at = at[at + 1 < len(data)] + 1
    low = data[at]
    up = (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
    out[at[up]] = low[up] + 0x20
    return out


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, number of words before each text and in all) of every word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = _is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        with np.errstate(over="ignore"):
            for p in (PRIME, pow(PRIME, -1, 1 << 64)):
                table = np.full(CHUNK + 1, p, dtype=np.uint64)
                table[0] = 1
                _powers.append(np.cumprod(table))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span (spans ascend and don't overlap); equal bytes have equal hashes anywhere."""
    out = np.zeros(len(start), np.uint64)
    power, inverse = _power_tables()
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            lo = int(start[i])
            j = int(np.searchsorted(end, lo + CHUNK, side="right"))
            if j <= i:  # one span longer than the tables: add its pieces
                total = 0
                for at in range(lo, int(end[i]), CHUNK):
                    piece = data[at : min(at + CHUNK, int(end[i]))].astype(np.uint64) + np.uint64(1)
                    total += int((piece * power[: len(piece)]).sum(dtype=np.uint64)) * pow(PRIME, at - lo, 1 << 64)
                out[i] = np.uint64(total & MASK)
                i += 1
                continue
            hi = int(end[j - 1])
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * inverse[s]
            i = j
    return mix(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last, number of words before each text and in all) of an array of texts."""
    data, off = flat(column)
    data = fold(data)
    start, end, first = word_spans(data, off)
    return span_hashes(data, start, end), start, end, first


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each key among sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)
