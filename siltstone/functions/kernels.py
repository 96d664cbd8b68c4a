"""NumPy kernels over Arrow byte columns: block statistics, run lengths, content-defined cuts and lane routing.

A kernel sees the bytes of many rows at once, so that its cost is that of a few passes over the batch.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Domain of the table of gear values.
GEAR_DOMAIN = b"siltstone/gear/1/"
WORK_BYTES = 4 << 20
STANDARD, DELTA4, HIGH = 0, 1, 2
LANES = ("standard", "delta4", "high_entropy")
FEATURES = ("entropy_bits_per_byte", "byte_repetition_ratio", "substring_repetition_ratio", "delta_smoothness_ratio", "ascii_ratio", "zero_ratio", "small_symbol_ratio")
_ascii = np.zeros(256, bool)
_ascii[[9, 10, 13]] = True
_ascii[32:127] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the rows) of a string or binary column, nulls as empty rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def rows_of(data: np.ndarray | bytes, off: np.ndarray) -> pa.Array:
    """A binary column of the rows between offsets, without a copy of the bytes."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])


def pieces(batches: Iterator[pa.RecordBatch], at: int, most: int = WORK_BYTES, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded bytes and rows; a longer row is alone in its batch."""
    for batch in batches:
        _, off = buffers(batch.column(at))
        a = 0
        while a < batch.num_rows:
            b = min(a + rows, max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1))
            yield batch.slice(a, b - a)
            a = b


def _entropy(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    p = counts / np.maximum(total, 1)[:, None]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)


def histogram(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of every byte value, a row for each input row."""
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    return np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)


def run_pairs(data: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many (length, byte) pairs with lengths up to 255 each row takes."""
    if not len(data):
        return np.zeros(n, np.int64)
    start = np.flatnonzero(np.r_[True, (data[1:] != data[:-1]) | (owner[1:] != owner[:-1])])
    length = np.diff(np.r_[start, len(data)])
    return np.bincount(owner[start], weights=-(-length // 255), minlength=n).astype(np.int64)


def statistics(data: np.ndarray, off: np.ndarray, wanted: set[str] | None = None) -> dict[str, np.ndarray]:
    """Every block statistic by name, or size and the wanted ones; all are 0 for an empty row."""
    n, size = len(off) - 1, np.diff(off)
    owner = np.repeat(np.arange(n), size)
    some = np.maximum(size, 1)
    need = lambda *names: wanted is None or any(x in wanted for x in names)
    random = need("random_looking")
    out = {"size": size}
    if random or need("entropy_bits_per_byte", "byte_repetition_ratio", "ascii_ratio", "zero_ratio", "small_symbol_ratio"):
        counts = histogram(data, off)
        out["entropy_bits_per_byte"] = _entropy(counts, size)
        out["byte_repetition_ratio"] = np.where(size > 0, 1 - (counts > 0).sum(axis=1) / some, 0.0)
        out["ascii_ratio"] = counts[:, _ascii].sum(axis=1) / some
        out["zero_ratio"] = counts[:, 0] / some
        out["small_symbol_ratio"] = counts[:, :16].sum(axis=1) / some
    if random or need("delta_smoothness_ratio", "delta8_size"):
        near = np.flatnonzero(owner[1:] == owner[:-1])
        delta = data[near + 1] - data[near]  # wraps
        if random or need("delta_smoothness_ratio"):
            smooth = np.bincount(owner[near], weights=(delta <= 3) | (delta >= 253), minlength=n)
            out["delta_smoothness_ratio"] = np.where(size > 1, smooth / np.maximum(size - 1, 1), 0.0)
        if need("delta8_size"):
            out["delta8_size"] = (size > 0) + 2 * run_pairs(delta, owner[near], n)
    if need("delta4_entropy"):
        far = np.flatnonzero(owner[4:] == owner[:-4])
        wide = np.bincount(owner[far] * 256 + (data[far + 4] - data[far]), minlength=n * 256).reshape(n, 256)
        out["delta4_entropy"] = _entropy(wide, size - 4)
    if random or need("substring_repetition_ratio"):
        stride = np.maximum(1, (size - 3) // 4096)
        begin = np.flatnonzero(owner[3:] == owner[:-3]) if len(data) > 3 else np.zeros(0, np.int64)
        begin = begin[(begin - off[owner[begin]]) % stride[owner[begin]] == 0]
        grams = np.bincount(owner[begin], minlength=n)
        kinds = np.zeros(n, np.int64)
        if len(begin):
            x = data.astype(np.int64)
            keys = (owner[begin] << 32) | (x[begin] << 24) | (x[begin + 1] << 16) | (x[begin + 2] << 8) | x[begin + 3]
            keys.sort()
            kinds = np.bincount(keys[np.concatenate([[True], keys[1:] != keys[:-1]])] >> 32, minlength=n)
        out["substring_repetition_ratio"] = np.where(size >= 8, 1 - kinds / np.maximum(grams, 1), 0.0)
    if need("rle_size"):
        out["rle_size"] = 2 * run_pairs(data, owner, n)
    if random:
        out["random_looking"] = (size >= 1024) & (out["entropy_bits_per_byte"] >= 7.85) & (out["substring_repetition_ratio"] <= 0.02) & (out["delta_smoothness_ratio"] <= 0.08)
    return out


def exact_lanes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The lane of each row from its exact entropies."""
    h = stats["entropy_bits_per_byte"]
    return np.where(h >= 7.75, HIGH, np.where((h >= 3) & (h - stats["delta4_entropy"] >= 2) & (stats["size"] > 0), DELTA4, STANDARD))


def _h(values: np.ndarray) -> float:
    count = np.bincount(values, minlength=256)
    p = count[count > 0] / max(len(values), 1)
    return float(-(p * np.log2(p)).sum())


def sampled_lane(block: bytes) -> int:
    """The lane of one block; over 8192 delta observations, 15 windows decide unless they are ambiguous."""
    x = np.frombuffer(block, np.uint8)
    if not len(x):
        return STANDARD
    h = _h(x)
    if h >= 7.75:
        return HIGH
    if h < 3:
        return STANDARD
    if len(x) - 4 > 8192:
        seed, parts, per = int.from_bytes(hashlib.sha256(block).digest()[:8], "big"), 15, 273 + 4
        lows, windows, deltas = [], [], []
        for k in range(parts):
            a, b = k * len(x) // parts, (k + 1) * len(x) // parts
            seed = (seed + 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
            at = a + seed % (b - a - per + 1)
            windows.append(x[at : at + per])
            deltas.append(windows[-1][4:] - windows[-1][:-4])
            lows.append(_h(windows[-1]) - _h(deltas[-1]))
        if max(lows) - min(lows) <= 1 and abs(h - _h(np.concatenate(windows))) <= 1:
            gain = h - _h(np.concatenate(deltas))
            if abs(gain - 2) >= 0.25:
                return DELTA4 if gain > 2 else STANDARD
    return DELTA4 if h - (_h(x[4:] - x[:-4]) if len(x) > 4 else 0.0) >= 2 else STANDARD


@cache
def gear(average: int, domain: bytes = GEAR_DOMAIN) -> np.ndarray:
    """The gear value of each byte, below average."""
    return np.array([int.from_bytes(hashlib.sha256(domain + bytes((b,))).digest()[:4], "big") % average for b in range(256)], np.int64)


def check_sizes(least: int, average: int, most: int) -> None:
    if least < 64 or average & (average - 1) or not least <= average <= most or most > 16 << 20:
        raise ValueError("chunk sizes need 64 <= least <= average <= most <= 16 MiB and an average that is a power of two")


#: Bytes whose fingerprints are worked out at once; they stay in a core's cache.
TILE_BYTES = 1 << 17


def _prints(data: np.ndarray, average: int) -> tuple[list[int], bytes]:
    """(places where a full window's fingerprint is 0, for each place the least count of bytes from it, fewer than a window, whose
    fingerprint is 0, else 0). Fingerprints are held in the high bits, where those beyond the average drop out."""
    window, n = average.bit_length() - 1, len(data)
    kind, bits = (np.uint16, 16) if window <= 16 else (np.uint32, 32)
    table = (gear(average) << (bits - window)).astype(kind)
    short, hits = np.zeros(n, np.uint8), []
    for a in range(0, n, TILE_BYTES):
        begin = max(0, a - window + 1)
        value = table[data[begin : a + TILE_BYTES]]
        full = value.copy()
        for j in range(window):
            if j:
                value <<= 1
                full[j:] ^= value[:-j]
            found = np.flatnonzero(full == 0) + begin
            found = found[found >= max(a, j)]
            if j == window - 1:
                hits += found.tolist()
            else:
                found -= j
                short[found[short[found] == 0]] = j + 1
    return hits, short.tobytes()


def cuts_many(data: np.ndarray, off: np.ndarray, least: int, average: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the content-defined chunks of every row, as places in data; how many each row has). A cut's fingerprint covers the
    last log2(average) bytes, so it is found for all places at once, also where fewer bytes follow the least size; only the cuts
    are looked at singly. No window reaches back over a chunk's least size, so rows don't mix."""
    hits, short = _prints(data, average)
    beyond, ends, counts, k = average.bit_length() - 2, [], [], 0
    off = off.tolist()
    for at, n in zip(off, off[1:]):
        had = len(ends)
        while at < n:
            first, stop = at + least - 1, min(n, at + most)
            if first >= n:
                at = n
            elif (few := short[first]) and first + few <= stop:
                at = first + few
            else:
                k = bisect_left(hits, first + beyond, k)
                at = hits[k] + 1 if k < len(hits) and hits[k] < stop else stop
            ends.append(at)
        counts.append(len(ends) - had)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def cuts(data: np.ndarray, least: int, average: int, most: int) -> list[int]:
    """Ends of the content-defined chunks of one stream."""
    return cuts_many(data, np.array([0, len(data)]), least, average, most)[0].tolist()


def balanced_candidates(smoothness: float, size: int, entropy: float) -> list[str]:
    names = ["RAW", "RLE", "DEFLATE"]
    if smoothness >= 0.55:
        names.insert(2, "DELTA8")
    if size >= 256 and entropy < 7.75:
        names.insert(-1, "BYTE_RANS")
    return names


def type7(values: list[float], share: float) -> float:
    """Linearly interpolated percentile (the seventh definition)."""
    x = sorted(values)
    at = (len(x) - 1) * share
    low = math.floor(at)
    return x[low] if low == at else x[low] + (at - low) * (x[low + 1] - x[low])
