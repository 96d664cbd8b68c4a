"""Lossless block codecs behind one registry, and the transforms that lanes use.

Each codec is a pair encode(bytes) -> bytes, decode(bytes, size) -> bytes; a payload that doesn't decode to exactly size
bytes raises Malformed. Ties between candidates go to the first in registry order.
"""

from __future__ import annotations

import lzma
import math
import random
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import zstandard


class Malformed(ValueError):
    """A payload that no encoder wrote."""


class Codec(NamedTuple):
    number: int
    encode: Callable[[bytes], bytes]
    decode: Callable[[bytes, int], bytes]


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise Malformed(what)


def rle_encode(block: bytes) -> bytes:
    x = np.frombuffer(block, np.uint8)
    if not len(x):
        return b""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    length = np.diff(np.r_[start, len(x)])
    full, rest = length // 255, length % 255
    parts = full + (rest > 0)
    out = np.empty((int(parts.sum()), 2), np.uint8)
    out[:, 0], out[:, 1] = 255, np.repeat(x[start], parts)
    last = np.cumsum(parts) - 1
    out[last[rest > 0], 0] = rest[rest > 0]
    return out.tobytes()


def rle_decode(payload: bytes, size: int) -> bytes:
    _need(len(payload) % 2 == 0, "half a run")
    x = np.frombuffer(payload, np.uint8).reshape(-1, 2)
    _need(bool((x[:, 0] > 0).all()), "an empty run")
    _need(int(x[:, 0].sum(dtype=np.int64)) == size, "runs of another size")
    return np.repeat(x[:, 1], x[:, 0]).tobytes()


def delta8_encode(block: bytes) -> bytes:
    return block[:1] + rle_encode(np.diff(np.frombuffer(block, np.uint8)).tobytes()) if block else b""


def delta8_decode(payload: bytes, size: int) -> bytes:
    if not size:
        _need(not payload, "bytes for an empty block")
        return b""
    _need(len(payload) > 0, "no first byte")
    steps = np.frombuffer(rle_decode(payload[1:], size - 1), np.uint8)
    return np.cumsum(np.r_[np.uint8(payload[0]), steps], dtype=np.uint8).tobytes()


SCALE = 1 << 12
LOW = 1 << 23


def frequencies(counts: dict[int, int]) -> dict[int, int]:
    """Counts scaled to a sum of 4096, each at least 1; largest remainders gain, largest frequencies give."""
    total = sum(counts.values())
    f = {s: max(1, c * SCALE // total) for s, c in counts.items()}
    spare = SCALE - sum(f.values())
    if spare > 0:
        order = sorted(f, key=lambda s: (-(counts[s] * SCALE % total), s))
        for k in range(spare):
            f[order[k % len(order)]] += 1
    order, k = sorted(f, key=lambda s: (-f[s], s)) if spare < 0 else [], 0
    while spare < 0:
        s = order[k % len(order)]
        k += 1
        if f[s] > 1:
            f[s] -= 1
            spare += 1
    return f


def _starts(f: dict[int, int]) -> dict[int, int]:
    out, at = {}, 0
    for s in sorted(f):
        out[s] = at
        at += f[s]
    _need(at == SCALE, "frequencies of another sum")
    return out


#: Steps that are looked up at once, and lanes below which lanes are coded singly.
RANS_STEPS, RANS_LANES = 64, 100


def _rans_rest(x: int, tail: bytearray, rest: bytes, f: dict[int, int], starts: dict[int, int]) -> int:
    """The state after rest, coded from its end; tail gets what the state gives off."""
    table = {s: (f[s], SCALE - f[s], starts[s], (LOW // SCALE << 8) * f[s]) for s in f}
    for byte in rest[::-1]:
        n, more, start, top = table[byte]
        while x >= top:
            tail.append(x & 255)
            x >>= 8
        x += x // n * more + start
    return x


def rans_encode_many(blocks: list[bytes]) -> list[bytes]:
    """BYTE_RANS payloads of many blocks, a lane each: a step codes a byte of every block that has one left, the longest blocks
    first. Numbers are whole and below 2 ** 31 and divisors at most 4096, so the floors of float64 quotients are exact."""
    order = sorted((k for k, b in enumerate(blocks) if b), key=lambda k: -len(blocks[k]))
    out, lanes = [b""] * len(blocks), len(order)
    if not lanes:
        return out
    tables = []
    freq, first = np.ones((lanes, 256)), np.zeros((lanes, 256))
    for row, k in enumerate(order):
        counts = np.bincount(np.frombuffer(blocks[k], np.uint8), minlength=256)
        symbols = np.flatnonzero(counts)
        f = frequencies(dict(zip(symbols.tolist(), counts[symbols].tolist())))
        starts = _starts(f)
        freq[row, symbols] = list(f.values())
        first[row, symbols] = list(starts.values())
        tables.append((f, starts))
    size = np.array([len(blocks[k]) for k in order])
    data = np.frombuffer(b"".join(blocks[k] for k in order), np.uint8)
    last = np.cumsum(size) - 1
    state, tails, done, live = np.full(lanes, float(LOW)), [bytearray() for _ in order], 0, lanes
    while True:
        live = int(np.searchsorted(-size, -done))  # lanes with more than done bytes
        if live < RANS_LANES:
            break
        steps = min(RANS_STEPS, int(size[RANS_LANES - 1]) - done)
        left = np.searchsorted(-size, -(done + np.arange(steps))).tolist()
        at = np.maximum(last[:live] - done - np.arange(steps)[:, None], 0)
        cell = np.arange(live) * 256 + data[at]
        f, start = freq.ravel()[cell], first.ravel()[cell]
        top, more = f * (LOW // SCALE << 8), SCALE - f
        given, mask = np.zeros((steps, 2, live), np.uint8), np.zeros((steps, 2, live), bool)
        for k, m in enumerate(left):
            x, high = state[:m], top[k, :m]
            for turn in (0, 1):
                over = np.greater_equal(x, high, out=mask[k, turn, :m])
                if turn and not over.any():
                    break
                q = np.floor(x * (1 / 256))
                given[k, turn, :m] = x - q * 256
                np.copyto(x, q, where=over)
            q = np.floor(x / f[k, :m])
            q *= more[k, :m]
            x += q
            x += start[k, :m]
        by_lane = mask.transpose(2, 0, 1)
        ends = np.cumsum(by_lane.sum(axis=(1, 2))).tolist()
        flat, a = given.transpose(2, 0, 1)[by_lane].tobytes(), 0
        for tail, b in zip(tails, ends):
            tail += flat[a:b]
            a = b
        done += steps
    for row, k in enumerate(order):
        f, starts = tables[row]
        x = int(state[row])
        if size[row] > done:
            x = _rans_rest(x, tails[row], blocks[k][: int(size[row]) - done], f, starts)
        tails[row].reverse()
        head = b"".join(struct.pack(">BH", s, f[s]) for s in sorted(f))
        out[k] = struct.pack(">H", len(f)) + head + struct.pack("<I", x) + bytes(tails[row])
    return out


def rans_encode(block: bytes) -> bytes:
    return rans_encode_many([block])[0]


def rans_decode(payload: bytes, size: int) -> bytes:
    if not size:
        _need(not payload, "bytes for an empty block")
        return b""
    _need(len(payload) >= 2, "no symbol count")
    kinds = int.from_bytes(payload[:2], "big")
    at = 2 + 3 * kinds
    _need(1 <= kinds <= 256 and len(payload) >= at + 4, "a cut table")
    pairs = list(struct.iter_unpack(">BH", payload[2:at]))
    f = dict(pairs)
    _need(len(f) == kinds and all(f.values()), "a bad table")
    starts = _starts(f)
    symbol = b"".join(bytes([s]) * f[s] for s in sorted(f))
    x = int.from_bytes(payload[at : at + 4], "little")
    _need(x >= LOW, "a low state")
    at += 4
    out = bytearray(size)
    for i in range(size):
        slot = x % SCALE
        s = out[i] = symbol[slot]
        x = f[s] * (x // SCALE) + slot - starts[s]
        while x < LOW:
            _need(at < len(payload), "a cut stream")
            x = x << 8 | payload[at]
            at += 1
    _need(at == len(payload) and x == LOW, "a trailing state")
    return bytes(out)


def deflate_encode(block: bytes) -> bytes:
    return zlib.compress(block, 6) if block else b""


def deflate_decode(payload: bytes, size: int) -> bytes:
    if not size:
        _need(not payload, "bytes for an empty block")
        return b""
    reader = zlib.decompressobj()
    try:
        out = reader.decompress(payload, size + 1)
    except zlib.error as e:
        raise Malformed(str(e)) from e
    _need(len(out) == size and reader.eof and not reader.unused_data, "another size or trailing bytes")
    return out


class Parser:
    """Greedy parses of many blocks. Where a match begins and which places can be its source follows from sorted grams of all
    blocks at once; only the places where a match is taken are looked at singly."""

    def __init__(self, blocks: list[bytes]):
        self.text = b"".join(blocks)
        self.ends = np.cumsum([len(b) for b in blocks], dtype=np.int64)
        x = np.frombuffer(self.text, np.uint8).astype(np.int64)
        self.begin = np.repeat(self.ends - [len(b) for b in blocks], [len(b) for b in blocks])
        self.end = np.repeat(self.ends, [len(b) for b in blocks])
        n = len(x)
        x = np.r_[x, np.zeros(8, np.int64)]
        three = x[:n] << 16 | x[1 : n + 1] << 8 | x[2 : n + 2]
        self.rank = np.empty(n, np.int32)  # places in the order of three bytes and of place: near places of the same bytes are near
        self.rank[_places(three, 24)] = np.arange(n, dtype=np.int32)
        four = three << 8 | x[3 : n + 3]
        order = _places(four, 32)
        key = four[order]
        self.four = np.empty(n, np.int64)
        self.four[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])[:n]

    def sources(self, least: int, tried: int) -> np.ndarray:
        """For each place the last place before it with the same least bytes (4 to 8) in its block, if it is less than 65536
        bytes back and among the last `tried` with the same three bytes; -1 if there is none."""
        n = len(self.four)
        bits = n.bit_length()
        key = self.four << bits | np.r_[self.four, np.zeros(4, np.int64)][least - 4 : n + least - 4]
        order = _places(key, 2 * bits)
        key = key[order]
        source = np.full(n, -1, np.int64)
        same = np.flatnonzero(key[1:] == key[:-1])
        source[order[same + 1]] = order[same]
        place = np.arange(n)
        ok = (source >= self.begin) & (place - source <= 65535) & (place + least <= self.end)
        ok &= self.rank - self.rank[source] <= tried
        source[~ok] = -1
        return source.astype(np.int32)

    def matches(self, least: int, tried: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block the greedy parse's matches (position, length, distance): the latest `tried` places with the same three
        bytes are compared, the longest match wins, the nearest of equals."""
        if not self.text:
            yield from ((np.zeros(0, np.int64),) * 3 for _ in self.ends)
            return
        source = self.sources(least, tried)
        found = np.flatnonzero(source >= 0)
        best, far = self._longest(source, found, tried)
        following = np.r_[found, len(source)][np.searchsorted(found, np.arange(len(source) + 1))]
        text, source, rank, begin = self.text, memoryview(source), memoryview(self.rank), 0
        size_at, far_at, next_ = memoryview(best), memoryview(far), memoryview(following)
        for end in self.ends.tolist():
            out, at = [], next_[begin]
            while at < end:
                if size_at[at] == LONG:
                    size_at[at], far_at[at] = _longest_at(text, source, rank, at, end, tried)
                out.append(at)
                at = next_[at + size_at[at]]
            out = np.array(out, np.int64)
            yield out - begin, best[out].astype(np.int64), far[out].astype(np.int64)
            begin = end

    def _longest(self, source: np.ndarray, found: np.ndarray, tried: int) -> tuple[np.ndarray, np.ndarray]:
        """Length and distance of the longest match at every found place; LONG where one has 27 bytes or more, to be looked at
        if the parse comes there."""
        data = np.frombuffer(self.text + bytes(48), np.uint8)
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        at, old = found.astype(np.int32), source[found]
        best, far = np.zeros(len(source), np.int32), np.zeros(len(source), np.int32)
        while len(at):
            longest = best[at]
            some = np.flatnonzero(data[at + longest] == data[old + longest])
            a, b, n = at[some], old[some], np.full(len(some), 3, np.int32)
            go = np.arange(len(some))
            for done in (3, 11, 19):
                unlike = words[a[go] + done] ^ words[b[go] + done]
                n[go] += np.bitwise_count((unlike & -unlike) - np.uint64(1)).astype(np.int32) >> 3  # 8 for equal words
                go = go[unlike == 0]
            n = np.minimum(n, self.end[a] - a)
            n[n >= 27] = LONG
            more = np.flatnonzero(n > longest[some])
            best[a[more]], far[a[more]] = n[more], a[more] - b[more]
            old = source[old]
            on = np.flatnonzero((best[at] < LONG) & (old >= 0) & (at - old <= 65535) & (self.rank[at] - self.rank[old] <= tried))
            at, old = at[on], old[on]
        return best, far

    def parses(self, least: int, tried: int) -> Iterator[list[tuple[int, int, int]]]:
        """For each block (literal bytes from, to, 0) and (position, length, distance), see matches."""
        sizes = np.diff(self.ends, prepend=0).tolist()
        for size, found in zip(sizes, self.matches(least, tried)):
            out, open_ = [], 0
            for at, length, far in zip(*(x.tolist() for x in found)):
                if open_ < at:
                    out.append((open_, at, 0))
                out.append((at, length, far))
                open_ = at + length
            if open_ < size:
                out.append((open_, size, 0))
            yield out


#: Length that stands for a match of 27 bytes or more that hasn't been measured.
LONG = 1 << 30


def _longest_at(text: bytes, source: memoryview, rank: memoryview, at: int, end: int, tried: int) -> tuple[int, int]:
    limit, best, far, old, oldest = min(65535, end - at), 0, 0, source[at], rank[at] - tried
    while old >= 0 and at - old <= 65535 and rank[old] >= oldest:
        if not best or text[old + best] == text[at + best]:
            size = _common(text, old, at, limit)
            if size > best:
                best, far = size, at - old
                if size == limit:
                    break
        old = source[old]
    return best, far


def _places(key: np.ndarray, bits: int) -> np.ndarray:
    """The places of keys below 2 ** bits in the order of the keys, equal keys in the order of place."""
    low = len(key).bit_length()
    if bits + low > 63:
        return np.argsort(key, kind="stable")
    packed = key << low | np.arange(len(key))
    packed.sort()
    return packed & ((1 << low) - 1)


def _common(block: bytes, old: int, at: int, limit: int) -> int:
    """Length of the match of the text at `at` with the text at `old`, which may run into itself."""
    done, step = 3, 16
    while done < limit:
        take = min(step, limit - done)
        a, b = block[old + done : old + done + take], block[at + done : at + done + take]
        if a != b:
            unlike = int.from_bytes(a, "little") ^ int.from_bytes(b, "little")
            return done + ((unlike & -unlike).bit_length() - 1) // 8
        done += take
        step = min(step * 2, 4096)
    return done


def lz_encode_many(blocks: list[bytes], parser: Parser | None = None) -> list[bytes]:
    found = []
    for block, parse in zip(blocks, (parser or Parser(blocks)).parses(6, 32)):
        out = bytearray()
        for a, b, far in parse:
            if far:
                out += struct.pack(">BHH", 1, far, b)
            else:
                for k in range(a, b, 65535):
                    piece = block[k : min(b, k + 65535)]
                    out += struct.pack(">BH", 0, len(piece)) + piece
        found.append(bytes(out))
    return found


def lz_encode(block: bytes) -> bytes:
    return lz_encode_many([block])[0]


def _copy(out: bytearray, far: int, length: int, size: int) -> None:
    _need(0 < far <= len(out) and len(out) + length <= size, "a match out of range")
    piece = bytes(out[-far:])
    out += (piece * (length // far + 1))[:length]


def lz_decode(payload: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(payload):
        kind = payload[at]
        _need(kind in (0, 1) and len(payload) >= at + (5 if kind else 3), "a bad token")
        if kind:
            far, length = struct.unpack_from(">HH", payload, at + 1)
            _need(length >= 6, "a short match")
            _copy(out, far, length, size)
            at += 5
        else:
            (length,) = struct.unpack_from(">H", payload, at + 1)
            at += 3
            _need(0 < length <= len(payload) - at and len(out) + length <= size, "bad literals")
            out += payload[at : at + length]
            at += length
    _need(len(out) == size, "another size")
    return bytes(out)


def varint(value: int) -> bytes:
    """Little-endian base-128 with a continuation bit."""
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def varints(data: bytes, count: int) -> list[int]:
    out, at = [], 0
    for _ in range(count):
        value = shift = 0
        while True:
            _need(at < len(data) and shift <= 28, "a cut number")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        out.append(value)
    _need(at == len(data), "numbers to spare")
    return out


def zigzag(value: int) -> int:
    return value * 2 if value >= 0 else -value * 2 - 1


def unzigzag(value: int) -> int:
    return value // 2 if value % 2 == 0 else -(value + 1) // 2


def _varint_bytes(values: np.ndarray) -> bytes:
    """varint of each value, which is not negative and below 2 ** 35."""
    parts = values[:, None] >> np.arange(0, 35, 7)
    used = parts > 0
    used[:, 0] = True
    coded = parts & 127
    coded[:, :-1] |= used[:, 1:].astype(np.int64) << 7
    return coded.astype(np.uint8)[used].tobytes()


def lz_rans_streams(block: bytes, matches: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The streams of a parse: tokens, literals, literal lengths, match lengths, distances."""
    at, length, far = matches
    begin, end = np.r_[0, at + length], np.r_[at, len(block)]
    run = end - begin
    tokens = np.ones((len(run), 2), np.uint8)
    tokens[:, 0] = 0
    used = np.ones((len(run), 2), bool)
    used[:, 0], used[-1, 1] = run > 0, False
    literal = b"".join([block[a:b] for a, b in zip(begin.tolist(), end.tolist())])
    return [tokens[used].tobytes(), literal, _varint_bytes(run[run > 0]), _varint_bytes(length), _varint_bytes(far)]


def lz_rans_join(streams: list[bytes], coded: list[bytes]) -> bytes:
    lengths = [x for raw, c in zip(streams, coded) for x in (len(raw), len(c))]
    return b"LZR1" + struct.pack(">10I", *lengths) + b"".join(coded)


def lz_rans_encode(block: bytes) -> bytes:
    if not block:
        return b""
    streams = lz_rans_streams(block, next(Parser([block]).matches(4, 64)))
    return lz_rans_join(streams, [rans_encode(s) for s in streams])


def lz_rans_decode(payload: bytes, size: int) -> bytes:
    if not size:
        _need(not payload, "bytes for an empty block")
        return b""
    _need(len(payload) >= 44 and payload[:4] == b"LZR1", "a bad head")
    lengths = struct.unpack(">10I", payload[4:44])
    _need(max(lengths[::2]) <= size and sum(lengths[1::2]) == len(payload) - 44, "bad stream sizes")
    streams, at = [], 44
    for raw, coded in zip(lengths[::2], lengths[1::2]):
        streams.append(rans_decode(payload[at : at + coded], raw))
        at += coded
    tokens, literals = streams[:2]
    matches = tokens.count(1)
    _need(set(tokens) <= {0, 1}, "a bad token")
    runs, sizes, fars = (iter(varints(s, n)) for s, n in zip(streams[2:], (len(tokens) - matches, matches, matches)))
    out, used = bytearray(), 0
    for token in tokens:
        if token:
            length = next(sizes)
            _need(length >= 4, "a short match")
            _copy(out, next(fars), length, size)
        else:
            length = next(runs)
            _need(0 < length <= len(literals) - used and len(out) + length <= size, "bad literals")
            out += literals[used : used + length]
            used += length
    _need(used == len(literals) and len(out) == size, "another size")
    return bytes(out)


def raw_decode(payload: bytes, size: int) -> bytes:
    _need(len(payload) == size, "another size")
    return payload


CODECS: dict[str, Codec] = {
    "RAW": Codec(0, lambda b: b, raw_decode),
    "RLE": Codec(1, rle_encode, rle_decode),
    "DELTA8": Codec(2, delta8_encode, delta8_decode),
    "LZ_SIMPLE": Codec(3, lz_encode, lz_decode),
    "BYTE_RANS": Codec(4, rans_encode, rans_decode),
    "DEFLATE": Codec(5, deflate_encode, deflate_decode),
    "LZ_RANS": Codec(6, lz_rans_encode, lz_rans_decode),
}


#: Bytes of blocks that are parsed at once; a parser takes about 100 times that.
PARSED_BYTES = 1 << 17


def _parsed(blocks: list[bytes]) -> Iterator[tuple[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each block its LZ_SIMPLE payload, and its matches for LZ_RANS."""
    a = size = 0
    for b, block in enumerate(blocks, 1):
        size += len(block)
        if b == len(blocks) or size + len(blocks[b]) > PARSED_BYTES:
            parser = Parser(blocks[a:b])
            yield from zip(lz_encode_many(blocks[a:b], parser), parser.matches(4, 64))
            a, size = b, 0


def encode_all(blocks: list[bytes]) -> dict[str, list[bytes]]:
    """The payloads of all codecs by name; what the two parses share is worked out once, and all rANS streams are coded together."""
    simple, streams = [], []
    for block, (payload, matches) in zip(blocks, _parsed(blocks)):
        simple.append(payload)
        streams.append(lz_rans_streams(block, matches) if block else [])
    coded = rans_encode_many(blocks + [s for each in streams for s in each])
    at, joined = len(blocks), []
    for each in streams:
        joined.append(lz_rans_join(each, coded[at : at + len(each)]) if each else b"")
        at += len(each)
    many = {"LZ_SIMPLE": simple, "BYTE_RANS": coded[: len(blocks)], "LZ_RANS": joined}
    return {n: many[n] if n in many else [c.encode(b) for b in blocks] for n, c in CODECS.items()}


def rans_least(block: bytes) -> int:
    """A size that BYTE_RANS never goes below: its table, its state, and the bits of the scaled frequencies less what the state
    holds."""
    if not block:
        return 0
    counts = np.bincount(np.frombuffer(block, np.uint8), minlength=256)
    f = frequencies({s: c for s, c in enumerate(counts.tolist()) if c})
    bits = sum(int(counts[s]) * (12 - math.log2(n)) for s, n in f.items())
    return 6 + 3 * len(f) + max(0, math.ceil((bits - 8 - 1e-6 * len(block)) / 8) - 1)


def smallest_many(blocks: list[bytes], names: list[list[str] | None]) -> list[tuple[str, bytes]]:
    """For each block (codec, payload) with the shortest payload among its named codecs, all for None; the first of the registry
    of equals. What ends in rANS isn't tried where another payload is below the least that it can give."""
    wanted = [set(CODECS) if x is None else set(x) for x in names]
    tried = [{n: c.encode(b) for n, c in CODECS.items() if n in w and n not in ("LZ_SIMPLE", "BYTE_RANS", "LZ_RANS")} for b, w in zip(blocks, wanted)]
    parsed, maybe, joined = [k for k, w in enumerate(wanted) if w & {"LZ_SIMPLE", "LZ_RANS"}], [], []
    for k, (payload, matches) in zip(parsed, _parsed([blocks[k] for k in parsed])):
        if "LZ_SIMPLE" in wanted[k]:
            tried[k]["LZ_SIMPLE"] = payload
        if "LZ_RANS" in wanted[k]:
            maybe.append((k, matches))
    least = [min(map(len, t.values()), default=math.inf) for t in tried]
    plain = [k for k, (b, w) in enumerate(zip(blocks, wanted)) if "BYTE_RANS" in w and rans_least(b) <= least[k]]
    for k, matches in maybe:
        streams = lz_rans_streams(blocks[k], matches) if blocks[k] else []
        if not streams or 44 + rans_least(streams[1]) <= least[k] and 44 + sum(map(rans_least, streams)) <= least[k]:
            joined.append((k, streams))
    coded = rans_encode_many([blocks[k] for k in plain] + [s for _, each in joined for s in each])
    for k, payload in zip(plain, coded):
        tried[k]["BYTE_RANS"] = payload
    at = len(plain)
    for k, each in joined:
        tried[k]["LZ_RANS"] = lz_rans_join(each, coded[at : at + len(each)]) if each else b""
        at += len(each)
    best = [min((n for n in CODECS if n in t), key=lambda n: len(t[n])) for t in tried]
    return [(n, t[n]) for n, t in zip(best, tried)]


def smallest(block: bytes, names: list[str] | None = None) -> tuple[str, bytes]:
    """smallest_many of one block."""
    return smallest_many([block], [names])[0]


def delta4(block: bytes) -> bytes:
    x = np.frombuffer(block, np.uint8)
    return np.r_[x[:4], x[4:] - x[:-4]].tobytes()


def undelta4(block: bytes) -> bytes:
    x = np.frombuffer(block, np.uint8).copy()
    for k in range(4):
        x[k::4] = np.cumsum(x[k::4], dtype=np.uint8)
    return x.tobytes()


_standard = [{"id": lzma.FILTER_LZMA2, "preset": 6, "nice_len": 48, "depth": 12}]
_delta = [{"id": lzma.FILTER_DELTA, "dist": 4}, {"id": lzma.FILTER_LZMA2, "preset": 5}]


def lane_encode(data: bytes, lane: int) -> bytes:
    """One lane's bytes: LZMA2, LZMA2 over 4-byte deltas, or zstd level 1; a first byte 0 where storing is no longer."""
    if not data:
        return b""
    coded = zstandard.ZstdCompressor(level=1).compress(data) if lane == 2 else lzma.compress(data, lzma.FORMAT_RAW, filters=_delta if lane else _standard)
    return b"\1" + coded if len(coded) < len(data) else b"\0" + data


def lane_decode(payload: bytes, lane: int) -> bytes:
    if not payload:
        return b""
    if payload[0] == 0:
        return payload[1:]
    _need(payload[0] == 1, "a bad lane head")
    try:
        return zstandard.ZstdDecompressor().decompress(payload[1:]) if lane == 2 else lzma.decompress(payload[1:], lzma.FORMAT_RAW, filters=_delta if lane else _standard)
    except (lzma.LZMAError, zstandard.ZstdError) as e:
        raise Malformed(str(e)) from e


def mutate(payload: bytes, seed: int, case: int) -> bytes:
    """The case-th damaged copy: none, cut, flipped bits, added bytes, noise."""
    rng = random.Random(seed * 1_000_003 + case)
    if case == 0:
        return payload
    if case % 4 == 1:
        return payload[: rng.randint(0, len(payload))]
    if case % 4 == 2:
        out = bytearray(payload)
        for _ in range(rng.randint(1, max(1, min(4, len(out))))):
            if out:
                out[rng.randrange(len(out))] ^= 1 << rng.randrange(8)
        return bytes(out)
    return payload + rng.randbytes(rng.randint(1, 16)) if case % 4 == 3 else rng.randbytes(rng.randrange(max(2, 2 * len(payload))))
