"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All distinct pre-tokens of a batch lie in one doubly linked list of symbols. A bucket per merge rank holds the list
positions of the pairs that have it; a hierarchical bitmap (find-first-set per 64-way level) gives the lowest rank with a
filled bucket. As a merged symbol ranks above the pair it came from, ranks come up in ascending order: a bucket is taken
whole, positions whose pair has changed since (stale entries) are skipped, and all others merge at once, left to right
where they overlap. A position enters a bucket once per neighbour that changes, so the work is linear in the symbols for
pre-tokens of any length. The tokenizer's files are read, never trained.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Text that one batch encodes.
BATCH_BYTES = 2 << 20
#: Distinct pre-tokens, and characters of them, beyond which a worker forgets those that it has merged.
KEPT_WORDS, KEPT_CHARS = 1 << 17, 4 << 20
END = -1


class RankQueue:
    """Buckets of positions by rank, the lowest filled rank first."""

    def __init__(self, ranks: int):
        self.levels = [[0] * ((ranks + 63) // 64)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * ((len(self.levels[-1]) + 63) // 64))
        self.buckets: dict[int, list[np.ndarray]] = {}

    def add(self, rank: int, positions: np.ndarray) -> None:
        if held := self.buckets.get(rank):
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word = level[rank >> 6]
            level[rank >> 6] = word | (1 << (rank & 63))
            if word:
                return
            rank >>= 6

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = (rank << 6) | ((word & -word).bit_length() - 1)
        found, at = rank, rank
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        return found, self.buckets.pop(found)


class Numbers(dict):
    """Numbers of words in the order in which they first come; fresh has those that came since it was last emptied."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n


class Tokenizer:
    """Merge ranks of a byte-level BPE vocabulary; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every split of a token into two tokens is a pair that merges into it
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in keys.tolist()], np.int64)
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        # open addressing with linear probing, built once
        self.slots, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        home = self._home(keys)
        for key, rank, at in zip(keys.tolist(), self.pair_rank.tolist(), home.tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at], self.slot_rank[at] = key, rank
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.begin = np.r_[0, np.cumsum(lengths)]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.number, self.chars = Numbers(), 0
        self.merged, self.merged_begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(K.PRIME)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 where it doesn't merge or where one is no token."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._home(keys)
        slot = self.slots[at]
        out = np.where(slot == keys, self.slot_rank[at], np.int32(-1))
        open_ = np.flatnonzero((slot != keys) & (slot >= 0) & (keys >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            slot = self.slots[at[open_]]
            hit = slot == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (slot >= 0)]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pre-tokens in a row, where each begins and the end)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1)  # a barrier after each
        n = int(ends[-1]) if len(words) else 0
        token = np.full(n + 1, END, np.int32)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        token[:n][inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        pair = np.full(n + 1, -1, np.int32)  # the rank of the pair that begins here now; an entry of another rank is stale
        queue = RankQueue(self.size)

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(token[at], token[after[at]])
            pair[at] = rank
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if len(at) < 2:
                if len(at):
                    queue.add(int(rank[0]), at)
                return
            order = rank.argsort()
            at, rank = at[order], rank[order]
            cuts = (np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                queue.add(int(rank[a]), at[a:b])

        everywhere = np.flatnonzero(token[:-1] >= 0).astype(np.int32)
        for i in range(0, len(everywhere), 1 << 18):
            enter(everywhere[i : i + (1 << 18)])
        del everywhere
        while (lowest := queue.pop()) is not None:
            rank, held = lowest
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[pair[at] == rank]
            if len(at) > 1:
                at.sort()
                step = at[1:] != at[:-1]
                if not step.all():
                    at = at[np.concatenate([[True], step])]
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # x x x: pairs overlap only where both halves are alike; take every other of a chain
                    place = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.concatenate([[False], chained]), 0, place))
                    at = at[(place - start) % 2 == 0]
            elif not len(at):
                continue
            gone = after[at]
            new_after = after[gone]
            token[gone] = END - 1  # dead
            pair[gone] = -1
            token[at] = rank
            after[at] = new_after
            before[new_after] = at
            prior = before[at]
            enter(np.concatenate([at, prior[(prior >= 0) & (token[prior] >= 0)]]))
        alive = token[:n] >= 0
        counts = np.r_[0, np.cumsum(alive)]
        return token[:n][alive], np.r_[0, counts[ends]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts in a row, where each text begins and the end). Pre-tokens that were merged before are looked up."""
        if len(self.number) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self._forget()
        place, find = self.number.__getitem__, self.pattern.findall
        ids, sizes = [], []
        for text in texts:
            got = find(text)
            ids.append(np.fromiter(map(place, got), np.int32, len(got)))
            sizes.append(len(got))
        fresh, self.number.fresh = self.number.fresh, []
        if fresh:
            self.chars += sum(map(len, fresh))
            tokens, begin = self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])
            self.merged_begin = np.r_[self.merged_begin, len(self.merged) + begin[1:]]
            self.merged = np.r_[self.merged, tokens]
        begin, sequence = self.merged_begin, np.concatenate(ids) if ids else np.zeros(0, np.int32)
        length = np.diff(begin)[sequence]
        total = np.r_[0, np.cumsum(length)]
        # gather every pre-token's tokens in place
        out = self.merged[np.repeat(begin[:-1][sequence] - total[:-1], length) + np.arange(int(total[-1]))] if len(sequence) else np.zeros(0, np.int32)
        return out, total[np.r_[0, np.cumsum(sizes, dtype=np.int64)]]

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of all tokens in a row."""
        begin = self.begin[tokens]
        length = self.begin[tokens + 1] - begin
        total = np.r_[0, np.cumsum(length)]
        return self.bytes[np.repeat(begin - total[:-1], length) + np.arange(int(total[-1]))]


_loaded: dict[str, Tokenizer] = {}


def load(path: str = VOCABULARY) -> Tokenizer:
    """The tokenizer of a file of base64 tokens and ranks, read once per process."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    return _loaded[path]


def _encoded(batches: Iterator[pa.RecordBatch], at: int, path: str, batch_bytes: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for part in K.slices(batches, at, batch_bytes):
        column = part.column(at)
        tokens, begin = load(path).encode([t or "" for t in column.to_pylist()])
        null = column.is_null()
        offsets = pa.array(begin.astype(np.int32), mask=np.r_[null.to_numpy(zero_copy_only=False), False]) if column.null_count else pa.array(begin.astype(np.int32))
        yield part, pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.int32()))


def encode(docs: DataFrame, path: str = VOCABULARY, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs with tokens (array<int>) and n_tokens (int): null for a null text, empty and 0 for an empty one.

    Every text is encoded whole, on its own; repeated rows alike. Columns of docs that are called tokens or n_tokens are
    replaced; all others pass through.
    """
    return _with_tokens(docs, path, batch_bytes, False)


def _with_tokens(docs: DataFrame, path: str, batch_bytes: int, back: bool) -> DataFrame:
    names = ["tokens", "n_tokens", *["decoded"] * back]
    apart, name = K.numbered(docs)
    text, kept = name["text"], [i for i, c in enumerate(docs.columns) if c.lower() not in names]
    base = apart.select(*(F.col(f"c{i}").cast("string").alias(f"c{i}") if f"c{i}" == text else F.col(f"c{i}") for i in kept))
    at = base.columns.index(text)
    schema = T.StructType([*base.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), *[T.StructField("decoded", T.StringType())] * back])

    def apply(batches):
        for part, tokens in _encoded(batches, at, path, batch_bytes):
            yield pa.RecordBatch.from_arrays([*part.columns, tokens, tokens.value_lengths(), *[_texts(tokens, path)] * back], schema.names)

    return base.mapInArrow(apply, schema).toDF(*(docs.columns[i] for i in kept), *names)


def tokenise(docs: DataFrame, path: str = VOCABULARY, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs with tokens and n_tokens, as encode() gives them, and decoded, the text that they decode to (null for a null text),
    in one pass over the texts. Columns of docs with one of these names are replaced; all others pass through."""
    return _with_tokens(docs, path, batch_bytes, True)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """encoded with the column decoded: the text of tokens; null for null tokens. Bytes that aren't UTF-8 on their own,
    which only tokens from elsewhere can give, become the replacement character; an id outside the vocabulary is an error."""
    apart, name = K.numbered(encoded)
    kept = [i for i, c in enumerate(encoded.columns) if c.lower() != "decoded"]
    base = apart.select(*(f"c{i}" for i in kept))
    schema = T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())])
    at = base.columns.index(name["tokens"])

    def apply(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(part.column(at), path)], [*part.schema.names, "decoded"])

    return base.mapInArrow(apply, schema).toDF(*(encoded.columns[i] for i in kept), "decoded")


def _texts(tokens: pa.Array, path: str) -> pa.Array:
    """The texts of lists of tokens. Bytes that are UTF-8 as a whole are taken as they are, others are replaced text by text."""
    tokenizer = load(path)
    ids = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= tokenizer.size):
        raise ValueError(f"token ids must be from 0 to {tokenizer.size - 1}")
    data = tokenizer.decode(ids)
    sizes = np.r_[0, np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))]
    ends = np.r_[0, np.cumsum(tokenizer.begin[ids + 1] - tokenizer.begin[ids])][sizes]
    valid = tokens.is_valid()
    try:
        data.tobytes().decode()
        whole = not ((data[ends[:-1][ends[:-1] < len(data)]] & 0xC0) == 0x80).any()  # no character lies across two texts
    except UnicodeDecodeError:
        whole = False
    if whole and len(data) < 1 << 31:
        mask = None if not tokens.null_count else pa.py_buffer(np.packbits(valid.to_numpy(zero_copy_only=False), bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.string(), len(tokens), [mask, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return pa.array([data[a:b].tobytes().decode("utf-8", "replace") if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), valid.to_pylist())], pa.string())


def round_trip(docs: DataFrame, path: str = VOCABULARY, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A row per document: doc_id, tokens, n_tokens, and same, whether decoding them gives the text's bytes again (null for
    a null text). An empty table gives no rows."""
    docs = K.only(docs, "doc_id", "text")
    base = docs.select(K.integer_id(docs, "doc_id"), F.col("text").cast("string").alias("text"))

    def apply(batches):
        for part, tokens in _encoded(batches, 1, path, batch_bytes):
            data, off = K.flat(part.column(1))
            back = load(path).decode(tokens.values.to_numpy().astype(np.int64))
            differs = np.r_[0, np.cumsum(data != back)] if len(data) == len(back) else np.arange(len(data) + 1)
            same = pa.array((differs[off[1:]] == differs[off[:-1]]), mask=part.column(1).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([part.column(0), tokens, tokens.value_lengths(), same], ["doc_id", "tokens", "n_tokens", "same"])

    return base.mapInArrow(apply, "doc_id bigint, tokens array<int>, n_tokens int, same boolean")
