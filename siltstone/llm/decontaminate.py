"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmark's phrases.

A shard is a run of at most SHARD_BYTES of text within one task. Its words become symbols: the words that occur in the
benchmark keep an identity each, a run of any other words is one symbol, and each text ends with a terminator. No phrase
holds another word, so no occurrence is lost. The shard's suffix array gives the Burrows-Wheeler transform, which a
wavelet matrix stores; phrases are counted by backward search through its ranks and located by walking back to sampled
suffix positions. Occurrences that touch or overlap merge into removal spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

PHRASE_WORDS = 8
SHARD_BYTES = 4 << 20
SAMPLE_RATE = 16
#: Benchmark text that one pass over the corpus searches for; a larger benchmark takes more passes.
BLOCK_BYTES = 16 << 20
SPANS = "doc_id bigint, start_word bigint, end_word bigint, start_char bigint, end_char bigint"
_word = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols by prefix doubling; only tied suffixes are sorted again."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(text.max() + 1).bit_length())
    h = max(1, 62 // bits)
    packed, padded = np.zeros(n, np.int64), np.r_[text + 1, np.zeros(h, np.int64)]
    for k in range(h):  # the first h symbols of each suffix in one key; past the end counts as lowest
        packed = (packed << bits) | padded[k : k + n]
    order = np.argsort(packed)
    key = packed[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        tail = np.r_[head[1:], True]
        tied = np.flatnonzero(~(head & tail))
        if not len(tied):
            return order
        who = order[tied]
        after = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        group = rank[who]
        by = np.argsort(group * (n + 1) + after)
        who, group, after = who[by], group[by], after[by]
        order[tied] = who
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        head[tied] = new
        rank[who] = np.maximum.accumulate(np.where(new, tied, 0))
        h *= 2


class WaveletMatrix:
    """Ranks of any symbol in a sequence, a bit level at a time."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones_before = bits, [], []
        for b in reversed(range(bits)):
            one = (sequence >> b) & 1 == 1
            self.ones_before.append(np.r_[np.zeros(1, np.int32), np.cumsum(one, dtype=np.int32)])
            self.zeros.append(len(sequence) - int(self.ones_before[-1][-1]))
            sequence = np.concatenate([sequence[~one], sequence[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place; symbols and places pair up."""
        begin = np.zeros_like(at)
        for level, b in enumerate(reversed(range(self.bits))):
            ones, one = self.ones_before[level], (symbol >> b) & 1 == 1
            at = np.where(one, self.zeros[level] + ones[at], at - ones[at])
            begin = np.where(one, self.zeros[level] + ones[begin], begin - ones[begin])
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for level in range(self.bits):
            ones = self.ones_before[level]
            one = ones[at + 1] > ones[at]
            symbol = symbol * 2 + one
            at = np.where(one, self.zeros[level] + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Counts and locates word sequences in a text of symbols below n_symbols."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample_rate: int = SAMPLE_RATE):
        self.n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]  # before the first symbol comes the last
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
        self.tree = WaveletMatrix(bwt, max(1, int(n_symbols - 1).bit_length()))
        self.marked = (sa % sample_rate == 0) | (bwt == 0)  # a walk never leaves its text
        self.marks_before = np.r_[0, np.cumsum(self.marked)]
        self.samples = sa[self.marked]

    def count(self, sequence: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of the phrases that occur: phrase i is sequence[starts[i] :][:length]."""
        last = sequence[starts + length - 1].astype(np.int64)
        which = np.flatnonzero(self.before[last] < self.before[last + 1])
        lo, hi = self.before[last[which]], self.before[last[which] + 1]
        for k in reversed(range(length - 1)):
            if not len(which):
                break
            symbol = sequence[starts[which] + k].astype(np.int64)
            lo = self.before[symbol] + self.tree.rank(symbol, lo)
            hi = self.before[symbol] + self.tree.rank(symbol, hi)
            keep = lo < hi
            which, lo, hi = which[keep], lo[keep], hi[keep]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        found, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.marked[at]
            found[left[done]] = self.samples[self.marks_before[at[done]]] + steps[left[done]]
            left, at = left[~done], at[~done]
            symbol = self.tree.access(at)
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps[left] += 1
        return found


class Phrases(NamedTuple):
    """Phrases of a block of the benchmark: sorted hashes of its words, its words as symbols, and by length where phrases
    begin. Windows overlap in the sequence, so a block takes about 16 bytes a word."""

    known: np.ndarray
    sequence: np.ndarray
    groups: list[tuple[int, np.ndarray]]


def phrase_table(texts: list[str | None], words: int = PHRASE_WORDS) -> Phrases:
    """Every run of so many words of an item, or the whole item where it is shorter; an item that is null or without words
    has none. Phrases whose words hash alike are equal and listed once."""
    hashes, _, _, first = K.word_hashes(pa.array(texts, pa.string()))
    known = np.unique(hashes)
    sequence = (K.lookup(hashes, known) + 2).astype(np.int32)  # 0 ends a text, 1 is any other word
    size = np.diff(first)
    groups = []
    for n in np.unique(np.minimum(size, words)).tolist():
        if n:
            own = first[:-1][np.minimum(size, words) == n]
            many = (size[np.minimum(size, words) == n] - n + 1 if n == words else np.ones(len(own), np.int64)).astype(np.int64)
            starts = np.repeat(own - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))
            key = np.zeros(len(starts), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    key = K.mix(key * np.uint64(K.PRIME) + sequence[starts + k].astype(np.uint64))
            order = np.argsort(key, kind="stable")
            starts, key = starts[order], key[order]
            alike = key[1:] == key[:-1]
            for k in range(n):
                alike &= sequence[starts[1:] + k] == sequence[starts[:-1] + k]
            groups.append((n, starts[np.r_[True, ~alike]].astype(np.int32)))
    return Phrases(known, sequence, groups)


def shard_spans(texts: pa.Array, phrases: Phrases) -> list[tuple[int, int, int, int, int]]:
    """Merged removal spans of a shard: (text, first word, word after the last, first character, character after)."""
    hashes, start, end, first = K.word_hashes(texts)
    if not len(hashes) or not phrases.groups:
        return []
    symbols = K.lookup(hashes, phrases.known) + 2
    other = symbols == 1
    text_end = np.zeros(len(hashes) + 1, bool)
    text_end[first] = True
    keep = ~(other & np.r_[False, other[:-1]] & ~text_end[:-1])  # a run of other words is one symbol
    where = np.flatnonzero(keep)
    owner = np.searchsorted(first, where, side="right") - 1
    # each text's kept symbols, then a terminator
    new_text = np.r_[False, owner[1:] != owner[:-1]].cumsum()
    sequence = np.zeros(len(where) + int(new_text[-1]) + 1, np.int64)
    place = np.arange(len(where)) + new_text
    sequence[place] = symbols[where]
    word_of = np.full(len(sequence), -1, np.int64)
    word_of[place] = where
    index = FMIndex(sequence, len(phrases.known) + 2)
    spans = []
    for length, starts in phrases.groups:
        _, lo, hi = index.count(phrases.sequence, starts, length)
        if len(lo):
            rows = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(int((hi - lo).sum()))
            at = word_of[index.locate(rows)]
            spans.append(np.stack([at, at + length], axis=1))
    if not spans:
        return []
    spans = np.concatenate(spans)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    text_of = np.searchsorted(first, spans[:, 0], side="right") - 1
    new = np.r_[True, (spans[1:, 0] > reach[:-1]) | (text_of[1:] != text_of[:-1])]
    at = np.flatnonzero(new)
    begin, after, text = spans[at, 0], np.maximum.reduceat(reach, at), text_of[at]
    data, off = K.flat(texts)
    starts_character = (data & 0xC0) != 0x80
    out = []
    for b, a, t in zip(begin.tolist(), after.tolist(), text.tolist()):
        c = int(starts_character[off[t] : start[b]].sum())
        d = c + int(starts_character[start[b] : end[a - 1]].sum())
        out.append((t, b - int(first[t]), a - int(first[t]), c, d))
    return out


def _blocks(items: list[tuple], block_bytes: int) -> Iterator[list[str]]:
    block, size = [], 0
    for (text,) in items:
        block.append(text)
        size += len(text or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def merged(spans: list[tuple]) -> list[tuple]:
    """(first word, word after, first character, character after) spans of one text; those that touch or overlap in words
    become one."""
    out: list[list] = []
    for a, b, c, d in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], b), max(out[-1][3], d)
        else:
            out.append([a, b, c, d])
    return [tuple(x) for x in out]


def _searched(rows: DataFrame, text: str, benchmark: DataFrame, finish: Callable[[list[pa.Array], dict[int, list[tuple]]], pa.RecordBatch], schema: T.StructType, phrase_words: int, shard_bytes: int, block_bytes: int) -> DataFrame | None:
    """What finish makes of each shard's columns and of the merged removal spans of its rows, by row; None if the benchmark has
    no phrase. Spans are found and merged within a row, whatever its id. A benchmark of several blocks takes a pass for each,
    with the rows and their spans so far kept in between."""
    at, width = rows.columns.index(text), len(rows.columns)
    between = T.StructType([*rows.schema.fields, T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    items = ((r[0],) for r in K.only(benchmark, "text").where("text is not null").toLocalIterator())
    tables = (x for x in (phrase_table(b, phrase_words) for b in _blocks(items, block_bytes)) if x.groups)
    phrases, first, before = next(tables, None), True, None
    if phrases is None:
        return None
    while True:
        following = next(tables, None)

        def search(batches, phrases=phrases, again=not first, last=following is None):
            for part in K.slices(batches, at, shard_bytes):
                found: dict[int, list[tuple]] = {}
                if again:
                    found = {t: [tuple(x) for x in own] for t, own in enumerate(part.column(width).to_pylist()) if own}
                for t, *span in shard_spans(part.column(at), phrases):
                    found.setdefault(t, []).append(tuple(span))
                found = {t: merged(own) if again else own for t, own in sorted(found.items())}
                columns = part.columns[:width]
                yield finish(columns, found) if last else pa.RecordBatch.from_arrays([*columns, pa.array([found.get(t) for t in range(part.num_rows)], pa.list_(pa.list_(pa.int64())))], between.names)

        if following is None:
            return rows.mapInArrow(search, schema)
        rows = before = K.materialise(rows.mapInArrow(search, between), before)
        phrases, first = following, False


def removal_spans(docs: DataFrame, benchmark: DataFrame, phrase_words: int = PHRASE_WORDS, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per merged span of benchmark text in docs: doc_id, words [start_word, end_word), characters [start_char, end_char).

    A phrase is any phrase_words successive words of an item, or a whole shorter item. Null or wordless texts and items
    match nothing; an empty table on either side gives no rows; repeated rows and ids give their spans once per row, and
    a null doc_id stays null. Extra columns are ignored. The benchmark is read to the driver item by item, and searched
    for in blocks of block_bytes, a pass over the corpus each, so its size is bounded by passes, not by memory. How many
    blocks there are doesn't change the result.
    """
    docs = K.only(docs, "doc_id", "text")
    texts = docs.select(K.integer_id(docs, "doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField(x.split()[0], T.LongType()) for x in SPANS.split(", ")])

    def listed(columns, found):
        who = [t for t, own in found.items() for _ in own]
        spans = np.array([x for own in found.values() for x in own], np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([columns[0].take(pa.array(who, pa.int64())), *(pa.array(spans[:, k]) for k in range(4))], schema.names)

    out = _searched(texts, "text", benchmark, listed, schema, phrase_words, shard_bytes, block_bytes)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, phrase_words: int = PHRASE_WORDS, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with every removal span cut from text and n_chars set anew; a document left without a word goes.

    A row loses its own spans only, also where its id is null or shared; nothing is joined or shuffled. A document without a
    match keeps its text as it is, null or empty too. Other columns pass through.
    """
    apart, name = K.numbered(docs)
    kinds = {name["text"]: "string"} | ({name["n_chars"]: "bigint"} if "n_chars" in name else {})
    base = apart.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in apart.columns))
    places = base.columns
    at, size = places.index(name["text"]), places.index(name["n_chars"]) if "n_chars" in name else None

    def cut(columns, found):
        columns = list(columns)
        if found:
            left = []
            for text, spans in zip(columns[at].take(pa.array(list(found))).to_pylist(), found.values()):
                edges = [0, *(e for x in spans for e in x[2:4]), len(text)]
                left.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            hit = np.zeros(len(columns[at]), bool)
            hit[list(found)] = True
            columns[at] = pc.replace_with_mask(columns[at], pa.array(hit), pa.array(left, columns[at].type))
            if size is not None:
                columns[size] = pc.replace_with_mask(columns[size], pa.array(hit), pa.array([len(x) for x in left], pa.int64()))
            stays = np.ones(len(hit), bool)
            stays[[t for t, x in zip(found, left) if not _word.search(x)]] = False
            if not stays.all():
                columns = [c.filter(pa.array(stays)) for c in columns]
        return pa.RecordBatch.from_arrays(columns, places)

    out = _searched(base, name["text"], benchmark, cut, base.schema, phrase_words, shard_bytes, block_bytes)
    return (base if out is None else out).toDF(*docs.columns)


_leads = ", ".join(f"lead(word, {i}) OVER w AS w{i}, lead(CAST(upto AS BIGINT), {i}) OVER w AS e{i}" for i in range(1, PHRASE_WORDS))
_joined = " ".join(f"WHEN {n} THEN word" + "".join(f" || ' ' || w{i}" for i in range(1, n)) for n in range(1, PHRASE_WORDS + 1))
_ends = "WHEN 1 THEN end_char " + " ".join(f"WHEN {n} THEN e{n - 1}" for n in range(2, PHRASE_WORDS + 1))

#: DuckDB: words with their character offsets, phrases joined as text, overlapping occurrences merged as islands.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]*[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS parts FROM documents),
w AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM d),
x AS (SELECT doc_id, k, lower(regexp_extract(part, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+$')) AS word, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM w),
g AS (SELECT doc_id, k, word, CAST(upto AS BIGINT) AS end_char, CAST(upto - length(word) AS BIGINT) AS start_char, {_leads} FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
b AS (SELECT regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM benchmark),
p AS (SELECT DISTINCT least({PHRASE_WORDS}, len(words)) AS n, array_to_string(list_slice(words, i + 1, i + least({PHRASE_WORDS}, len(words))), ' ') AS phrase
  FROM (SELECT words, unnest(range(greatest(1, len(words) - {PHRASE_WORDS - 1}))) AS i FROM b WHERE len(words) > 0)),
c AS (SELECT doc_id, k, n, start_char, CASE n {_ends} END AS end_char, CASE n {_joined} END AS phrase FROM g CROSS JOIN (SELECT DISTINCT n FROM p)),
m AS (SELECT doc_id, k AS a, k + n AS z, start_char, end_char FROM c JOIN p USING (n, phrase)),
i AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
s AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, z) AS island FROM i)
SELECT doc_id, min(a) AS start_word, max(z) AS end_word, min(start_char) AS start_char, max(end_char) AS end_char FROM s GROUP BY doc_id, island
"""
