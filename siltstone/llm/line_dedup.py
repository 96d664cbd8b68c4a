"""Removal of repeated runs of lines by a suffix array over line-id sequences.

Every text is a sequence of line ids. Lines that occur once in the corpus end a sequence, as no repeated run holds one;
what lies between them are segments. Distributed prefix doubling ranks all suffixes of all segments: a round orders the
distinct runs of ranks that tied suffixes have at their place and so far behind it, by prefix sums over sorted ranges, and
doubles the distance twice. Suffixes that end alike keep one rank; the first of them by place (doc_id, text, line) stands for
all in the suffix array, and the others are copies of it to their end. Neighbours in the array give the longest common
prefixes; where these fall below MIN_WORDS words, the order is cut. From the intervals between cuts follows, for each
suffix, the longest run that also begins at an earlier place. Runs of at least MIN_WORDS words are deleted, so the first
copy of every long run stays. A line that occurs everywhere is counted before it is shuffled, and never gathers in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.chunks import prefix_sums
from . import textkit as K

MIN_WORDS = 50
#: Lines that the first round compares, and how many times as many each later one does: two doublings.
FIRST, STEP = 8, 4
SLICE = 2 << 20
_gap = np.zeros(256, bool)
_gap[[9, 10, 12, 13, 32]] = True
KEY = ["doc_id", "h", "at"]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h, seq, line_no, id, words) of every line that isn't blank: h is the text's hash, seq counts these lines."""

    def apply(batches):
        for part in K.slices(batches, "text", SLICE):
            data, off = K.flat(part.column(2))
            if not len(data):
                continue
            newline = data == 10
            edge = np.zeros(len(data) + 1, bool)
            edge[off] = True
            begins = np.flatnonzero(edge[:-1] | np.r_[False, newline[:-1]])  # a line opens a text or follows a newline
            ends = np.r_[begins[1:], len(data)]
            ends = ends - ((ends > begins) & newline[ends - 1])
            word = ~_gap[data]
            word[1:] &= _gap[data[:-1]] | edge[1:-1]
            before = np.r_[0, np.cumsum(word)]
            words = before[ends] - before[begins]
            owner = np.searchsorted(off, begins, side="right") - 1
            no = np.arange(len(begins)) - np.searchsorted(begins, off[owner])
            keep = words > 0
            begins, ends, words, owner, no = (x[keep] for x in (begins, ends, words, owner, no))
            if not len(begins):
                continue
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            seq = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            ids = K.span_hashes(data, begins, ends).view(np.int64)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(seq, pa.int32()), pa.array(no, pa.int32()), pa.array(ids), pa.array(words, pa.int32())], ["doc_id", "h", "seq", "line_no", "id", "words"])

    docs = K.only(docs, "doc_id", "text")
    texts = docs.select(K.integer_id(docs, "doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return texts.mapInArrow(apply, "doc_id bigint, h bigint, seq int, line_no int, id bigint, words int")


def segments(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, h, at, ids, words, lines): the runs of repeated lines, at their first seq, that reach min_words."""
    repeated = lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    tied = lines.join(repeated, "id")
    inside = Window.partitionBy("doc_id", "h").orderBy("seq")
    # rows that share id and text are one document: the same line once
    once = tied.groupBy("doc_id", "h", "seq").agg(*(F.first(c).alias(c) for c in ("id", "words", "line_no")))
    island = once.withColumn("island", F.col("seq") - F.row_number().over(inside))
    grouped = island.groupBy("doc_id", "h", "island").agg(F.sort_array(F.collect_list(F.struct("seq", "id", "words", "line_no"))).alias("x"), F.sum(F.col("words").cast("bigint")).alias("total"))
    return grouped.where(F.col("total") >= min_words).select("doc_id", "h", F.col("x")[0]["seq"].alias("at"), F.col("x.id").alias("ids"), F.col("x.words").alias("words"), F.col("x.line_no").alias("lines"))


def suffix_ranks(segs: DataFrame) -> DataFrame:
    """(doc_id, h, at, off, r) of every suffix: r is the number of smaller suffixes, equal for suffixes that are equal to their
    ends. About log4(longest segment) rounds."""
    n = F.sequence(F.lit(0), F.size("ids") - 1)
    state = K.materialise(segs.select(*KEY, "ids", F.transform("ids", lambda _: F.lit(0).cast("bigint")).alias("ranks"), F.transform("ids", lambda _: F.lit(True)).alias("open")))
    h = 0
    while True:
        places = state.select(*KEY, "ids", "ranks", F.explode(F.filter(n, lambda i: F.get("open", i))).alias("off"))
        following = F.array(*(F.get("ranks", F.col("off") + k * h) for k in range(1, STEP))) if h else F.slice("ids", F.col("off") + 1, FIRST)
        rows = places.select(*KEY, "off", F.get("ranks", F.col("off")).alias("r"), following.alias("nr"))
        keys = prefix_sums(rows.groupBy("r", "nr").agg(F.count("*").alias("n")), [F.col("r"), F.col("nr")], {"n": "upto"})
        starts = keys.groupBy("r").agg(F.min("upto").alias("low"))
        placed = keys.join(starts, "r").select(F.col("r").alias("kr"), F.col("nr").alias("knr"), (F.col("r") + F.col("upto") - F.col("low")).alias("new"), ((F.col("n") > 1) & (F.element_at("nr", -1).isNotNull() if h else F.size("nr") == FIRST)).alias("still"))
        ranked = rows.join(placed, (rows["r"] == placed["kr"]) & (rows["nr"] == placed["knr"]))
        moved = ranked.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("off", F.struct("new", "still")))).alias("m"))
        joined = state.join(moved, KEY, "left")
        state = K.materialise(
            joined.select(
                *KEY, "ids",
                F.when(F.col("m").isNull(), F.col("ranks")).otherwise(F.transform(n, lambda i: F.coalesce(F.try_element_at("m", i)["new"], F.get("ranks", i)))).alias("ranks"),
                F.when(F.col("m").isNull(), F.transform("open", lambda _: F.lit(False))).otherwise(F.transform(n, lambda i: F.coalesce(F.try_element_at("m", i)["still"], F.lit(False)))).alias("open"),
            ), state
        )
        if not state.where(F.exists("open", lambda x: x)).limit(1).count():
            return state.select(*KEY, F.posexplode("ranks").alias("off", "r"))
        h = STEP * h or FIRST


def common_prefixes(segs: DataFrame, array: DataFrame) -> DataFrame:
    """(doc_id, h, at, off, i, lcp, words): lcp in lines, and its words, with the suffix before it in the array, both 0 for the
    first. array: (doc_id, h, at, off, i) with i from 0.

    Suffixes of one segment whose predecessors lie in one other segment at one distance share a comparison of the two.
    """
    before = array.select(*(F.col(c).alias(f"p_{c}") for c in (*KEY, "off")), (F.col("i") + 1).alias("i"))
    near = array.join(before, "i", "left")
    grouped = near.where("p_doc_id is not null").groupBy(*KEY, *(f"p_{c}" for c in KEY), (F.col("p_off") - F.col("off")).alias("shift")).agg(F.collect_list(F.struct("off", "i")).alias("x"))
    mine = segs.select(*KEY, F.col("ids").alias("a"), F.col("words").alias("w"))
    theirs = segs.select(*(F.col(c).alias(f"p_{c}") for c in KEY), F.col("ids").alias("b"))
    both = grouped.join(mine, KEY).join(theirs, [f"p_{c}" for c in KEY])
    low, high = F.array_min("x.off"), F.size("a")
    # only the part of the other segment that can match is carried on
    start = F.greatest(low + F.col("shift"), F.lit(0))
    narrow = both.select(*KEY, "x", low.alias("low"), F.slice("a", low + 1, high).alias("a"), F.slice("w", low + 1, high).alias("w"), F.slice("b", start + 1, high - low).alias("b"))

    def apply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                a, w, b = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (5, 6, 7))
                x = batch.column(3)[i].values
                off, low = x.field(0).to_numpy(), batch.column(4)[i].as_py()
                n = min(len(a), len(b))
                stops = np.r_[np.flatnonzero(a[:n] != b[:n]), n]
                total = np.r_[0, np.cumsum(w, dtype=np.int64)]
                o = off - low
                stop = stops[np.searchsorted(stops, o)]
                for k, part in enumerate((np.full(len(off), i), off, x.field(1).to_numpy(), stop - o, total[stop] - total[o])):
                    parts[k].append(part)
            who, off, i, lcp, words = (np.concatenate(x) for x in parts)
            who = pa.array(who)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(who) for k in range(3)), pa.array(off, pa.int32()), pa.array(i), pa.array(lcp, pa.int32()), pa.array(words)], [*KEY, "off", "i", "lcp", "words"])

    found = narrow.mapInArrow(apply, "doc_id bigint, h bigint, at int, off int, i bigint, lcp int, words bigint")
    return found.unionAll(near.where("p_doc_id is null").select(*KEY, F.col("off").cast("int"), "i", F.lit(0), F.lit(0).cast("bigint")))


def earlier_runs(prefixes: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, h, at, off, run): the length in lines of the longest run from here that also begins at an earlier place, where
    it can have min_words words.

    The array is cut where neighbours share fewer words. One sweep over each interval, with a stack of those suffixes whose
    next earlier neighbour isn't known yet.
    """
    cut = prefixes.withColumn("opens", (F.col("words") < min_words).cast("int"))
    groups = prefix_sums(cut.drop("words"), [F.col("i")], {"opens": "group"}).withColumn("group", F.col("group") + F.col("opens"))

    def apply(batches):
        held: list[list] = []
        out: list[tuple] = []
        group = None

        def close(place: tuple, lcp: int) -> int:
            while held and held[-1][0] > place:
                top, own = held.pop()
                if run := max(own, lcp):
                    out.append((*top, run))
                lcp = min(lcp, own)
            return lcp

        def flush():
            rows = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), *(pa.array(x, pa.int32()) for x in rows[2:])], [*KEY, "off", "run"])

        for batch in batches:
            for doc, h, at, off, lcp, g in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    close((), 0)
                    group, lcp = g, 0
                held.append([(doc, h, at, off), close((doc, h, at, off), lcp)])
            if len(out) > 10000:
                yield flush()
        close((), 0)
        if out:
            yield flush()

    sizes = groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    ordered = groups.join(sizes, "group", "left_semi").repartition("group").sortWithinPartitions("group", "i").select(*KEY, "off", "lcp", "group")
    return ordered.mapInArrow(apply, "doc_id bigint, h bigint, at int, off int, run int")


def repeated_runs(segs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, h, at, off, run): the runs of lines that also begin at an earlier place and cover all others of min_words."""
    suffixes = K.materialise(suffix_ranks(segs))
    place = F.struct(*KEY, "off")
    classes = K.materialise(suffixes.groupBy("r").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    # what follows a copy is a copy too: the first of a segment covers the rest of it
    again = suffixes.join(classes.where("n > 1").select("r", "first"), "r").where(place != F.col("first")).groupBy(*KEY).agg(F.min("off").alias("off"))
    copies = again.join(segs, KEY).select(*KEY, F.col("off").cast("int"), (F.size("ids") - F.col("off")).cast("int").alias("run"))
    array = prefix_sums(classes.select("r", "first.*").withColumn("one", F.lit(1)), [F.col("r")], {"one": "i"}).select(*KEY, F.col("off").cast("int").alias("off"), "i")
    return earlier_runs(common_prefixes(segs, array), min_words).unionByName(copies)


def _deleted(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, h, lines, words): the lines that go, and their words, of every text that loses any."""
    segs = K.materialise(segments(K.materialise(line_table(docs)), min_words))
    runs = repeated_runs(segs, min_words)
    runs = runs.groupBy(*KEY).agg(F.collect_list(F.struct("off", "run")).alias("runs"))
    covered = segs.select(*KEY, "words", "lines").join(runs, KEY)

    def apply(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                words, lines = (batch.column(k)[i].values.to_numpy() for k in (3, 4))
                off, run = (batch.column(5)[i].values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                total = np.r_[0, np.cumsum(words, dtype=np.int64)]
                long = total[off + run] - total[off] >= min_words
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, off[long], 1)
                np.add.at(gone, (off + run)[long], -1)
                gone = np.cumsum(gone)[:-1] > 0
                if gone.any():
                    rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), lines[gone].tolist(), words[gone].tolist()))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int32())), pa.array(c[3], pa.list_(pa.int32()))], ["doc_id", "h", "lines", "words"])

    return covered.mapInArrow(apply, "doc_id bigint, h bigint, lines array<int>, words array<int>")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per line that goes: doc_id, line_no (from 0, by newlines), words.

    Lines are compared byte by byte; blank lines are no part of a sequence. Of a run of at least min_words words that
    repeats, anywhere or within a text, the copy that begins first by (doc_id, text, line) stays. Null and empty texts and
    rows with a null doc_id have no lines here; rows equal in doc_id and text are one document; extra columns are ignored.
    """
    return _deleted(docs, min_words).select("doc_id", F.explode(F.arrays_zip("lines", "words")).alias("x")).select("doc_id", F.col("x.lines").alias("line_no"), F.col("x.words").alias("words"))


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the deleted lines, n_chars set anew; a document of which only blank lines are left goes. Rows without
    deleted lines stay as they are, null and empty texts too; other columns pass through."""
    gone = _deleted(docs, min_words).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.flatten(F.collect_list("lines")).alias("_gone"))
    base, name = K.numbered(docs)
    text = base[name["text"]].cast("string")
    joined = base.join(gone, (base[name["doc_id"]].cast("bigint") == gone["_id"]) & (F.xxhash64(text) == gone["_h"]), "left")
    numbers = F.map_from_entries(F.transform("_gone", lambda i: F.struct(i, F.lit(True))))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.map_contains_key("_map", i)), "\n")
    joined = joined.select("*", F.when(F.col("_gone").isNotNull(), numbers).alias("_map"))
    joined = joined.select("*", F.when(F.col("_gone").isNull(), text).otherwise(left).alias("_left")).where("_gone is null or _left rlike '[^\\\\s]'")
    size = F.when(F.col("_gone").isNull(), F.col(name["n_chars"]).cast("bigint")).otherwise(F.length("_left").cast("bigint")) if "n_chars" in name else None
    return joined.select(*(F.col("_left") if c == name["text"] else size if c == name.get("n_chars") else F.col(c) for c in base.columns)).toDF(*docs.columns)


#: DuckDB: every pair of equal lines, runs of them along a diagonal, and the later lines of the runs that are long enough.
ORACLE_SQL = f"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM s),
l AS (SELECT doc_id, line, CAST(line_no AS INTEGER) AS line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq,
  CAST(len(regexp_extract_all(line, '[^ \\t\\f\\r]+')) AS INTEGER) AS words FROM u WHERE regexp_matches(line, '[^ \\t\\f\\r]')),
p AS (SELECT a.doc_id AS d, b.doc_id AS e, a.seq - b.seq AS shift, a.seq, a.words, a.line_no FROM l a JOIN l b ON a.line = b.line AND (b.doc_id, b.seq) < (a.doc_id, a.seq)),
i AS (SELECT *, seq - row_number() OVER (PARTITION BY d, e, shift ORDER BY seq) AS island FROM p),
t AS (SELECT *, sum(words) OVER (PARTITION BY d, e, shift, island) AS total FROM i)
SELECT DISTINCT d AS doc_id, line_no, words FROM t WHERE total >= {MIN_WORDS}
"""
