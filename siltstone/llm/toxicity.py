"""Toxic passages by maximum-scoring segment search over token log-odds, with extreme-value calibration.

Token scores are log-odds of the toxic against the clean labelled texts under an informative Dirichlet prior. A word is
counted once for each word that it follows, so that copies of one text don't count as evidence. Words that begin alike are
also counted together, as families by their first bytes; words and families whose z-score is at least Z_MIN score their
log-odds. The prior is hierarchical: a word of a scoring family is drawn to the family's odds by FAMILY_WEIGHT, and a word
that the labelled texts don't have takes the odds of its longest scoring family. All other words score DRIFT. One scan of a text, linear in its length, finds every maximal
scoring segment. Under clean text the best of n positions exceeds S with probability 1 - exp(-K n exp(-lambda S)): lambda
solves the moment equation over the clean token distribution, K is fitted to the segments of held-out clean texts. A
segment whose expected number is at most E_MAX is significant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: Labelled rows of each class that the scores are fitted on at most.
FIT_PER_CLASS = 4000
#: Dirichlet prior: so many tokens spread by overall frequency, and FLAT of every word.
PRIOR = 500.0
FLAT = 0.5
Z_MIN = 3.5
#: A word weighs in from this log-odds on; frequent words that lean slightly are neutral.
SCORE_MIN = 1.0
DRIFT = -0.1
#: Lengths in bytes of the beginnings that make families, and the tokens by which a family weighs on a word of it.
FAMILY_BYTES = (4, 5, 6, 7, 8)
FAMILY_WEIGHT = 4.0
#: One false passage in a thousand clean documents.
E_MAX = 1e-3
SLICE = 4 << 20
SEGMENTS = "doc_id bigint, segment int, start_word bigint, end_word bigint, start_char bigint, end_char bigint, score double, e_value double, doc_p_value double"


def maximal_segments(positions: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score), from the positive tokens: their positions and the running
    totals before and after them (only there can a segment begin or end). Linear: each candidate is merged once."""
    held: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    links: list[int] = []  # nearest earlier candidate with a smaller total before
    for p, lo, hi in zip(positions.tolist(), before.tolist(), after.tolist()):
        first, last = p, p
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= lo:
                j = links[j]
            if j < 0 or held[j][3] >= hi:
                held.append((first, last, lo, hi))
                links.append(j)
                break
            first, lo = held[j][0], held[j][2]
            del held[j:], links[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in held]


def families(column: pa.Array, start: np.ndarray, end: np.ndarray, lengths: tuple[int, ...] = FAMILY_BYTES) -> np.ndarray:
    """The hash of the first bytes of each word, a column for each length; 0 for shorter words."""
    data = K.fold(K.flat(column)[0])
    out = np.zeros((len(start), len(lengths)), np.uint64)
    for k, n in enumerate(lengths):
        long = np.flatnonzero(end - start >= n)
        out[long, k] = K.mix(K.span_hashes(data, start[long], start[long] + n) + np.uint64(n))
    return out


def _contexts(batches, toxic_at: int, text_at: int):
    for part in K.slices(batches, "text", SLICE):
        h, start, end, first = K.word_hashes(part.column(text_at))
        if not len(h):
            continue
        previous = np.r_[np.uint64(0), h[:-1]]
        previous[first[:-1][first[:-1] < len(h)]] = 0
        owner = np.repeat(np.arange(part.num_rows), np.diff(first))
        toxic = np.asarray(part.column(toxic_at).to_pylist(), np.int8)[owner]
        pairs, at = np.unique(np.stack([h, previous, toxic.astype(np.uint64)]), axis=1, return_index=True)
        family = families(part.column(text_at), start, end)[at].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(FAMILY_BYTES)), pa.array(family.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64)), pa.array(pairs[2].astype(np.int32)), lists], ["word", "previous", "toxic", "family"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(label, text) of at most about per_class labelled rows of each class, picked by hash of id and text; equal texts
    count once. Rows with a null id, label or text teach nothing."""
    docs, labels = K.only(docs, "doc_id", "text"), K.only(labels, "doc_id", label)
    marks = labels.select(K.integer_id(labels, "doc_id"), F.col(label).cast("int").alias(label)).where(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id").agg(F.max(label).alias(label))
    sizes = marks.groupBy(label).agg(F.count("*").alias("n"))
    picked = marks.join(F.broadcast(sizes), label).where(F.expr(f"pmod(xxhash64(doc_id), 1048576) < 1048576.0 * {per_class} / n")).select("doc_id", label)
    texts = docs.select(K.integer_id(docs, "doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return texts.join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max(label).alias(label)).select(label, "text")


def word_scores(rows: DataFrame, prior: float = PRIOR, z_min: float = Z_MIN, drift: float = DRIFT) -> dict:
    """Scores of words and families from (toxic, text) rows, and lambda; none without toxic or without clean rows."""
    pairs = rows.mapInArrow(lambda b: _contexts(b, 0, 1), "word bigint, previous bigint, toxic int, family array<bigint>").distinct()
    words = pairs.groupBy("word", "family").agg(F.sum("toxic").cast("double").alias("y1"), F.sum(1 - F.col("toxic")).cast("double").alias("y0"))
    words = K.materialise(words)
    n1, n0, kinds = (x or 0.0 for x in words.agg(F.sum("y1"), F.sum("y0"), F.count("*")).first())
    none = np.zeros(0, np.uint64)
    model = {"words": none, "scores": np.zeros(0), "families": none, "family_scores": np.zeros(0), "lengths": (), "drift": drift, "lambda": 1.0, "k": 1.0}
    if not n1 or not n0:
        return model
    alpha, all_alpha = f"({prior} * (y1 + y0) / {n1 + n0} + {FLAT})", prior + FLAT * kinds
    score = f"ln((y1 + {alpha}) / ({n1 + all_alpha} - y1 - {alpha})) - ln((y0 + {alpha}) / ({n0 + all_alpha} - y0 - {alpha}))"
    odds = f"{score} AS score", f"({score}) / sqrt(1 / (y1 + {alpha}) + 1 / (y0 + {alpha})) AS z"
    telling = f"z >= {z_min} and score >= {SCORE_MIN}"
    grouped = words.select("y1", "y0", F.posexplode("family").alias("length", "f")).where("f <> 0").groupBy("length", "f").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"), F.count("*").alias("members"))
    chosen = {r.f: (r.length, r.score, r.y1, r.y0) for r in grouped.where("members > 1").selectExpr("length", "f", "y1", "y0", *odds).where(telling).collect()}
    # what a word's longest scoring family says weighs on it like FAMILY_WEIGHT tokens
    known, p = {}, {}
    own = words.selectExpr("word", "family", "y1", "y0", f"(y0 + {alpha}) / {n0 + all_alpha} AS p", *odds)
    told = own.where(telling)
    if chosen:
        listed = words.sparkSession.createDataFrame([(f,) for f in chosen], "f bigint")
        member = words.select("word", F.explode("family").alias("f")).join(F.broadcast(listed), "f", "left_semi").select("word").distinct()
        told = told.unionAll(own.join(member, "word").select(own.columns)).distinct()
    for r in told.collect():  # bounded by the labelled sample
        value, family = r.score, next((chosen[f] for f in reversed(r.family) if f in chosen), None)
        if family:
            share = family[2] / (family[2] + family[3])
            y1, y0 = r.y1 + FAMILY_WEIGHT * share + FLAT, r.y0 + FAMILY_WEIGHT * (1 - share) + FLAT
            value = np.log(y1 / (n1 + all_alpha)) - np.log(y0 / (n0 + all_alpha))
        known[r.word & K.MASK], p[r.word & K.MASK] = float(value) if value >= SCORE_MIN else drift, r.p
    if not known:
        return model
    at = np.array(sorted(known), np.uint64)
    scores, p = np.array([known[int(x)] for x in at]), np.array([p[int(x)] for x in at])
    fam = np.array(sorted(f & K.MASK for f in chosen), np.uint64)
    of = {f & K.MASK: x for f, x in chosen.items()}
    model |= {"words": at, "scores": scores, "families": fam, "family_scores": np.array([of[int(x)][1] for x in fam]), "lengths": tuple(FAMILY_BYTES[k] for k in sorted({x[0] for x in chosen.values()}))}
    rest = 1 - p.sum()
    lo, hi = 1e-6, 50.0
    for _ in range(100):  # the moment at 0 is 1 and falls first, so the root is where it comes back to 1
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * scores, 700))).sum() + rest * np.exp(mid * drift) < 1 else (lo, mid)
    model["lambda"] = (lo + hi) / 2
    return model


def segment_scores(rows: DataFrame, model: dict) -> tuple[int, int, np.ndarray]:
    """(texts, words, scores of all maximal segments, highest first) of (toxic, text) rows."""

    def look(batches):
        for part in K.slices(batches, "text", SLICE):
            found, n = [], 0
            for _, segments, words, _ in scan(part.column(1), model):
                n += words
                found += [s for _, _, s in segments]
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([n]), pa.array([found], pa.list_(pa.float64()))], ["texts", "words", "scores"])

    got = rows.mapInArrow(look, "texts bigint, words bigint, scores array<double>").collect()
    return sum(r.texts for r in got), sum(r.words for r in got), np.sort(np.array([s for r in got for s in r.scores]))[::-1]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = FIT_PER_CLASS, prior: float = PRIOR, z_min: float = Z_MIN, drift: float = DRIFT) -> dict:
    """Scores and calibration. Without toxic or without clean rows there are no scores and nothing is significant.

    K is the least with which no more segments of clean texts are significant than expected, at any score that more than E_MAX of
    the texts reach. Each half of the labelled texts is scanned with scores learned from the other, so that words that by
    chance aren't in clean texts don't flatter it.
    """
    rows = K.materialise(labelled(docs, labels, "toxic", per_class))
    model = word_scores(rows, prior, z_min, drift)
    if not len(model["words"]):
        return model
    texts, words, found = 0, 0, []
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    for k in (0, 1):
        other = word_scores(rows.where(half != k), prior, z_min, drift)
        t, w, s = segment_scores(rows.where((half == k) & (F.col("toxic") == 0)), other)
        texts, words, found = texts + t, words + w, [*found, s]
    scores, lam = np.sort(np.concatenate(found))[::-1], model["lambda"]
    rank = np.arange(1, len(scores) + 1)
    tail = (rank > E_MAX * texts) & (scores >= SCORE_MIN)
    log_k = np.log(rank[tail]) + lam * scores[tail]
    model["k"] = float(np.exp(max(log_k.max() if len(log_k) else -np.inf, lam * SCORE_MIN)) / max(words, 1))
    return model


def scan(column: pa.Array, model: dict):
    """(text, maximal segments as (first word, last word, score), words, (first byte, byte after) of words) of each text
    that has a scoring word or, with no segment, of the rest."""
    h, start, end, first = K.word_hashes(column)
    at = K.lookup(h, model["words"])
    value = np.where(at >= 0, model["scores"][np.maximum(at, 0)], model["drift"]) if len(model["words"]) else np.full(len(h), model["drift"])
    if model["lengths"]:
        fresh = np.flatnonzero(at < 0)
        family = families(column, start[fresh], end[fresh], model["lengths"])
        for k in range(family.shape[1]):  # the longest comes last
            place = K.lookup(family[:, k], model["families"])
            value[fresh[place >= 0]] = model["family_scores"][place[place >= 0]]
    hit = np.flatnonzero(value > 0)
    bounds = np.searchsorted(hit, first)
    for t in range(len(column)):
        mine = hit[bounds[t] : bounds[t + 1]]
        n = int(first[t + 1] - first[t])
        if not len(mine):
            yield t, [], n, None
            continue
        gain = value[mine]
        place = mine - first[t]
        before = (place - np.arange(len(mine))) * model["drift"] + np.r_[0.0, np.cumsum(gain)[:-1]]
        yield t, maximal_segments(place, before, before + gain), n, (start[first[t] : first[t + 1]], end[first[t] : first[t + 1]])


def toxic_passages(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None, e_max: float = E_MAX) -> DataFrame:
    """A row per significant passage: doc_id, its number in the text, words [start_word, end_word), characters
    [start_char, end_char), score, expected number by chance, and the p-value of the document's best segment.

    A document without rows has no significant passage; so do null, empty and wordless texts. Repeated rows give their
    passages once each; a null doc_id stays null; extra columns are ignored. Segments of equal score all stay.
    """
    model = model or fit(docs, labels)
    lam, k = model["lambda"], model["k"]

    def apply(batches):
        for part in K.slices(batches, "text", SLICE):
            if not len(model["words"]):
                continue
            data, off = K.flat(part.column(1))
            rows = []
            for t, segments, n, spans in scan(part.column(1), model):
                if not segments:
                    continue
                best = max(s for _, _, s in segments)
                p = -np.expm1(-k * n * np.exp(-lam * best))
                kept = [(a, b, s, k * n * np.exp(-lam * s)) for a, b, s in segments]
                head = None
                for i, (a, b, s, e) in enumerate(x for x in kept if x[3] <= e_max):
                    if head is None:
                        head = np.r_[0, np.cumsum((data[off[t] : off[t + 1]] & 0xC0) != 0x80)]
                    rows.append((t, i, a, b + 1, int(head[spans[0][a] - off[t]]), int(head[spans[1][b] - off[t]]), s, float(e), float(p)))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(c[0])), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:6]), *(pa.array(x, pa.float64()) for x in c[6:])], [x.split()[0] for x in SEGMENTS.split(", ")])

    docs = K.only(docs, "doc_id", "text")
    texts = docs.select(K.integer_id(docs, "doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(apply, SEGMENTS)
