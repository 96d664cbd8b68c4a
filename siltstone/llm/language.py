"""Language identification by nearest centroid, with distance-based rejection.

A document is a vector of TF-IDF weights over hashed letter bigrams and trigrams (UTF-8 bytes of folded text, any run of
other characters as one blank), of unit length. Each language has several centroids, found by spherical k-means over a
bounded sample of labelled rows; a document takes the language of the centroid with the largest cosine and is rejected
where that cosine is below what the language's own texts of this length reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

BIGRAMS, TRIGRAMS = 2048, 6144
WIDTH = BIGRAMS + TRIGRAMS
CENTROIDS = 4
#: Labelled rows of each language that k-means sees at most.
FIT_PER_LANGUAGE = 1500
#: Of these, so many at most are also cut into pieces of all lengths, by which the floors of short texts are calibrated.
CALIBRATION_TEXTS = 400
#: Lengths, in characters, of the pieces: from the beginning and from the middle of a text.
PIECES = (6, 12, 24, 48, 96, 192, 384, 768, 1536, 4096)
#: Share of the language's own texts of a length that calibration puts below the floor, under which a document is rejected.
FLOOR_QUANTILE = 0.001
#: No text is held to a higher calibrated cosine than this: long texts that mix languages stay.
HIGHEST_FLOOR = 0.5
_KINDS = 91
_letter = np.zeros(256, np.int32)
_letter[97:123] = np.arange(1, 27)
_letter[128:] = 27 + (np.arange(128) & 0x3F)


def gram_counts(column: pa.Array) -> np.ndarray:
    """Counts of the hashed n-grams, a row for each text; a null or letterless text has none."""
    data, off = K.flat(column)
    n = len(column)
    if not len(data):
        return np.zeros((n, WIDTH), np.float32)
    x = _letter[K.fold(data)]
    owner = np.repeat(np.arange(n), np.diff(off))
    keep = np.r_[x[0] > 0, (x[1:] > 0) | ((x[:-1] > 0) & (owner[1:] == owner[:-1]))]
    x, owner = x[keep], owner[keep]
    counts = np.zeros(n * WIDTH, np.int64)
    if len(x) > 1:
        two = x[:-1] * _KINDS + x[1:]
        ok = owner[:-1] == owner[1:]
        counts += np.bincount((owner[:-1] * WIDTH + ((two * 40503) >> 4) % BIGRAMS)[ok], minlength=n * WIDTH)
    if len(x) > 2:
        three = two[:-1] * _KINDS + x[2:]
        ok = owner[:-2] == owner[2:]
        counts += np.bincount((owner[:-2] * WIDTH + BIGRAMS + ((three.astype(np.int64) * 2654435761) >> 9) % TRIGRAMS)[ok], minlength=n * WIDTH)
    return counts.reshape(n, WIDTH).astype(np.float32)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return (x / np.maximum(norm, 1e-12)).astype(np.float32)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.log2(counts.sum(axis=1) + 1).astype(np.int64).clip(0, 31)


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches, column, 1 << 19):
        for at in range(0, part.num_rows, 128):
            yield part.slice(at, 128)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; unit centroids, at most k."""
    seeds = [x.mean(axis=0) / max(np.linalg.norm(x.mean(axis=0)), 1e-12)]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int(np.argmin((x @ np.stack(seeds).T).max(axis=1)))])
    c = np.stack(seeds)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each hashed n-gram occurs, and how many documents there are."""

    def seen(batches):
        total, n = np.zeros(WIDTH, np.int64), 0
        for part in _small(batches, "text"):
            total += (gram_counts(part.column(0)) > 0).sum(axis=0)
            n += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, total[some]])], ["gram", "n"])

    rows = K.only(docs, "text").select(F.col("text").cast("string").alias("text")).mapInArrow(seen, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(WIDTH, np.int64)
    count = 0
    for gram, n in rows:
        if gram < 0:
            count = n
        else:
            df[gram] = n
    return df, count


def fit(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE, centroids: int = CENTROIDS, calibration_texts: int = CALIBRATION_TEXTS) -> dict:
    """The model: idf over all docs; centroids and floors from at most per_language rows of each language that has a label.

    The sample is by hash of id and text, so it doesn't depend on row order. Floors are quantiles of what each half of the
    sample reaches against centroids of the other half: all whole texts, and pieces of calibration_texts of them. Rows with a
    null lang or text teach nothing.
    """
    docs = K.only(docs, "doc_id", "lang", "text")
    df, count = document_frequency(docs)
    idf = (np.log((1 + count) / (1 + df)) + 1).astype(np.float32)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    picked = rows.join(F.broadcast(sizes), "lang").where(F.expr(f"pmod(h, 1048576) < 1048576 * 1.2 * {per_language} / n"))
    schema = "lang string, kind string, k int, value array<float>"

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values(["h", "text"])["text"].iloc[:per_language].to_list()
        counts = [gram_counts(pa.array(texts[at : at + 128], pa.string())) for at in range(0, len(texts), 128)]
        x = weigh(np.concatenate(counts), idf)
        has = x.any(axis=1)
        x, texts = x[has], [t for t, h in zip(texts, has.tolist()) if h]
        if not len(x):
            return pd.DataFrame({"lang": [], "kind": [], "k": [], "value": []})
        c = cluster(x, centroids)
        floors = np.full(32, np.nan)
        lowest: dict[int, list[float]] = {}
        for fold in (0, 1):  # each half of the texts against centroids of the other
            apart = cluster(x[1 - fold :: 2], centroids) if len(x) > 1 else c
            own = texts[fold::2]
            pieces = [t[at : at + n] for t in own[: (calibration_texts + 1) // 2] for n in PIECES for at in (0, len(t) // 2)] + own
            for at in range(0, len(pieces), 128):
                counts = gram_counts(pa.array(pieces[at : at + 128], pa.string()))
                best, size = (weigh(counts, idf) @ apart.T).max(axis=1), length_class(counts)
                for s, b in zip(size.tolist(), best.tolist()):
                    lowest.setdefault(s, []).append(b)
        for s, values in lowest.items():
            floors[s] = np.quantile(values, FLOOR_QUANTILE)
        known = np.flatnonzero(~np.isnan(floors))
        floors = np.minimum(np.interp(np.arange(32), known, floors[known]), HIGHEST_FLOOR)
        return pd.DataFrame({"lang": key[0], "kind": ["centroid"] * len(c) + ["floor"], "k": range(len(c) + 1), "value": [*c.astype(np.float32), floors.astype(np.float32)]})

    learned = picked.groupBy("lang").applyInPandas(learn, schema).collect()
    learned.sort(key=lambda r: (r["lang"], r["kind"], r["k"]))
    langs = sorted({r["lang"] for r in learned})
    of, c, floors = [], [], np.zeros((len(langs), 32), np.float32)
    for r in learned:
        if r["kind"] == "centroid":
            of.append(langs.index(r["lang"]))
            c.append(r["value"])
        else:
            floors[langs.index(r["lang"])] = r["value"]
    return {"langs": langs, "of": np.array(of, np.int64), "centroids": np.array(c, np.float32).reshape(-1, WIDTH), "floors": floors, "idf": idf}


def judge(column: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language, cosine, accepted) of each text."""
    counts = gram_counts(column)
    if not len(model["langs"]):
        return np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column), bool)
    cosine = weigh(counts, model["idf"]) @ model["centroids"].T
    best = cosine.argmax(axis=1)
    lang, top = model["of"][best], cosine.max(axis=1).astype(np.float64)
    return lang, top, (counts.sum(axis=1) > 0) & (top >= model["floors"][lang, length_class(counts)])


def _judged(docs: DataFrame, model: dict, extra: bool) -> DataFrame:
    names = np.array([*model["langs"], None], dtype=object)
    if extra:
        base, name = K.numbered(docs)
        text = name["text"]
        base = base.withColumn(text, F.col(text).cast("string"))
    else:
        docs, text = K.only(docs, "doc_id", "lang", "text"), "text"
        base = docs.select(K.integer_id(docs, "doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    at = base.columns.index(text)

    def apply(batches):
        for part in _small(batches, text):
            lang, top, ok = judge(part.column(at), model)
            if extra:
                yield part.filter(pa.array(ok))
            else:
                found = pa.array(names[np.where(ok, lang, len(names) - 1)].tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found, pa.array(top), pa.array(~ok)], ["doc_id", "lang", "predicted_lang", "similarity", "rejected"])

    if extra:
        return base.mapInArrow(apply, base.schema).toDF(*docs.columns)
    return base.mapInArrow(apply, "doc_id bigint, lang string, predicted_lang string, similarity double, rejected boolean")


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """A row per document: doc_id, its declared lang, predicted_lang (null where rejected), the best cosine, rejected.

    A null, empty or letterless text is rejected with cosine 0; so is every text where no row has a label. Repeated rows
    are judged alike, ties go to the first language by name, extra columns are ignored, an empty table gives none.
    """
    return _judged(docs, model or fit(docs), False)


def accepted(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The documents that aren't rejected, with all their columns as they were."""
    return _judged(docs, model or fit(docs), True)
