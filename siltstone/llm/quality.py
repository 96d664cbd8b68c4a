"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. A passage is encoded from the frequencies of its byte-class
bigrams (its orthography) and of its hashed words. Gated attention, learned from document labels alone, weighs the
passages' representations, and the weighted representation is scored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .toxicity import labelled

PASSAGE_WORDS = 48
#: Labelled rows of each class that the model is trained on at most.
FIT_PER_CLASS = 1500
CLASSES, WORDS = 16, 128
WIDTH = CLASSES * CLASSES + WORDS
HIDDEN, GATE = 24, 16
SLICE = 1 << 20
_class = np.full(256, 15, np.int64)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "%$#&*", "|", "'\"`", "()[]{}<>", "-_/\\=+~^", "@"]):
    for _c in _chars:
        _class[ord(_c)] = _k
_class[128:] = 14


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, the text of each). A text without words is one passage; an empty or null one has none."""
    data, off = K.flat(column)
    h, start, _, first = K.word_hashes(column)
    number = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    opens = np.zeros(len(data) + 1, bool)
    opens[start[(number % PASSAGE_WORDS == 0) & (number > 0)]] = True
    opens[off[:-1][np.diff(off) > 0]] = True  # what precedes the first word belongs to the first passage
    at = np.flatnonzero(opens[:-1])
    if not len(at):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64)
    length = np.diff(np.r_[at, len(data)])
    of = np.repeat(np.arange(len(at)), length)
    kind = _class[data]
    inside = of[1:] == of[:-1]
    counts = np.bincount((of[:-1] * WIDTH + kind[:-1] * CLASSES + kind[1:])[inside], minlength=len(at) * WIDTH)
    counts += np.bincount(of[start] * WIDTH + CLASSES * CLASSES + (h % np.uint64(WORDS)).astype(np.int64), minlength=len(at) * WIDTH)
    x = counts.reshape(len(at), WIDTH).astype(np.float32)
    for part in (x[:, : CLASSES * CLASSES], x[:, CLASSES * CLASSES :]):
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1)
    return np.sqrt(x), np.searchsorted(off, at, side="right") - 1


def forward(x: np.ndarray, of: np.ndarray, n: int, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All values on the way to the logits of n documents; of[i] is the document of passage i, ascending."""
    h = np.maximum(x @ w["W"] + w["b"], 0)
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["a"]
    at = np.searchsorted(of, np.arange(n))
    has = np.diff(np.r_[at, len(of)]) > 0
    top = np.zeros(n, x.dtype)
    if len(of):
        top[has] = np.maximum.reduceat(e, at[has])
    e = np.exp(e - top[of])
    attention = e / np.maximum(np.bincount(of, weights=e, minlength=n)[of], 1e-30)
    z = np.zeros((n, h.shape[1]))
    if len(of):
        z[has] = np.add.reduceat(attention[:, None] * h, at[has], axis=0)
    return {"h": h, "t": t, "g": g, "attention": attention, "z": z, "logit": z @ w["c"] + w["d"][0], "has": has}


def gradients(x: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Derivatives of the documents' mean weighted log loss by every weight."""
    n = len(y)
    f = forward(x, of, n, w)
    d_logit = (1 / (1 + np.exp(-f["logit"])) - y) * weight / n
    d_z = np.outer(d_logit, w["c"])
    p, h = f["attention"], f["h"]
    d_p = (d_z[of] * h).sum(axis=1)
    d_e = p * (d_p - np.bincount(of, weights=p * d_p, minlength=n)[of])
    d_t, d_g = np.outer(d_e, w["a"]) * f["g"] * (1 - f["t"] ** 2), np.outer(d_e, w["a"]) * f["t"] * f["g"] * (1 - f["g"])
    d_h = (p[:, None] * d_z[of] + d_t @ w["V"].T + d_g @ w["U"].T) * (h > 0)
    return {"W": x.T @ d_h, "b": d_h.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_g, "a": (f["t"] * f["g"]).T @ d_e, "c": f["z"].T @ d_logit, "d": np.array([d_logit.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, rate: float = 3e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights by Adam on the class-balanced log loss of documents."""
    rng = np.random.default_rng(seed)
    w = {"W": rng.normal(0, 0.3, (WIDTH, HIDDEN)), "b": np.full(HIDDEN, 0.1), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), 64):
            some = order[a : a + 64]
            x = np.concatenate([bags[i] for i in some]).astype(np.float64)
            of = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
            step += 1
            for k, g in gradients(x, of, y[some], weight[some], w).items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in w.items()}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = FIT_PER_CLASS) -> dict[str, np.ndarray] | None:
    """The model, trained in one task on at most about per_class labelled texts of each class; None without both classes."""
    rows = labelled(docs, labels, "quality", per_class)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(h=pd.util.hash_pandas_object(pdf["text"], index=False)).sort_values(["h", "text"])
        bags, y = [], []
        for text, label in zip(pdf["text"], pdf["quality"]):
            x, _ = passages(pa.array([text], pa.string()))
            if len(x):
                bags.append(x)
                y.append(label)
        out = io.BytesIO()
        if len(set(y)) == 2:
            np.savez(out, **train(bags, np.array(y, np.float64)))
        return pd.DataFrame({"model": [out.getvalue()]})

    got = rows.groupBy().applyInPandas(learn, "model binary").collect()
    return dict(np.load(io.BytesIO(got[0][0]))) if got and got[0][0] else None


def score(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None) -> DataFrame:
    """A row per document: doc_id, quality (probability of label 1), n_passages, and top_passage, the passage with the most
    attention and the first of equals.

    Texts that are null or empty, and all where the labels don't hold both classes, have null quality and passage. Repeated
    rows score alike; extra columns are ignored; an empty table gives no rows.
    """
    model = model or fit(docs, labels)

    def apply(batches):
        for part in K.slices(batches, "text", SLICE):
            n = part.num_rows
            x, of = passages(part.column(1))
            count = np.bincount(of, minlength=n)
            if model is None:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.nulls(n, pa.float64()), pa.array(count, pa.int32()), pa.nulls(n, pa.int32())], ["doc_id", "quality", "n_passages", "top_passage"])
                continue
            f = forward(x, of, n, model)
            none = ~f["has"]
            order = np.lexsort((-f["attention"], of))
            at = np.searchsorted(of, np.arange(n))
            top = np.zeros(n, np.int64)
            top[f["has"]] = order[at[f["has"]]] - at[f["has"]]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-f["logit"].astype(np.float64))), mask=none), pa.array(count, pa.int32()), pa.array(top.astype(np.int32), mask=none)], ["doc_id", "quality", "n_passages", "top_passage"])

    docs = K.only(docs, "doc_id", "text")
    texts = docs.select(K.integer_id(docs, "doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(apply, "doc_id bigint, quality double, n_passages int, top_passage int")
