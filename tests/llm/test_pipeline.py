"""The pipeline over whole documents against a brute-force chain of its five stages."""

from __future__ import annotations

import base64
import itertools

import pyarrow as pa
import tiktoken

import corpus_pipeline
from siltstone.llm import bpe, decontaminate, language, line_dedup, near_dedup
from tests.llm.test_methods import WORD, brute_lines, brute_spans


def test_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    model = language.fit(docs)
    texts = {d: t for d, t in texts.items() if language.judge(pa.array([t]), model)[2][0]}

    gone = brute_lines(texts, line_dedup.MIN_WORDS)
    left = {d: "\n".join(x for no, x in enumerate(t.split("\n")) if (d, no) not in gone) for d, t in texts.items()}
    texts = {d: t for d, t in left.items() if t == texts[d] or t.strip()}

    prints = {d: tuple(int(x) & ((1 << 64) - 1) for x in f[0]) for d, t in texts.items() if len(f := near_dedup.fingerprints(pa.array([t]))[1])}
    first = {d: d for d in texts}
    for a, b in itertools.combinations(sorted(prints), 2):
        gaps = [(x ^ y).bit_count() for x, y in zip(prints[a], prints[b])]
        if gaps[0] <= near_dedup.RADIUS and sum(gaps) <= near_dedup.VERIFY_RADIUS:
            low, high = sorted((first[a], first[b]))
            first = {d: low if f == high else f for d, f in first.items()}
    texts = {d: t for d, t in texts.items() if first[d] == d}

    phrases = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        words = [w.lower() for w in WORD.findall(r.text)]
        n = min(decontaminate.PHRASE_WORDS, len(words))
        phrases |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
    clean = {}
    for d, t in texts.items():
        cut, at = "", 0
        for _, _, a, b in brute_spans(t, phrases):
            cut, at = cut + t[at:a], b
        cut += t[at:]
        if cut == t or WORD.search(cut):
            clean[d] = cut

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, small)
    assert got.columns == [*docs.columns, "tokens", "n_tokens", "decoded"]
    rows = {r.doc_id: r for r in got.collect()}
    assert {d: r.text for d, r in rows.items()} == clean
    for d, r in rows.items():
        assert r.tokens == library.encode_ordinary(r.text) and r.decoded == r.text and r.n_tokens == len(r.tokens)
        assert r.n_chars == len(r.text)
