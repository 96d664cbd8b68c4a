"""Each method against a brute-force version, an exact round trip or held-out labels."""

from __future__ import annotations

import base64
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontaminate, html_extract, language, line_dedup, near_dedup, quality, secret_scan, textkit, top_k, toxicity

rng = random.Random(3)
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")



@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# 1


def test_top_k_brute(spark):
    gen = np.random.default_rng(4)
    x = gen.normal(size=(700, 12)).astype(np.float32)
    x[50:60] = x[40]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    s = np.round(x.astype(np.float64) @ x.astype(np.float64).T, top_k.DECIMALS)
    for every, options in ((1, {}), (7, {}), (50, {"summary_bytes": 300})):
        got = {(r.query_id, r["rank"]): (r.neighbour_id, r.score) for r in top_k.top_k(df, 7, every=every, shard_rows=64, leaf_rows=8, block_rows=32, **options).collect()}
        assert len(got) == len(range(0, 700, every)) * 7
        for q in range(0, 700, every):
            order = [i for i in np.lexsort((np.arange(700), -s[q])) if i != q][:7]
            assert [got[q, k + 1] for k in range(7)] == [(i, s[q, i]) for i in order]


# 2


def brute_spans(text: str, phrases: set[tuple]) -> list[tuple]:
    words = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    hit = set()
    for n in {len(p) for p in phrases}:
        for k in range(len(words) - n + 1):
            if tuple(w for w, _, _ in words[k : k + n]) in phrases:
                hit.add((k, k + n))
    out: list[list[int]] = []
    for a, b in sorted(hit):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b, words[a][1], words[b - 1][2]) for a, b in out]


def test_decontamination_brute(spark, docs, texts, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    phrases = set()
    for r in bench.collect():
        words = [w.lower() for w in WORD.findall(r.text)]
        n = min(decontaminate.PHRASE_WORDS, len(words))
        phrases |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
    want = {(d, *s) for d, t in texts.items() for s in brute_spans(t, phrases)}
    assert want
    for options in ({}, {"shard_bytes": 3000}, {"block_bytes": 500}):
        assert {tuple(r) for r in decontaminate.removal_spans(docs, bench, **options).collect()} == want


def test_decontaminate_rows(spark):
    """A row loses its own spans only: rows of one id, or of none, aren't cut by each other's, for one block and for many."""
    passage, other = "one two three four five six seven eight nine ten", "alpha beta gamma delta epsilon zeta eta theta"
    clean = "this long text has nothing of the kind in it and its middle must stay as it is, to the last character of all"
    data = [(None, f"before {passage} after"), (None, clean), (1, f"{other}, and {passage}!"), (1, clean), (2, passage), (3, f"é {other} é {other} é")]
    want = sorted([(None, "before  after"), (None, clean), (1, ", and !"), (1, clean), (3, "é  é  é")], key=repr)
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    bench = spark.createDataFrame([(0, passage), (1, other)], "item_id bigint, text string")
    spans = []
    for options in ({}, {"block_bytes": 1}, {"shard_bytes": 1}):
        got = decontaminate.decontaminate(df, bench, **options).collect()
        assert sorted([(r.doc_id, r.text) for r in got], key=repr) == want and all(r.n_chars == len(r.text) for r in got)
        spans.append(sorted(map(tuple, decontaminate.removal_spans(df, bench, **options).collect()), key=repr))
        assert "Exchange" not in decontaminate.decontaminate(df, bench, **options)._jdf.queryExecution().executedPlan().toString()
    assert spans[0] == spans[1] == spans[2] and len(spans[0]) == 6


def test_fm_index():
    for n, kinds in ((1, 2), (50, 2), (400, 3), (2000, 9)):
        text = np.array([rng.randrange(1, kinds) for _ in range(n)] + [0], np.int64)
        sa = decontaminate.suffix_array(text)
        assert [tuple(text[i:]) for i in sa] == sorted(tuple(text[i:]) for i in range(n + 1))
        index = decontaminate.FMIndex(text, kinds, 4)
        found = [tuple(rng.randrange(1, kinds) for _ in range(3)) for _ in range(20)]
        which, lo, hi = index.count(np.array(found).ravel(), np.arange(20) * 3, 3)
        got = {w: sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which.tolist(), lo.tolist(), hi.tolist())}
        for k, p in enumerate(found):
            assert got.get(k, []) == [i for i in range(n - 2) if tuple(text[i : i + 3]) == p]


# 3


def test_language_held_out(spark, docs):
    train, held = docs.where("pmod(xxhash64(text), 2) = 0"), docs.where("pmod(xxhash64(text), 2) = 1")
    model = language.fit(train)
    got = language.identify(held, model).collect()
    kept = [r for r in got if not r.rejected]
    assert len(kept) >= 0.98 * len(got) and sum(r.lang == r.predicted_lang for r in kept) >= 0.97 * len(kept)
    strange = spark.createDataFrame([(1, "日本語の文章はここにあります。これは学習した言語ではない。" * 20, "xx"), (2, "zqx jkv wwq xzj qqk vvz " * 40, "xx"), (3, "123 456 --- !!!", "xx")], "doc_id bigint, text string, lang string")
    assert all(r.rejected for r in language.identify(strange, model).collect())


@pytest.mark.parametrize("out", ["de", "es", "fr"])
def test_language_left_out(spark, out):
    """A language without labels is rejected. English isn't tried: README names it as open."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs.where("pmod(xxhash64(text), 2) = 0").where(F.col("lang") != out))
    held = docs.where("pmod(xxhash64(text), 2) = 1").where(F.col("lang") == out)
    assert language.identify(held, model).where("not rejected").count() < 0.03 * held.count()


def test_language_nearest_centroid(docs):
    """The vectorised judge against a loop over the model's centroids."""
    model = language.fit(docs)
    some = [r.text for r in docs.limit(40).collect()]
    counts = language.gram_counts(pa.array(some))
    lang, cosine, _ = language.judge(pa.array(some), model)
    for k in range(len(some)):
        x = np.log1p(counts[k].astype(float)) * model["idf"]
        x /= np.linalg.norm(x)
        all_ = [float(x @ c) for c in model["centroids"]]
        assert cosine[k] == pytest.approx(max(all_), abs=1e-5) and lang[k] == model["of"][int(np.argmax(all_))]


def plain_grams(text: str) -> Counter:
    """Hashed n-grams by a loop over bytes: any run of other characters is one blank, none at the beginning."""
    data = bytes(textkit.fold(np.frombuffer(text.encode(), np.uint8)))
    codes, out = [], Counter()
    for c in data:
        code = c - 96 if 97 <= c <= 122 else 27 + (c & 0x3F) if c >= 128 else 0
        if code or (codes and codes[-1]):
            codes.append(code)
    for x, y in zip(codes, codes[1:]):
        out[(((x * 91 + y) * 40503) >> 4) % language.BIGRAMS] += 1
    for x, y, z in zip(codes, codes[1:], codes[2:]):
        out[language.BIGRAMS + ((((x * 91 + y) * 91 + z) * 2654435761) >> 9) % language.TRIGRAMS] += 1
    return out


def test_language_brute(spark):
    """The whole query on a small table: n-grams, document frequencies, k-means, cosines and rejection by plain loops."""
    own = random.Random(6)
    speech = {"x": "abcde ", "y": "klmno ", "z": "uvwé ß"}
    data = [(k, lang, "".join(own.choice(speech[lang]) for _ in range(own.randrange(1, 300)))) for k, lang in enumerate(own.choice("xyz") for _ in range(60))]
    data += [(100, "x", None), (101, None, "abcd klmn"), (102, "y", ""), (103, None, "qqq rrr!")]
    df = spark.createDataFrame(data, "doc_id bigint, lang string, text string")
    counts = {k: plain_grams(t or "") for k, _, t in data}
    df_plain = Counter(g for c in counts.values() for g in c)
    got, n = language.document_frequency(df)
    assert n == len(data) and {g: c for g, c in enumerate(got.tolist()) if c} == dict(df_plain)
    idf = np.log((1 + n) / (1 + got)) + 1

    def vector(c):
        x = np.zeros(language.WIDTH)
        for g, k in c.items():
            x[g] = np.log1p(k) * idf[g]
        return x / max(np.linalg.norm(x), 1e-12)

    model = language.fit(df)
    assert model["langs"] == ["x", "y", "z"] and np.allclose(model["idf"], idf, atol=1e-5)
    for lang in "xyz":  # each centroid is the direction of the mean of the texts that are nearest to it
        x = np.stack([vector(counts[k]) for k, own_lang, t in data if own_lang == lang and t and counts[k]])
        c = model["centroids"][model["of"] == model["langs"].index(lang)]
        near = [max(range(len(c)), key=lambda j: float(v @ c[j])) for v in x]
        for j in set(near):
            mean = sum(v for v, m in zip(x, near) if m == j)
            assert np.allclose(mean / np.linalg.norm(mean), c[j], atol=1e-4)
    rows = {r.doc_id: r for r in language.identify(df, model).collect()}
    for k, _, _ in data:
        cosines = [float(vector(counts[k]) @ c) for c in model["centroids"]]
        best = int(np.argmax(cosines))
        floor = model["floors"][model["of"][best]][min(31, int(np.log2(sum(counts[k].values()) + 1)))]
        assert rows[k].similarity == pytest.approx(max(cosines), abs=1e-5)
        if abs(max(cosines) - floor) > 1e-5:
            fine = bool(counts[k]) and max(cosines) >= floor
            assert rows[k].rejected != fine and rows[k].predicted_lang == (model["langs"][model["of"][best]] if fine else None)


# 4


def test_maximal_segments_brute():
    for _ in range(200):
        scores = [rng.choice([-3, -1, -1, -0.5, 2, 1, 4]) for _ in range(rng.randrange(1, 25))]
        total = np.r_[0, np.cumsum(scores)]

        def proper(a, b):  # every prefix and suffix of a maximal segment is positive: its definition by recursion
            best = max(((total[j] - total[i], i, j) for i in range(a, b) for j in range(i + 1, b + 1)), key=lambda x: (x[0], -(x[2] - x[1]), -x[1]), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            return proper(a, best[1]) + [(best[1], best[2] - 1, best[0])] + proper(best[2], b)

        scores = [s + 1e-3 * rng.random() for s in scores]  # no ties
        total = np.r_[0, np.cumsum(scores)]
        at = np.array([k for k, s in enumerate(scores) if s > 0], np.int64)
        want = [(a, b) for a, b, _ in proper(0, len(scores))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(at, total[at], total[at + 1])] == want
        got = toxicity.maximal_segments(at, total[at], total[at + 1])
        assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in proper(0, len(scores)))) and len(got) == len(proper(0, len(scores)))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where("pmod(xxhash64(doc_id), 8) > 0"))
    held = labels.where("pmod(xxhash64(doc_id), 8) = 0").join(docs.select("doc_id", "text"), "doc_id")
    flagged = {r.doc_id for r in toxicity.toxic_passages(held, model=model).select("doc_id").distinct().collect()}
    marks = [(r.doc_id in flagged, r.toxic) for r in held.select("doc_id", "toxic").collect()]
    assert np.mean([f for f, t in marks if t == 1]) > 0.9 and np.mean([f for f, t in marks if t == 0]) < 0.005


# 5


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"), 400)
    held = labels.where("pmod(xxhash64(doc_id), 2) = 1").join(docs.select("doc_id", "text"), "doc_id")
    got = {r.doc_id: r for r in quality.score(held, model=model).collect()}
    right = [(got[r.doc_id].quality > 0.5) == (r.quality == 1) for r in held.select("doc_id", "quality").collect()]
    assert np.mean(right) > 0.95 and all(0 <= r.top_passage < r.n_passages for r in got.values())


def test_attention_gradient():
    gen = np.random.default_rng(2)
    bags = [gen.random((n, quality.WIDTH)) for n in (1, 3, 2, 5)] * 30
    y = np.array([float(b[:, 0].max() > 0.7) for b in bags])
    w = quality.train(bags, y, epochs=60, rate=1e-2)
    f = quality.forward(np.concatenate(bags).astype(np.float64), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags), w)
    assert np.mean((f["logit"] > 0) == (y == 1)) > 0.9
    assert np.allclose(np.bincount(np.repeat(np.arange(len(bags)), [len(b) for b in bags]), weights=f["attention"]), 1)


def test_attention_gradient_numeric():
    """Every derivative against differences of the loss, which a plain loop over documents and passages gives."""
    gen = np.random.default_rng(3)
    bags = [gen.random((n, quality.WIDTH)) for n in (1, 4, 2)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 2.0, 1.0])
    w = {"W": gen.normal(0, 0.1, (quality.WIDTH, quality.HIDDEN)), "b": gen.normal(0, 0.1, quality.HIDDEN), "V": gen.normal(0, 0.3, (quality.HIDDEN, quality.GATE)), "U": gen.normal(0, 0.3, (quality.HIDDEN, quality.GATE)), "a": gen.normal(0, 0.3, quality.GATE), "c": gen.normal(0, 0.3, quality.HIDDEN), "d": np.array([0.2])}
    x, of = np.concatenate(bags), np.repeat(np.arange(3), [1, 4, 2])

    def logit(bag, w):
        h = [[max(0.0, sum(p[i] * w["W"][i][j] for i in range(len(p))) + w["b"][j]) for j in range(quality.HIDDEN)] for p in bag]
        e = [sum(np.tanh(sum(v * w["V"][j][g] for j, v in enumerate(r))) / (1 + np.exp(-sum(v * w["U"][j][g] for j, v in enumerate(r)))) * w["a"][g] for g in range(quality.GATE)) for r in h]
        top = max(e)
        share = [np.exp(v - top) / sum(np.exp(u - top) for u in e) for v in e]
        return sum(w["c"][j] * sum(s * r[j] for s, r in zip(share, h)) for j in range(quality.HIDDEN)) + w["d"][0], share

    plain = [logit(b, w) for b in bags]
    f = quality.forward(x, of, 3, w)
    assert np.allclose(f["logit"], [v for v, _ in plain]) and np.allclose(f["attention"], [s for _, share in plain for s in share])
    loss = lambda w: float(np.mean(weight * np.logaddexp(0, np.where(y == 1, -1, 1) * quality.forward(x, of, 3, w)["logit"])))
    for name, g in quality.gradients(x, of, y, weight, w).items():
        for at in [tuple(gen.integers(0, n) for n in g.shape) for _ in range(12)]:
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-7)


def test_quality_brute(spark):
    """The whole query: passages of so many words, their features, attention and score by plain loops, for a given model."""
    gen = np.random.default_rng(9)
    model = quality.train([gen.random((n, quality.WIDTH)) for n in (1, 2, 3)] * 4, np.array([0.0, 1.0, 1.0] * 4), epochs=3)
    data = [(0, " ".join(f"Word{k % 7}, x-{k}" for k in range(90))), (1, "one two"), (2, "!!"), (3, ""), (4, None), (None, "ünï 3 words"), (5, "a " * 48 + "\n" + "b " * 48)]
    rows = sorted(quality.score(spark.createDataFrame(data, "doc_id bigint, text string"), model=model).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    for (_, text), r in zip(sorted(data, key=lambda x: (x[0] is None, x[0])), rows):
        data_ = (text or "").encode()
        words = [(m.start(), m.group()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data_)]
        cuts = [0, *(at for k, (at, _) in enumerate(words) if k and k % quality.PASSAGE_WORDS == 0), len(data_)] if data_ else []
        features = []
        for a, b in zip(cuts, cuts[1:]):
            kinds = [int(quality._class[c]) for c in data_[a:b]]
            x = np.zeros(quality.WIDTH)
            for p, q in zip(kinds, kinds[1:]):
                x[p * quality.CLASSES + q] += 1
            hashes = textkit.word_hashes(pa.array([" ".join(w.decode() for at, w in words if a <= at < b)]))[0]
            for h in hashes.tolist():
                x[quality.CLASSES**2 + h % quality.WORDS] += 1
            for part in (x[: quality.CLASSES**2], x[quality.CLASSES**2 :]):
                part /= max(part.sum(), 1)
            features.append(np.sqrt(x))
        assert r.n_passages == len(features)
        if not features:
            assert r.quality is None and r.top_passage is None
            continue
        h = [np.maximum(x @ model["W"] + model["b"], 0) for x in features]
        e = np.array([float((np.tanh(v @ model["V"]) / (1 + np.exp(-(v @ model["U"])))) @ model["a"]) for v in h])
        share = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        assert r.quality == pytest.approx(1 / (1 + np.exp(-(sum(s * v for s, v in zip(share, h)) @ model["c"] + model["d"][0]))), abs=1e-4)
        assert share[r.top_passage] == pytest.approx(share.max(), abs=1e-5)


# 6


def brute_lines(texts: dict[int, str], least: int) -> set[tuple[int, int]]:
    seq = {d: [(no, line) for no, line in enumerate(t.split("\n")) if line.strip(" \t\f\r")] for d, t in texts.items()}
    count = lambda s: len(re.findall(r"[^ \t\f\r]+", s))
    gone = set()
    places: dict[str, list] = {}
    for d in sorted(seq):
        for k, (_, line) in enumerate(seq[d]):
            places.setdefault(line, []).append((d, k))
    for line, where in places.items():
        for (d, i), (e, j) in itertools.combinations(where, 2):
            if i and j and seq[d][i - 1][1] == seq[e][j - 1][1]:
                continue
            n = words = 0
            while i + n < len(seq[d]) and j + n < len(seq[e]) and seq[d][i + n][1] == seq[e][j + n][1]:
                words += count(seq[d][i + n][1])
                n += 1
            if words >= least:
                gone |= {(e, seq[e][j + k][0]) for k in range(n)}
    return gone


def test_line_dedup_brute(spark, docs, texts):
    assert {(r.doc_id, r.line_no) for r in line_dedup.deleted_lines(docs).collect()} == brute_lines(texts, line_dedup.MIN_WORDS)
    small = {k: "\n".join(rng.choice(["a b", "c d e", "f", "", "g h"]) for _ in range(rng.randrange(12))) for k in range(40)}
    df = spark.createDataFrame(list(small.items()), "doc_id bigint, text string")
    assert {(r.doc_id, r.line_no) for r in line_dedup.deleted_lines(df, 4).collect()} == brute_lines(small, 4)


# 7


def test_secrets_brute(spark, texts):
    planted = ["AKIA" + "A1B2" * 4, "password: hunter2hunter2hunter2 and again PASSWD='aaaaaaaaaaaaaaaaaaaa'", "ghp_" + "a" * 36, "see https://me:pw@example.org/x and http://a:b@c", "-----BEGIN RSA PRIVATE KEY", "xoxb-1234567890-abc", "AKIA" + "a1b2" * 4, "0123456789abcdef" * 2 + "01234567", "eyJabcdefgh.abcdefghi.abcdefghij", "é AIza" + "x" * 35]
    texts = texts | {10**6 + k: t for k, t in enumerate(planted)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = {(d, name, k, m.start(), m.end()) for d, t in texts.items() for name, p in secret_scan.RULES.items() for k, m in enumerate(re.finditer(p, t, re.ASCII))}
    assert {(r.doc_id, r.rule, r.match_no, r.start_char, r.end_char) for r in secret_scan.scan(docs).collect()} == want and want


@pytest.mark.parametrize(("pattern", "holds", "lacks"), [("abc[de]f", ["xxabcdf"], ["abc", "abxcdf"]), ("(?i)Key=", ["my KEY=1"], ["kay="]), ("a+b", ["aab"], []), ("foo|barb", ["foo", "barb"], ["fo", "bar"])])
def test_trigram_queries(pattern, holds, lacks):
    query = secret_scan.trigram_query(pattern)
    wanted = sorted(secret_scan.trigrams(query))
    table = np.zeros(1 << 24, bool)
    table[[int.from_bytes(t.encode(), "big") for t in wanted]] = True
    got = secret_scan.TrigramIndex(*textkit.flat(pa.array(holds + lacks)), wanted, table).texts(query).tolist()
    assert got == list(range(len(holds))) if query is not secret_scan.ANY else got == list(range(len(holds + lacks)))


# 8


def plain_match(a: tuple, b: tuple) -> int:
    """Simple tree matching by its definition; trees are (tag, children)."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_match(x, y))
    return 1 + m[-1][-1]


def test_tree_matching_brute():
    def grow(depth):
        return (rng.choice("abc"), tuple(grow(depth - 1) for _ in range(rng.randrange(4))) if depth else ())

    shapes = html_extract.Shapes()
    number = lambda t: shapes.of(t[0], tuple(number(c) for c in t[1]))
    for _ in range(150):
        a, b = ("r", (grow(3), grow(3))), ("r", (grow(3), grow(2), grow(3)))
        x, y = number(a), number(b)
        pairs = shapes.align(x, y)
        assert shapes.match(x, y) == plain_match(a, b) == len(pairs) == len(dict(pairs)) == len({q for _, q in pairs})
        tags = [[], []]
        for t, out in ((a, tags[0]), (b, tags[1])):
            todo = [t]
            while todo:
                n = todo.pop()
                out.append(n[0])
                todo.extend(reversed(n[1]))
        assert all(tags[0][p] == tags[1][q] for p, q in pairs)


def test_wrapper(spark):
    def page(k):
        nav = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "About"))
        body = "".join(f"<p>Paragraph {k}.{j} has its own words {rng.random()}</p>" for j in range(k % 5 + 1))
        return f"<html><head><title>Title {k}</title><script>var x='<p>no</p>'</script></head><body><ul>{nav}</ul><div>{body}</div><footer>&copy; Some Site</footer></body></html>"

    df = spark.createDataFrame([(k, f"https://example.org/{k}", page(k)) for k in range(20)], "page_id bigint, url string, html string")
    for r in html_extract.extract(df).collect():
        lines = r.content.split("\n")
        assert lines[0] == f"Title {r.page_id}" and len(lines) == 2 + r.page_id % 5 and all(x.startswith(f"Paragraph {r.page_id}.") for x in lines[1:]) and r.n_template == 4
    assert {tuple(r) for r in html_extract.extract(df, broadcast_bytes=0).collect()} == {tuple(r) for r in html_extract.extract(df).collect()}


@pytest.mark.parametrize("copies", [2, 4])
def test_copied_articles_are_content(spark, copies):
    """Copies of an article under their own navigation on a small host keep it; what all pages share still goes."""
    own = random.Random(copies)
    words = lambda n: " ".join(own.choice("abcdefgh") + str(own.randrange(9000)) for _ in range(n))
    article = [words(30) for _ in range(5)]

    def page(k):
        nav = "".join(f"<li>{words(1)}</li>" for _ in range(6))
        body = "".join(f"<p>{p}</p>" for p in (article if k < copies else [words(30) for _ in range(5)]))
        return f"<html><body><ul>{nav}</ul><article>{body}</article><footer>&copy; Some Site</footer></body></html>"

    df = spark.createDataFrame([(k, f"https://example.org/{k}", page(k)) for k in range(12)], "page_id bigint, url string, html string")
    for r in html_extract.extract(df).collect():
        assert r.n_template == 1 and "Some Site" not in r.content
        assert r.page_id >= copies or all(p in r.content for p in article)


def plain_extract(pages: list[tuple[int, str, str]]) -> dict[int, tuple[str, int, int]]:
    """The whole query by loops over hosts and pages; only the parser and the matching, tested above, are shared."""
    out, hosts = {}, {}
    for k, url, source in pages:
        hosts.setdefault(re.match(r"[a-z]+://([^/]*)", url).group(1), []).append((k, html_extract.Page(source, html_extract.Shapes())))
    for own in hosts.values():
        nodes = sorted(len(p.tag) for _, p in own)
        median = nodes[(len(nodes) + 1) // 2 - 1]
        pivot = min(own, key=lambda x: (abs(len(x[1].tag) - median), x[0]))[1]
        placed = {}
        for k, page in own:
            shapes = html_extract.Shapes()
            shape, tags, parents = html_extract.tree(html_extract.layout(page), shapes)
            names = html_extract.slots(shape, tags, parents, html_extract.tree(html_extract.layout(pivot), shapes)[0], shapes)
            placed[k] = list(zip(names, [t for t in page.text if t is not None]))
        words = {k: {t: len(t.split(" ")) for _, t in x} for k, x in placed.items()}
        family = {k: k for k, x in words.items() if x}
        if len(own) <= html_extract.SMALL_HOST:
            for a, b in itertools.combinations(sorted(family), 2):
                both = sum(w for t, w in words[b].items() if t in words[a])
                if both >= html_extract.COPY_SHARE * (sum(words[a].values()) + sum(words[b].values()) - both):
                    family = {k: family[a] if f == family[b] else f for k, f in family.items()}
        else:
            for k in family:
                texts = [t for _, t in placed[k]]
                family[k] = html_extract.sketch([html_extract.value_hash(t) for t in texts], [t.count(" ") + 1 for t in texts])
        total, held = {}, {}
        for k, x in placed.items():
            for name, t in x:
                total.setdefault(name, set()).add(family[k])
                held.setdefault((name, t), set()).add(family[k])
        constant = set()
        for (name, t), f in held.items():
            n, m, share = len(f), len(total[name]), html_extract.CONSTANT_SHARE
            q = n / m
            if n > 1 and q > share and n >= 1 + np.log2(len(set(family.values()))):
                gain = q * np.log(q / share) + ((1 - q) * np.log((1 - q) / (1 - share)) if q < 1 else 0)
                if m * gain >= -np.log(html_extract.SIGNIFICANCE):
                    constant.add((name, t))
        for k, page in own:
            pieces, fresh, left = [], True, list(placed[k])
            for i, t in enumerate(page.text):
                if t is None:
                    continue
                name, _ = left.pop(0)
                fresh |= page.breaks[i]
                if (name, t) not in constant:
                    pieces += ["\n" if fresh and pieces else " " if pieces else "", t]
                    fresh = False
            n = sum(x not in constant for x in placed[k])
            out[k] = ("".join(pieces), n, len(placed[k]) - n)
    return out


def test_extract_brute(spark, small):
    own = random.Random(12)
    words = lambda n: " ".join(own.choice("abcdefgh") + str(own.randrange(9000)) for _ in range(n))
    article = words(40)

    def page(k, n):
        menu = "".join(f"<li><a>{x}</a></li>" for x in ("Home", "News", "Help")[: 2 + k % 2])
        body = "".join(f"<p>{words(12)}<b>{words(2)}</b></p>" for _ in range(1 + k % 4)) + (f"<p>{article}</p>" if k in (2, 5) else "")
        return f"<html><title>T{k}</title><body><ul>{menu}</ul><div>{body}</div><footer>Site of {n} pages</footer></body></html>"

    pages = [(n * 100 + k, f"http://h{n}.org/{k}", page(k, n)) for n in (1, 2, 5, 9, 30) for k in range(n)]
    pages += [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").withColumn("page_id", F.col("page_id") + 10**6).withColumn("url", F.lower("url")).collect()]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: (r.content, r.n_content, r.n_template) for r in html_extract.extract(df).collect()}
    want = plain_extract(pages)
    assert got == want and sum(t for _, _, t in want.values()) > 100


# 9


def test_near_pairs_brute(spark):
    """Every pair within the radius is found, on clustered fingerprints with biased, correlated bits."""
    gen = np.random.default_rng(5)
    centres = gen.integers(0, 1 << 63, 60)
    prints = [(i, int(centres[i % 60]) ^ int(sum(1 << int(b) for b in set(gen.integers(0, 63, gen.integers(0, 9))))), 0, 0) for i in range(600)]
    prints = list({p[1]: p for p in prints}.values())  # those of equal f0 are tested below
    assert len(prints) > 500
    df = spark.createDataFrame(prints, "rep bigint, f0 bigint, f1 bigint, f2 bigint")
    got = {(r.a, r.b) for r in near_dedup.near_pairs(df, 8, 32).collect()}
    assert got == {tuple(sorted((i, j))) for (i, x, _, _), (j, y, _, _) in itertools.combinations(prints, 2) if (x ^ y).bit_count() <= 8}


def test_equal_first_words_stay_linked(spark):
    """Fingerprints of one f0: the components are those of all pairs, with few links where all are near the smallest."""
    gen = np.random.default_rng(8)
    bases = [int(x) for x in gen.integers(0, 1 << 62, 4)]
    prints = [(i, 7 if i < 150 else (1 << 50) - 1, bases[i % 4] ^ int(sum(1 << int(b) for b in set(gen.integers(0, 62, gen.integers(0, 20))))), bases[(i + 1) % 4]) for i in range(200)]
    df = spark.createDataFrame(prints, "rep bigint, f0 bigint, f1 bigint, f2 bigint")
    links = [(r.a, r.b) for r in near_dedup.near_pairs(df, 8, 32).collect()]
    every = [(i, j) for (i, f, x, u), (j, g, y, v) in itertools.combinations(prints, 2) if f == g and (x ^ y).bit_count() + (u ^ v).bit_count() <= 32]

    def groups(pairs):
        of = list(range(200))
        for a, b in pairs:
            of = [of[a] if x == of[b] else x for x in of]
        return {frozenset(k for k in range(200) if of[k] == g) for g in of}

    assert set(links) <= set(every) and groups(links) == groups(every)
    close = spark.createDataFrame([(i, 7, 1 << (i % 60), 0) for i in range(60)], "rep bigint, f0 bigint, f1 bigint, f2 bigint")
    assert near_dedup.near_pairs(close, 8, 32).count() == 59


def test_thresholds_add_up():
    shares = [np.linspace(0.01, 1, 17) for _ in range(4)]
    cost, t = near_dedup.allocate([16] * 4, shares, 1000, 8)
    assert sum(t) == 8 - 4 + 1 and min(t) >= -1
    best = min(sum(1000 * sum(__import__("math").comb(16, d) for d in range(x + 1)) + 1e6 * shares[i][x] * near_dedup.CANDIDATE_COST if x >= 0 else 0 for i, x in enumerate(c)) for c in itertools.product(range(-1, 9), repeat=4) if sum(c) == 5)
    assert cost == pytest.approx(best)


def test_near_copies_are_caught(spark, texts):
    long = [t for t in texts.values() if len(WORD.findall(t)) > 150][:40]
    changed = []
    for t in long:
        words = t.split(" ")
        for k in rng.sample(range(len(words)), max(1, len(words) // 100)):
            words[k] = "changedword"
        changed.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)] + [(1000 + i, t) for i, t in enumerate(changed)], "doc_id bigint, text string")
    group = {r.doc_id: r.kept_doc_id for r in near_dedup.near_duplicates(df).collect()}
    same = [group.get(1000 + i, 1000 + i) == group.get(i, i) for i in range(len(long))]
    assert np.mean(same) >= 0.9
    lone = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij") + str(rng.randrange(5000)) for _ in range(100))) for i in range(300)], "doc_id bigint, text string")
    assert near_dedup.near_duplicates(lone).count() == 0


# 10


@pytest.fixture(scope="module")
def reference_encoding():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(docs, texts, reference_encoding):
    for r in bpe.round_trip(docs).collect():
        assert r.tokens == reference_encoding.encode_ordinary(texts[r.doc_id]) and r.same and r.n_tokens == len(r.tokens)


def test_bpe_long_pretokens(reference_encoding):
    hard = ["a" * 20_001, "ab" * 9_000, "".join(rng.choice("abcdeXYZ") for _ in range(30_000)), "é" * 4_001, " " * 5_000 + "x", "日本" * 3_000, "", "<|endoftext|>", "�\x00\n\n\n  "]
    tokenizer = bpe.load()
    tokens, begin = tokenizer.encode(hard)
    for k, t in enumerate(hard):
        mine = tokens[begin[k] : begin[k + 1]]
        assert mine.tolist() == reference_encoding.encode_ordinary(t) and tokenizer.decode(mine.astype(np.int64)).tobytes().decode() == t


def test_bpe_forgets(texts, reference_encoding, monkeypatch):
    """Tokens are the same however few pre-tokens a worker may remember."""
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    tokenizer, some = bpe.Tokenizer({t: r for r, t in enumerate(bpe.load().tokens)}), list(texts.values())[:60]
    for t in some:
        assert tokenizer.encode([t])[0].tolist() == reference_encoding.encode_ordinary(t)


def test_bpe_decode(spark, reference_encoding):
    """Tokens that split a character, empty and null lists; ids beyond the vocabulary are refused."""
    whole = reference_encoding.encode_ordinary("日本語 🙂 text")
    data = [(whole,), (whole[:1],), ([],), (None,), (whole[1:],)]
    got = [r.decoded for r in bpe.decode(spark.createDataFrame(data, "tokens array<int>").coalesce(1)).collect()]
    assert got == ["日本語 🙂 text", reference_encoding.decode_bytes(whole[:1]).decode("utf-8", "replace"), "", None, reference_encoding.decode_bytes(whole[1:]).decode("utf-8", "replace")]
    for bad in ([-1], [10**6]):
        with pytest.raises(Exception, match="token ids"):
            bpe.decode(spark.createDataFrame([(bad,)], "tokens array<int>")).collect()


def test_rank_queue():
    queue, held = bpe.RankQueue(50_000), Counter()
    for _ in range(3000):
        if held and rng.random() < 0.4:
            rank, got = queue.pop()
            assert rank == min(held) and sum(map(len, got)) == held.pop(rank)
        else:
            r = rng.randrange(50_000)
            queue.add(r, np.zeros(1, np.int32))
            held[r] += 1
