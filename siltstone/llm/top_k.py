"""Exact top-k inner-product search with a ball tree per shard.

Vectors fall into cells by the signs of their leading principal components about the medians, so that a shard holds
vectors that lie together; a cell above SHARD_ROWS is split by hash. Each shard has a ball tree. A query first searches its
own shard, then in turns the shards with the best inner-product upper bounds q.c + |q| r, as far as these exceed its k-th
score so far: each turn begins from the k-th scores that the turns before it left. Queries travel to the trees, a tree to
one task a turn. Inside a tree, nodes are cut by the same bound and leaves visited in its order.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K

TOP = 10
SHARD_ROWS = 4096
LEAF_ROWS = 128
#: Queries that search a tree together.
BLOCK_ROWS = 8192
#: The queries are the vectors whose id is divisible by this.
QUERY_EVERY = 50
#: Places, by bound, of the shards that a query asks in each turn after its own.
TURNS = (0, 2, 16, 1 << 62)
#: Bytes of shard summaries that one turn holds; more shards are asked in blocks, one after the other.
SUMMARY_BYTES = 32 << 20
#: Scores are rounded to so many decimals; equal scores are ordered by id.
DECIMALS = 6
#: What rounding and floating-point sums can add to a score.
SLACK = 2e-6


def build_tree(ids: np.ndarray, x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A ball tree over unit-free vectors: nodes in level order, children after their parents, leaves as ranges of rows."""
    order = np.lexsort((ids,))
    nodes = [(0, len(ids))]
    parents, leaf, centres, radii = [-1], [], [], []
    at = 0
    while at < len(nodes):
        a, b = nodes[at]
        rows = order[a:b]
        p = x[rows].astype(np.float64)
        c = p.mean(axis=0)
        far = ((p - c) ** 2).sum(axis=1)
        centres.append(c)
        radii.append(np.sqrt(far.max()))
        split = b - a > leaf_rows and far.max() > 0
        leaf.append(not split)
        if split:
            one = p[int(far.argmax())]
            two = p[int(((p - one) ** 2).sum(axis=1).argmax())]
            half = (b - a) // 2
            order[a:b] = rows[np.argpartition(p @ (one - two), half)]
            nodes += [(a, a + half), (a + half, b)]
            parents += [at, at]
        at += 1
    return {"ids": ids[order], "x": x[order], "begin": np.array([n[0] for n in nodes]), "end": np.array([n[1] for n in nodes]), "parent": np.array(parents), "leaf": np.array(leaf), "centre": np.array(centres), "radius": np.array(radii)}


def pack(tree: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree)
    return out.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(blob)))


def search(queries: np.ndarray, q: np.ndarray, best: np.ndarray, scores: np.ndarray, tree: dict[str, np.ndarray], floor: np.ndarray | None = None) -> None:
    """Bring best (ids, -1 where open) and scores (-inf there), both of k columns in order, up to date with one tree. floor has
    the k-th scores that other trees gave: what is below is left out."""
    norm = np.sqrt((q * q).sum(axis=1))
    floor = np.full(len(q), -np.inf) if floor is None else floor
    # from the root down: a node below a query's k-th score ends the branch, and its children get no bound
    leaf, parent = tree["leaf"], tree["parent"]
    bound = np.full((len(q), len(leaf)), -np.inf)
    open_nodes = [np.arange(len(q))]
    for node in range(len(leaf)):
        rows = open_nodes[node]
        if len(rows):
            b = q[rows] @ tree["centre"][node] + norm[rows] * tree["radius"][node] + SLACK
            bound[rows, node] = b
            rows = rows[b >= np.maximum(scores[rows, -1], floor[rows])]
        children = np.flatnonzero(parent == node) if not leaf[node] else ()
        open_nodes += [rows] * len(children)
    leaves = np.flatnonzero(leaf)
    bound = bound[:, leaves]
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(len(leaves)):
        chosen = order[:, turn]
        now = bound[np.arange(len(q)), chosen]
        open_ = np.flatnonzero((now > -np.inf) & (now >= np.maximum(scores[:, -1], floor)))
        if not len(open_):
            break  # bounds fall with the turns and k-th scores only rise
        for which in np.unique(chosen[open_]):
            rows = open_[chosen[open_] == which]
            a, b = tree["begin"][leaves[which]], tree["end"][leaves[which]]
            for lo in range(a, b, 4096):  # a leaf is larger only where all its vectors are equal
                ids = tree["ids"][lo : min(b, lo + 4096)]
                s = np.round(q[rows] @ tree["x"][lo : lo + len(ids)].astype(np.float64).T, DECIMALS)
                fits = (s >= np.maximum(scores[rows, -1], floor[rows])[:, None]) & (queries[rows, None] != ids)
                some = np.flatnonzero(fits.any(axis=1))
                if not len(some):
                    continue
                into = rows[some]
                all_scores = np.concatenate([scores[into], np.where(fits[some], s[some], -np.inf)], axis=1)
                all_ids = np.concatenate([best[into], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
                first = np.lexsort((all_ids, -all_scores), axis=1)[:, : best.shape[1]]
                top = np.take_along_axis(all_scores, first, axis=1)
                scores[into], best[into] = top, np.where(top > -np.inf, np.take_along_axis(all_ids, first, axis=1), -1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(id, v) rows that can be searched, one for each id, and their dimension: the most common one, the least of equals."""
    vectors = K.only(vectors, id_column, vector_column)
    rows = vectors.select(K.integer_id(vectors, id_column).alias("id"), F.col(f"`{vector_column}`").cast("array<float>").alias("v"))
    fine = rows.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < 1e18)")
    dims = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    width = dims[0]["d"] if dims else 0
    return fine.where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v")), width


def sharded(rows: DataFrame, width: int, shard_rows: int) -> DataFrame:
    """(id, v, shard): cells of the leading principal components, split by hash where they hold more than shard_rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width)
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * (width + 1) + 1)), pa.array(np.r_[n, total, square.ravel()])], ["k", "s"])

    got = {r["k"]: r["s"] for r in rows.select("v").mapInArrow(moments, "k bigint, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    n = got[0]
    levels = min(width, max(0, int(np.log2(max(n / shard_rows, 1)))))
    mean = np.array([got[1 + i] for i in range(width)]) / n
    square = np.array([got[1 + width + i] for i in range(width * width)]).reshape(width, width) / n
    axes = np.linalg.eigh(square - np.outer(mean, mean))[1][:, ::-1][:, :levels]
    if levels:
        projected = [f"aggregate(zip_with(v, array({', '.join(f'{c:.9g}D' for c in axes[:, j])}), (a, b) -> a * b), 0D, (s, x) -> s + x)" for j in range(levels)]
        medians = rows.selectExpr(*(f"percentile_approx({p}, 0.5, 1000) AS m{j}" for j, p in enumerate(projected))).first()
        rows = rows.withColumn("cell", F.expr(" + ".join(f"if({p} > {medians[j]!r}D, {1 << j}L, 0L)" for j, p in enumerate(projected))))
    else:
        rows = rows.withColumn("cell", F.lit(0).cast("bigint"))
    rows = K.materialise(rows)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).alias("pieces"))
    return rows.join(sizes, "cell").select("id", "v", F.expr("cell * 4294967296 + pmod(xxhash64(id), pieces)").alias("shard"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of each query_id with the highest score, the smallest neighbour_id of equals, and their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id"))).where(F.col("rank") <= k)


def _summaries(trees: DataFrame, most_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shards, centres, radii) of all trees, in blocks of bounded size."""
    rows, size = [], 0
    for r in trees.select("shard", "centre", "radius").toLocalIterator():
        rows.append(r)
        size += 8 * len(r.centre) + 16
        if size >= most_bytes:
            yield np.array([x.shard for x in rows]), np.array([x.centre for x in rows]), np.array([x.radius for x in rows])
            rows, size = [], 0
    if rows:
        yield np.array([x.shard for x in rows]), np.array([x.centre for x in rows]), np.array([x.radius for x in rows])


def top_k(vectors: DataFrame, k: int = TOP, id_column: str = "vec_id", vector_column: str = "embedding", every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, summary_bytes: int = SUMMARY_BYTES) -> DataFrame:
    """(query_id, neighbour_id, score, rank): for each vector whose id is divisible by every (all with 1) the k others, of all
    vectors, with the largest inner products, exactly.

    The score is rounded to DECIMALS; equal scores are ordered by id. Rows with a null id, a null, empty or non-finite
    vector, or another dimension than the most common one take no part. Rows that share an id are one vector, the least of
    them. Fewer than k others give fewer rows; an empty table gives none. Extra columns are ignored.
    """
    schema = "query_id bigint, neighbour_id bigint, score double, rank int"
    rows, width = clean(vectors, id_column, vector_column)
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = sharded(rows, width, shard_rows)

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.float32), leaf_rows)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "centre": [tree["centre"][0]], "radius": [float(tree["radius"][0])], "tree": [pack(tree)]})

    trees = K.materialise(rows.groupBy("shard").applyInPandas(plant, "shard bigint, centre array<double>, radius double, tree binary"))
    found_schema = "query_id bigint, neighbour_id bigint, score double"

    def listed(ids: np.ndarray, best: np.ndarray, scores: np.ndarray) -> list[pa.Array]:
        who, place = np.nonzero(scores > -np.inf)
        return [pa.array(ids[who]), pa.array(best[who, place]), pa.array(scores[who, place])]

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                tree = unpack(blob.as_py())
                asking = np.flatnonzero(tree["ids"] % every == 0)
                for a in range(0, len(asking), block_rows):
                    some = asking[a : a + block_rows]
                    ids, x = tree["ids"][some], tree["x"][some]
                    best, scores = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -np.inf)
                    search(ids, x.astype(np.float64), best, scores, tree)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * k), pa.StructArray.from_arrays([pa.array(best.ravel()), pa.array(scores.ravel())], ["neighbour_id", "score"]))
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), shard)), v, lists], ["id", "home", "v", "found"])

    home = K.materialise(trees.select("shard", "tree").mapInArrow(at_home, "id bigint, home bigint, v array<float>, found array<struct<neighbour_id:bigint,score:double>>"))
    queries = home.select("id", "home", "v")
    top = home.select(F.col("id").alias("query_id"), F.inline("found")).where("neighbour_id >= 0")
    blocks = _summaries(trees, summary_bytes)
    summary, more = next(blocks), next(blocks, None)
    turns = list(zip(TURNS[:-1], TURNS[1:])) if more is None else [(0, TURNS[-1])]
    before = None
    while summary is not None:
        for low, high in turns:
            if low >= len(summary[0]):
                break

            def ask(batches: Iterator[pa.RecordBatch], summary=summary, low=low, high=high) -> Iterator[pa.RecordBatch]:
                """Each query for each shard of its turn that can still better its k-th score."""
                shards, centres, radii = summary
                step = max(1, (4 << 20) // len(shards))
                for batch in batches:
                    for a in range(0, batch.num_rows, step):
                        part = batch.slice(a, step)
                        x, least = _matrix(part.column(2), width), part.column(3).to_numpy()
                        bound = x @ centres.T + np.sqrt((x * x).sum(axis=1))[:, None] * radii + SLACK
                        bound[part.column(1).to_numpy()[:, None] == shards] = -np.inf
                        order = np.argsort(-bound, axis=1, kind="stable")[:, low : min(high, len(shards))]
                        go, place = np.nonzero((now := np.take_along_axis(bound, order, axis=1)) >= np.maximum(least, -1e300)[:, None])
                        del now
                        rows = pa.array(go)
                        yield pa.RecordBatch.from_arrays([pa.array(shards[order[go, place]]), part.column(0).take(rows), part.column(2).take(rows), part.column(3).take(rows)], ["shard", "id", "v", "least"])

            least = top.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            known = queries.join(least, queries["id"] == least["query_id"], "left").select("id", "home", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
            asked = K.materialise(known.mapInArrow(ask, "shard bigint, id bigint, v array<float>, least double"))
            wanted = trees.select("shard", "tree").join(asked.select(F.col("shard").alias("s")).distinct(), F.col("shard") == F.col("s"), "left_semi")
            stream = wanted.selectExpr("shard", "null AS id", "null AS v", "null AS least", "tree").unionByName(asked.withColumn("tree", F.lit(None).cast("binary")))
            stream = stream.repartition("shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first())

            def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                tree: dict[str, np.ndarray] = {}
                for batch in batches:
                    isroot = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
                    edges = np.unique(np.r_[0, np.flatnonzero(isroot), np.flatnonzero(isroot) + 1, batch.num_rows])
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                        if isroot[a]:
                            tree = unpack(batch.column(4)[a].as_py())
                            continue
                        for at in range(a, b, block_rows):
                            part = batch.slice(at, min(block_rows, b - at))
                            ids, floor = part.column(1).to_numpy(), part.column(3).to_numpy()
                            best, scores = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -np.inf)
                            search(ids, _matrix(part.column(2), width), best, scores, tree, floor)
                            yield pa.RecordBatch.from_arrays(listed(ids, best, scores), ["query_id", "neighbour_id", "score"])

            top = before = K.materialise(_best(top.unionByName(stream.mapInArrow(visit, found_schema)), k).drop("rank"), before)
        summary, more = more, next(blocks, None)
    return _best(top, k).select("query_id", "neighbour_id", "score", F.col("rank").cast("int"))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_dot_product(a.e, b.e), {DECIMALS}) AS score FROM v a JOIN v b ON a.vec_id % {QUERY_EVERY} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank FROM s)
SELECT query_id, neighbour_id, score, rank FROM r WHERE rank <= {TOP}
"""
