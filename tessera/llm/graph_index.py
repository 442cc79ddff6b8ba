"""Approximate nearest neighbours: a robust-pruned directed graph over each shard, searched by beam.

Equal vectors are one node (a query can need no more than its k + 1 smallest ids). Nodes are dealt to
shards of about ``SHARD_ROWS`` by hash; in a shard, a greedy search from the medoid proposes each
node's neighbours, and relaxed distance pruning keeps diverse edges (Vamana; Subramanya et al., 2019):
an edge to x goes if a kept neighbour is ``alpha`` times nearer to x than the node is. Reverse edges
are added and pruned alike. Queries travel in blocks to every shard, a beam search answers each, and
the shards' nearest are merged.

Vectors that are null, zero or hold null or non-finite components take no part; vectors of different
lengths never meet. Rows of one vec_id are one candidate, with the smallest of its vectors. Graphs are
built and searched in single precision, on vectors less their shard's median and over its median spread (both in double, so that
neither an offset, nor a large or tiny scale, nor an outlier is harmful), by differences; all nodes of a beam are then ranked by the
original vectors in double. Squares beyond the range of doubles are avoided in scores as well. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import plain_rows, written

SHARD_ROWS = 4096
BLOCK_ROWS = 512
DEGREE = 28
ALPHA = 1.2
BUILD_BEAM = 48
SEARCH_BEAM = 160
#: Tasks that a search should have at least.
SEARCH_TASKS = 64
#: Nodes that one step of a beam search expands.
STRIDE = 4


def vector_type(df: DataFrame) -> str:
    """The type that vectors are kept in: float as it is, all else double."""
    return "array<float>" if dict(df.dtypes)["embedding"] == "array<float>" else "array<double>"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


# ---------------------------------------------------------------- the graph of a shard


def frame_of(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """(centre, scale) of a shard: the median of each component, and the median of the vectors' largest components less that."""
    wide = vectors.astype(np.float64)
    centre = np.median(wide / 2, axis=0) * 2
    return centre, float(np.median(np.abs(wide / 2 - centre / 2).max(1))) * 2 or 1.0


def framed(vectors: np.ndarray, centre: np.ndarray, scale: float) -> np.ndarray:
    """Vectors less the centre and over the scale, in single precision; those of over a thousand times the scale are drawn in, by the logarithm."""
    apart = vectors.astype(np.float64) / 2 - centre / 2
    length = np.abs(apart).max(1, keepdims=True)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        radius = length / scale * 2
        drawn = 1e3 * (1 + np.log(length) - np.log(scale / 2) - np.log(1e3))
        out = np.where(length > 0, apart / length, 0.0) * np.where(radius > 1e3, drawn, radius)
    return out.astype(np.float32)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double; where squares leave the range, on scaled differences."""
    apart = a.astype(np.float64) - b.astype(np.float64)
    with np.errstate(over="ignore"):
        out = np.sqrt((apart**2).sum(1))
    odd = ~np.isfinite(out) | ((out < 1e-140) & (apart != 0).any(1))
    if odd.any():
        most = np.abs(apart[odd]).max(1, keepdims=True)
        out[odd] = most[:, 0] * np.sqrt(((apart[odd] / most) ** 2).sum(1))
    return out


def _distances(vectors: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its listed nodes, by differences."""
    apart = vectors[ids]
    apart -= queries[:, None, :]
    return np.einsum("bcd,bcd->bc", apart, apart, optimize=False)


def beam_search(vectors: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of each query's beam, nearest first; -1 pads."""
    rows, n = len(queries), len(vectors)
    ids = np.full((rows, beam), -1, np.int64)
    dist = np.full((rows, beam), np.inf, np.float32)
    done = np.ones((rows, beam), bool)
    seen = np.zeros((rows, n + 1), bool)
    seen[:, n] = True  # what pads a neighbour list
    ids[:, 0], done[:, 0], seen[:, start] = start, False, True
    dist[:, 0] = _distances(vectors, queries, np.full((rows, 1), start))[:, 0]
    live = np.arange(rows)
    while len(live):
        # The nearest nodes that weren't expanded; beams are sorted, so they come first.
        open_ = ~done[live]
        take = open_ & (np.cumsum(open_, 1) <= STRIDE)
        live = live[take.any(1)]
        take = take[take.any(1)]
        if not len(live):
            break
        pick = np.full((len(live), STRIDE), -1, np.int64)
        r, c = np.nonzero(take)
        pick[r, np.cumsum(take, 1)[r, c] - 1] = ids[live[r], c]
        done[live[r], c] = True
        near = np.where(pick[:, :, None] >= 0, graph[pick], n).reshape(len(live), -1)
        near.sort(1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        width = int(fresh.sum(1).max(initial=0))
        if width == 0:
            continue
        # Fresh neighbours to the left, so that a step computes no more distances than needed.
        order = np.argsort(~fresh, 1, kind="stable")[:, :width]
        near, fresh = np.take_along_axis(near, order, 1), np.take_along_axis(fresh, order, 1)
        far = np.where(fresh, _distances(vectors, queries[live], np.where(fresh, near, 0)), np.inf)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_dist = np.concatenate([dist[live], far], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        best = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(all_ids, best, 1)
        dist[live] = np.take_along_axis(all_dist, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)
    return ids, dist


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, cands: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node among its candidates (-1 pads)."""
    n = len(vectors)
    cands = np.where(cands == nodes[:, None], -1, cands)
    dist = np.where(cands >= 0, _distances(vectors, vectors[nodes], np.maximum(cands, 0)), np.inf)
    order = np.argsort(dist, 1, kind="stable")
    cands, dist = np.take_along_axis(cands, order, 1), np.take_along_axis(dist, order, 1)
    alive = np.isfinite(dist)
    alive[:, 1:] &= cands[:, 1:] != cands[:, :-1]
    found = vectors[np.maximum(cands, 0)] - vectors[nodes][:, None, :]  # seen from the node, so that what lies far off doesn't blur
    norms = (found * found).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(found, found.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), n, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = cands[rows[some], first[some]]
        alive[rows[some], first[some]] = False
        covered = alpha * alpha * between[rows, first] <= dist
        alive &= ~(covered & some[:, None])
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = 11) -> tuple[np.ndarray, int]:
    """(graph, medoid): each node's neighbours, padded with n."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    start = int(((vectors - vectors.mean(0)) ** 2).sum(1).argmin())
    wide = degree + degree // 2  # lists are pruned when they outgrow this, and at the end
    graph = np.full((n, wide), n, np.int64)
    if n == 1:
        return graph[:, :degree], start
    few = min(degree // 3, n - 1)
    graph[:, :few] = rng.integers(0, n, (n, few))
    graph[graph == np.arange(n)[:, None]] = n
    order = rng.permutation(n)
    for begin in range(0, n, 256):
        nodes = order[begin : begin + 256]
        ids, _ = beam_search(vectors, graph, start, vectors[nodes], beam)
        own = np.where(graph[nodes] < n, graph[nodes], -1)
        kept = robust_prune(vectors, nodes, np.concatenate([ids, own], 1), degree, alpha)
        graph[nodes] = n
        graph[nodes, :degree] = kept
        to, by = kept.ravel(), np.repeat(nodes, degree)
        by, to = by[to < n], to[to < n]
        turn = np.argsort(to, kind="stable")
        to, by = to[turn], by[turn]
        names, first, counts = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(names), counts.max(initial=0)), n, np.int64)
        more[np.repeat(np.arange(len(names)), counts), np.arange(len(to)) - np.repeat(first, counts)] = by
        both = np.concatenate([graph[names], more], 1)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = n
        both.sort(1)
        fit = (both < n).sum(1) <= wide
        graph[names[fit]] = both[fit, :wide]
        if (~fit).any():
            graph[names[~fit]] = n
            over = both[~fit]
            over = over[:, : int((over < n).sum(1).max())]
            graph[names[~fit], :degree] = robust_prune(vectors, names[~fit], np.where(over < n, over, -1), degree, alpha)
    out = np.empty((n, degree), np.int64)
    for begin in range(0, n, 512):
        nodes = np.arange(begin, min(begin + 512, n))
        out[nodes] = robust_prune(vectors, nodes, np.where(graph[nodes] < n, graph[nodes], -1), degree, alpha)
    return out, start


# ---------------------------------------------------------------- Spark


def _index(degree: int, alpha: float):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("rep")
        exact = np.stack(shard["vector"].to_list())
        centre, scale = frame_of(exact)
        vectors = framed(exact, centre, scale)
        graph, start = build(vectors, degree, alpha)
        ids = shard["ids"].to_list()
        return pd.DataFrame(
            {
                "dim": [vectors.shape[1]],
                "shard": [int(shard["shard"].iloc[0])],
                "start": [start],
                "ids": [np.concatenate(ids).astype(np.int64).tobytes()],
                "counts": [np.array([len(x) for x in ids], np.int64).tobytes()],
                "vectors": [exact.tobytes()],
                "frame": [np.append(centre, scale).tobytes()],
                "graph": [graph.astype(np.int32).tobytes()],
            }
        )

    return run


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack(rows["vector"].to_list())
    return pd.DataFrame({"dim": [vectors.shape[1]], "block": [int(rows["block"].iloc[0])], "queries": [rows["vec_id"].to_numpy(np.int64).tobytes()], "points": [vectors.tobytes()]})


def _search(k: int, degree: int, beam: int, kind: type):
    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                original = np.frombuffer(row.vectors, kind).reshape(-1, row.dim)
                frame = np.frombuffer(row.frame, np.float64)
                vectors = framed(original, frame[:-1], frame[-1])
                graph = np.frombuffer(row.graph, np.int32).astype(np.int64).reshape(-1, degree)
                points = np.frombuffer(row.points, kind).reshape(-1, row.dim)
                queries = np.frombuffer(row.queries, np.int64)
                counts = np.frombuffer(row.counts, np.int64)
                offsets, ids = np.cumsum(counts) - counts, np.frombuffer(row.ids, np.int64)
                for begin in range(0, len(queries), 128):
                    part = slice(begin, begin + 128)
                    nodes, dist = beam_search(vectors, graph, row.start, framed(points[part], frame[:-1], frame[-1]), max(beam, 4 * k))
                    keep = nodes >= 0
                    q = np.repeat(np.arange(len(nodes)), keep.sum(1))
                    node = nodes[keep]
                    size = counts[node]
                    who = ids[np.repeat(offsets[node] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                    q, node = np.repeat(q, size), np.repeat(node, size)
                    other = who != queries[part][q]
                    q, node, who = q[other], node[other], who[other]
                    exact = exact_distances(points[part][q], original[node])
                    order = np.lexsort((who, exact, q))
                    q, who, exact = q[order], who[order], exact[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    near = rank < k
                    yield pd.DataFrame({"query_id": queries[part][q[near]], "vec_id": who[near], "score": exact[near]})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, degree: int = DEGREE, alpha: float = ALPHA, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of vectors (vec_id, embedding) to each of queries, itself left out."""

    def read(df: DataFrame) -> DataFrame:
        good = plain_rows(df, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        one = good.groupBy("vec_id").agg(F.min(F.col("embedding").cast(kind)).alias("vector"))
        return one.withColumn("dim", F.size("vector"))

    kind = vector_type(vectors)
    # Of equal vectors, the k + 1 smallest ids can be among a query's nearest; tasks keep no more.
    turn = Window.partitionBy("vector").orderBy("vec_id")
    first = read(vectors).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k + 1)
    nodes = written(first.groupBy("vector", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.select("vector", "dim", "ids", F.col("ids")[0].alias("rep")).withColumn("shard", F.expr(f"pmod(xxhash64(rep), {shards})").cast("int"))
    index_schema = "dim int, shard int, start int, ids binary, counts binary, vectors binary, frame binary, graph binary"
    index = written(dealt.groupBy("dim", "shard").applyInPandas(_index(degree, alpha), index_schema), "index")
    asked = read(queries)
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    packed = asked.withColumn("block", F.expr(f"pmod(xxhash64(vec_id), {blocks})").cast("int")).groupBy("dim", "block").applyInPandas(_block, "dim int, block int, queries binary, points binary")
    sent = written(packed, "blocks").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # A shard meets its blocks where it is; only where shards are few it is sent to several tasks, with a part of the blocks each.
    parts = min(blocks, -(-SEARCH_TASKS // shards))
    key = ["dim", "shard", "part"]
    there = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(max(SEARCH_TASKS, 2 * shards), *key)
    met = there.join(sent.withColumn("part", F.col("block") % parts).repartition(max(SEARCH_TASKS, 2 * shards), *key), key)
    found = met.mapInPandas(_search(k, degree, beam, np.float32 if kind == "array<float>" else np.float64), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose vec_id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
