"""Approximate nearest neighbours with a navigable small-world graph per shard.

A shard is a bounded number of vectors, dealt by their ids. Its graph has layers: a vector is on layer l with probability
M**-l, and each layer is a flat array of neighbours, M wide (2M on the ground). Vectors are added in batches that all step
through the graph together, so the walk is array arithmetic. Inner products become cosines by one more component that lifts
every vector of the shard to the same norm. The graphs are written as rows of flat arrays. To search, each graph stays in one
task and the queries stream past it in batches; the best of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import read, written

#: Vectors in one shard, by the memory of a task: with 64 components a graph of so many takes some 40 MB.
SHARD_ROWS = 32_768
#: Queries that a task searches at once.
QUERY_ROWS = 2048
M, EF_BUILD, EF_SEARCH = 16, 64, 400
#: How many vectors a walk keeps on the layers above the ground, and how many of them the next layer's walk begins at.
EF_UPPER, ENTRIES = 32, 8
#: Vectors that step through a graph together, and how many entries each opens at a step.
BATCH, OPEN = 512, 4


def _search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ef nearest that a best-first walk from its entries finds: rows of x and their inner products, nearest first; -1 where there are fewer."""
    q, n = len(queries), len(x)
    seen = np.zeros((q, n + 1), bool)
    line = np.arange(q)[:, None]
    ids = np.full((q, ef), -1, np.int64)
    sims = np.full((q, ef), -np.inf, np.float32)
    entry = entry[:, : ef]
    ids[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("qd,qed->qe", queries, x[entry]), -np.inf)
    seen[line, entry] = True
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = ids[line, order], sims[line, order]
    opened = ids < 0
    live = np.arange(q)
    while len(live):
        row = live[:, None]
        # the first OPEN entries that are not opened yet
        rank = np.argsort(opened[live], axis=1, kind="stable")[:, :OPEN]
        chosen = np.where(opened[row, rank], -1, ids[row, rank])
        opened[row, rank] = True
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[row, near]] = -1
        seen[row, near] = True
        seen[:, -1] = False
        got = np.where(near >= 0, np.matmul(x[near], queries[live][:, :, None])[:, :, 0], -np.inf)
        all_sims = np.concatenate([sims[live], got], axis=1)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_opened = np.concatenate([opened[live], near < 0], axis=1)
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        inner = np.arange(len(live))[:, None]
        top = top[inner, np.argsort(-all_sims[inner, top], axis=1, kind="stable")]
        sims[live], ids[live], opened[live] = all_sims[inner, top], all_ids[inner, top], all_opened[inner, top]
        live = live[~opened[live].all(axis=1)]
    return ids, sims


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to it than to any one taken before, filled up with the nearest of the rest."""
    q, c = ids.shape
    among = np.matmul(x[ids], x[ids].transpose(0, 2, 1))
    taken = np.zeros((q, c), bool)
    held = np.full((q, c), -np.inf, np.float32)  # of each candidate, the similarity to the nearest one taken
    count = np.zeros(q, np.int64)
    for j in range(c):
        take = (ids[:, j] >= 0) & (sims[:, j] > held[:, j]) & (count < width)
        taken[:, j] = take
        count += take
        held = np.where(take[:, None], np.maximum(held, among[:, :, j]), held)
    order = np.argsort(np.where(taken, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, order, axis=1)
    return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)


def _layer(x: np.ndarray, order: np.ndarray, entry: np.ndarray, width: int, ef: int) -> np.ndarray:
    """The neighbours of each vector of a layer, added in the given order; entry: for each vector where its walk begins."""
    links = np.full((len(x), width), -1, np.int64)
    begin = 0
    while begin < len(order):
        batch = order[begin : begin + (BATCH if begin else min(BATCH, 2 * width))]
        within = x[batch] @ x[batch].T
        np.fill_diagonal(within, -np.inf)
        k = min(width, len(batch) - 1)
        inner = np.argpartition(-within, k - 1, axis=1)[:, :k] if k else np.zeros((len(batch), 0), np.int64)
        ids, sims = batch[inner], np.take_along_axis(within, inner, axis=1)
        if begin:
            far, far_sims = _search(x, links, x[batch], entry[batch], ef)
            ids, sims = np.concatenate([ids, far], axis=1), np.concatenate([sims, far_sims], axis=1)
        if ids.shape[1]:
            top = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
            ids, sims = np.take_along_axis(ids, top, axis=1), np.take_along_axis(sims, top, axis=1)
            links[batch] = _diverse(x, ids, sims, width)
            source = np.repeat(batch, width)
            target = links[batch].ravel()
            source, target = source[target >= 0], target[target >= 0]
            _back(x, links, source, target, width)
        begin += len(batch)
    return links


def _back(x: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray, width: int) -> None:
    """Adds the links target -> source; where there is no room, the diverse ones of the old and the nearest new stay."""
    sims = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-sims, target))
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    new = np.full((len(nodes), min(2 * width, int(count.max()))), -1, np.int64)
    fits = place < new.shape[1]
    new[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = source[fits]
    for at in range(0, len(nodes), BATCH):
        node = nodes[at : at + BATCH]
        both = np.sort(np.concatenate([links[node], new[at : at + BATCH]], axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        s = np.where(both >= 0, np.matmul(x[both], x[node][:, :, None])[:, :, 0], -np.inf)
        top = np.argsort(-s, axis=1, kind="stable")
        both, s = np.take_along_axis(both, top, axis=1), np.take_along_axis(s, top, axis=1)
        full = (both >= 0).sum(axis=1) > width
        out = both[:, :width]
        if full.any():
            out[full] = _diverse(x, both[full], s[full], width)
        links[node] = out


class Graph:
    """The layers of a shard over lifted vectors: members[l] are the vectors of layer l, links[l] their neighbours by place in it."""

    def __init__(self, members: list[np.ndarray], links: list[np.ndarray]):
        self.members, self.links = members, links

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 0) -> Graph:
        n = len(x)
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 12)
        members, links = [np.flatnonzero(height >= level) for level in range(int(height.max()) + 1)] if n else [], []
        for level in reversed(range(len(members))):
            own = members[level]
            place = np.arange(len(own))
            order = np.concatenate([place[height[own] > level], place[height[own] == level]])
            entry = np.zeros((len(own), 1), np.int64)
            if level + 1 < len(members):
                above = cls(members[level + 1 :], links).entries(x, x[own])
                entry = np.where(above >= 0, np.searchsorted(own, above), -1)
            links.insert(0, _layer(x[own], order, entry, 2 * M if level == 0 else M, EF_BUILD))
        return cls(members, links)

    def entries(self, x: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """For each query the ENTRIES vectors that a walk down to the lowest of these layers ends at; -1 where there are fewer."""
        at = np.full((len(queries), ENTRIES), -1, np.int64)
        at[:, 0] = self.members[-1][0]
        for own, links in zip(reversed(self.members), reversed(self.links), strict=True):
            for begin in range(0, len(queries), BATCH):
                part = slice(begin, begin + BATCH)
                place = np.where(at[part] >= 0, np.searchsorted(own, at[part]), -1)
                ids, _ = _search(x[own], links, queries[part], place, EF_UPPER)
                at[part] = np.where(ids[:, :ENTRIES] >= 0, own[ids[:, :ENTRIES]], -1)
        return at

    def nearest(self, x: np.ndarray, queries: np.ndarray, ef: int) -> np.ndarray:
        """For each query its ef nearest found; -1 where there are fewer."""
        out = np.full((len(queries), ef), -1, np.int64)
        if len(self.members) > 1:
            entry = Graph(self.members[1:], self.links[1:]).entries(x, queries)
        else:
            entry = np.zeros((len(queries), 1), np.int64)
        for begin in range(0, len(queries), BATCH):
            part = slice(begin, begin + BATCH)
            out[part] = _search(x, self.links[0], queries[part], entry[part], ef)[0]
        return out


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors of one norm whose inner products with [query, 0] rank as those of the vectors."""
    norms = (vectors**2).sum(axis=1)
    top = norms.max() if len(norms) else 0.0
    return np.hstack([vectors, np.sqrt(np.maximum(top - norms, 0))[:, None]]).astype(np.float32)


GRAPH = "shard int, dim int, vectors binary, first binary, ids binary, sizes binary, members binary, links binary"


def _graph_row(shard: int, dim: int, ids: np.ndarray, vectors: np.ndarray, keep: int) -> pa.RecordBatch:
    """One shard's graph over its distinct vectors; each has its keep smallest ids, which are all that a result can take of it."""
    distinct, of = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, of.ravel()))
    of, ids = of.ravel()[order], ids[order]
    first = np.searchsorted(of, np.arange(len(distinct) + 1))
    kept = np.arange(len(of)) - first[of] < keep
    ids, first = ids[kept], np.concatenate([[0], np.cumsum(np.minimum(np.diff(first), keep))])
    scale = np.abs(distinct).max()
    graph = Graph.build(_lifted(distinct / scale), shard)
    flat = lambda a, kind: np.ascontiguousarray(a, kind).tobytes()
    row = [shard, dim, flat(distinct, "<f8"), flat(first, "<i8"), flat(ids, "<i8"), flat([len(m) for m in graph.members], "<i8"), flat(np.concatenate(graph.members), "<i4"), flat(np.concatenate([x.ravel() for x in graph.links]), "<i4")]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in GRAPH.split(", ")])


class _Stored:
    """A graph read from its row."""

    def __init__(self, row: dict):
        dim = row["dim"]
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
        self.first, self.ids = np.frombuffer(row["first"], "<i8"), np.frombuffer(row["ids"], "<i8")
        sizes = np.frombuffer(row["sizes"], "<i8")
        members = np.split(np.frombuffer(row["members"], "<i4").astype(np.int64), np.cumsum(sizes)[:-1])
        widths = [2 * M if i == 0 else M for i in range(len(sizes))]
        links = np.split(np.frombuffer(row["links"], "<i4").astype(np.int64), np.cumsum(sizes * widths)[:-1])
        self.graph = Graph(members, [x.reshape(-1, w) for x, w in zip(links, widths, strict=True)])
        self.lifted = _lifted(self.vectors / np.abs(self.vectors).max())

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query id, vector id and score of up to k nearest of each query, its own id left out."""
        scaled = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        found = self.graph.nearest(self.lifted, np.hstack([scaled, np.zeros((len(queries), 1))]).astype(np.float32), min(ef, max(k + 1, len(self.lifted))))
        line, place = np.nonzero(found >= 0)
        node = found[line, place]
        score = np.concatenate([np.einsum("ij,ij->i", self.vectors[node[a : a + 65536]], queries[line[a : a + 65536]]) for a in range(0, len(node), 65536)] or [np.zeros(0)])
        many = self.first[node + 1] - self.first[node]
        at = np.repeat(np.arange(len(node)), many)
        ids = self.ids[self.first[node][at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
        line, score = line[at], score[at]
        other = ids != query_ids[line]
        line, ids, score = line[other], ids[other], score[other]
        order = np.lexsort((ids, -score, line))
        line, ids, score = line[order], ids[order], score[order]
        rank = np.arange(len(line)) - np.searchsorted(line, line)
        best = rank < k
        return query_ids[line[best]], ids[best], score[best]


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, vector) of doubles: one for each id, without null ids and without vectors that are null, zero or hold a null or non-finite component.

    Of several vectors of one id the least takes part; repeated rows count once.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda c: c != 0)).groupBy("id").agg(F.min("vector").alias("vector"))


def index(rows: DataFrame, n_rows: int, shard_rows: int = SHARD_ROWS, keep: int = 21) -> DataFrame:
    """The graphs of all vectors, one row for each shard and number of components, in shared storage."""
    shards = max(1, round(n_rows / shard_rows))

    def build(key, table):
        shard, dim = (k.as_py() for k in key)
        table = table.combine_chunks().sort_by("id")
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return pa.Table.from_batches([_graph_row(shard, dim, table.column("id").to_numpy(), vectors, keep)])

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dim"), "id", "vector")
    # a partition for each shard, so that no task builds two graphs while others wait
    return written(dealt.repartitionByRange(shards, "shard").groupBy("shard", "dim").applyInArrow(build, GRAPH), "graphs")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each of queries (id, vector) its k nearest among rows (id, vector) by inner product, its own id left out.

    Vectors of another number of components are no candidates. Both tables are as usable() leaves them. A graph is sent
    once, to the one task that searches it; a query goes to each shard, where its k best are found. So what is shuffled is
    all graphs and queries times shards, and a task holds one graph and one batch of queries.
    """
    graphs = index(rows, rows.count(), shard_rows, k + 1)
    shards = graphs.select("shard", "dim").distinct()
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("id", "long"), ("vector", "array<double>"))]
    absent = [F.lit(None).cast("binary").alias(c.split()[0]) for c in GRAPH.split(", ")[2:]]
    asked = queries.select(F.size("vector").alias("dim"), "id", "vector").join(shards, "dim").select("shard", "dim", "id", "vector", *absent)
    both = graphs.select("shard", "dim", *nothing, *[c.split()[0] for c in GRAPH.split(", ")[2:]]).unionByName(asked)
    # the graph of a shard stands before its queries, as nulls come first
    n_shards = (graphs.agg(F.max("shard")).first()[0] or 0) + 1
    placed = both.repartitionById(n_shards, "shard").sortWithinPartitions("shard", "dim", F.col("id").asc_nulls_first())

    def search(batches):
        graph, of = None, None
        for b in batches:
            key = list(zip(b.column("shard").to_pylist(), b.column("dim").to_pylist(), strict=True))
            is_graph = b.column("id").is_null().to_pylist()
            begin = 0
            while begin < b.num_rows:
                if is_graph[begin]:
                    graph, of = _Stored({c.split()[0]: b.column(c.split()[0])[begin].as_py() for c in GRAPH.split(", ")}), key[begin]
                    begin += 1
                    continue
                end = begin
                while end < b.num_rows and end - begin < QUERY_ROWS and key[end] == key[begin] and not is_graph[end]:
                    end += 1
                if key[begin] != of:
                    raise RuntimeError(f"queries of shard {key[begin]} came before its graph")
                part = b.slice(begin, end - begin)
                q = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, of[1])
                got = graph.top(part.column("id").to_numpy(), q, k, ef)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])
                begin = end

    found = placed.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(usable(read(spark, sf_dir, "embeddings")), "vectors")
    return nearest(rows, rows.where("id % 20 = 0"))
