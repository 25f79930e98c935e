"""Graphs of k-mers, unitigs and reads."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S
from .packed import CODED, decoded, encoded, other_codes, read_depths, shared_codes
from .recruitment import code_sieve


def written(df: DataFrame) -> DataFrame:
    """df as a table under spark.checkpoint.dir, read again, so that the rounds of an iteration don't pile up; cached plainly in local mode where that is unset."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return df.cache()
    path = f"{folder}/strandframe/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a table of written() that nothing reads any more; a cached one is given up."""
    if df.is_cached:
        df.unpersist()
        return
    for file in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


#: Nodes of more neighbours than this, and than a thousandth of all edges, meet their least one by broadcast; there are at most a thousand.
HOT_EDGES = 10_000


def _nearest(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v), of which there are about total, with m, the least v among the rows of the same u. The rows of a hot u stay where they are."""
    most = max(HOT_EDGES, total // 1000)
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    if total <= most:
        return edges.join(least.drop("_n"), "u")
    hot = F.broadcast(least.where(F.col("_n") > most).select("u", "m"))
    return edges.join(hot, "u").unionByName(edges.join(hot, "u", "left_anti").join(least.where(F.col("_n") <= most).drop("_n"), "u"))


def _contracted(edges: DataFrame) -> DataFrame:
    """edges (u, v) with each partition's own components as stars around their least node: as many edges at most, and the same components."""

    def kernel(batches):
        up: dict = {}
        for pdf in batches:
            for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                while up[a] != a:
                    up[a] = a = up[up[a]]
                while up[b] != b:
                    up[b] = b = up[up[b]]
                if a < b:
                    up[b] = a
                else:
                    up[a] = b
        out = []
        for x in up:
            root = x
            while up[root] != root:
                root = up[root]
            up[x] = root
            if root != x:
                out.append((x, root))
        yield pd.DataFrame(out, columns=["u", "v"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.mapInPandas(kernel, f"u {kind}, v {kind}")


#: Edges between numbers that one task joins at once, some 100 bytes each; more go by rounds.
ONE_TASK_EDGES = 1 << 23


def _joined(edges: DataFrame) -> DataFrame:
    """components() of few edges (u, v) between numbers, in one task: roots hang on lesser roots until none is left to."""

    def kernel(batches):
        pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not pairs:
            return
        u, v = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        del pairs
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v, up = at[: len(u)], at[len(u) :], np.arange(len(names))
        while True:
            a, b = up[u], up[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (further := up[up]).tobytes() != up.tobytes():
                up = further
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[up])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(kernel, "node long, root long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) of the nodes of edges (a, b), root the least node of each component.

    Rounds of large and small stars: every node hangs its greater neighbours on its least one, then itself and its lesser
    ones; before and after, each task joins what its own edges connect. Chains of n nodes settle in about log n rounds, and
    each round's table replaces the one before. Up to ONE_TASK_EDGES between longs are joined in one task instead, as a round
    takes seconds however few they are.
    """
    if edges.schema[0].dataType == edges.schema[1].dataType == T.LongType():
        edges = written(edges.select("a", "b").where("a <> b"))
        if edges.count() <= ONE_TASK_EDGES:
            return written(_joined(edges))

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return row["n"], row["x"]

    current = written(oriented(_contracted(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"))))
    before = state(current)
    for _ in range(rounds):
        if not before[0]:
            break
        both = _nearest(current.union(current.select("v", "u")), 2 * before[0])
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
        small = _nearest(large, before[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, current = current, written(oriented(_contracted(small.where("u <> v"))))
        discard(last)
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v").distinct())


def adjacency(rows: DataFrame, k: int) -> DataFrame:
    """Rows (a, b) where the last k-1 bases of a are the first of b."""
    left = rows.select(F.col("seq").alias("a"), F.expr(f"right(seq, {k - 1})").alias("_k"))
    return left.join(rows.select(F.col("seq").alias("b"), F.expr(f"left(seq, {k - 1})").alias("_k")), "_k").select("a", "b")


def unique_adjacency(edges: DataFrame) -> DataFrame:
    """The edges that are the only one out of their begin and the only one into their end."""
    out = edges.groupBy("a").count().where("count = 1").select("a")
    into = edges.groupBy("b").count().where("count = 1").select("b")
    return edges.join(out, "a").join(into, "b").select("a", "b")


def repeated(reads: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether an id stands in several rows, so that these count as one read; only ids are shuffled to tell."""
    return not reads.groupBy(*keys, "read_id").count().where("count > 1").isEmpty()


def solid_kmers(reads: DataFrame, k: int, least: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """A2, A4, P5: k-mers in at least so many reads, each read counted once, on both strands.

    Reads of one row each are counted piece by piece before the shuffle; where an id repeats, its rows' k-mers are made distinct first.
    """
    if k <= CODED and not repeated(reads, keys):
        depths = read_depths(reads, k, list(keys), "both").where(F.col("depth") >= least)
        return depths.select(*keys, F.expr(S.from_two_bit("code", k)).alias("kmer"), "depth")
    own = S.kmers(reads, k).select(*keys, "read_id", F.explode(F.expr(f"array(kmer, {S.reverse_complement('kmer')})")).alias("kmer")).distinct()
    return own.groupBy(*keys, "kmer").agg(F.count("*").alias("depth")).where(F.col("depth") >= least)


def recruited_depths(reads: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """A2: rows (locus, kmer, depth): in how many reads (read_id, seq) of a locus, by found (read_id, locus), each k-mer is, as it stands."""
    own = reads.select("read_id", "seq").join(found.select("read_id", "locus"), "read_id")
    if k <= CODED and not repeated(reads, ()):
        return read_depths(own, k, ["locus"], "own").select("locus", F.expr(S.from_two_bit("code", k)).alias("kmer"), "depth")
    return S.kmers(own, k).groupBy("locus", "kmer").agg(F.countDistinct("read_id").alias("depth"))


def repeated_depths(reads: DataFrame, found: DataFrame, k: int, kept: DataFrame, least: int = 2) -> DataFrame:
    """A2, P5: rows (locus, code, n) that add up to recruited_depths(), without most k-mers that stand in fewer than least reads of a locus and are not kept (code).

    Reads of the same loci are counted together and each k-mer's counts meet once, however many loci have the read; only what
    stands in several recruited reads is given to each of the loci.
    """
    loci = written(found.groupBy("read_id").agg(F.array_sort(F.collect_set("locus")).alias("loci")))
    groups = written(loci.select("loci").distinct().withColumn("group", F.monotonically_increasing_id()))
    own = reads.select("read_id", "seq").join(loci.join(groups, "loci").select("read_id", "group"), "read_id").select("group", "seq")
    counted = shared_codes(own, k, least, code_sieve(kept, kept.count()))
    return counted.hint("merge").join(groups, "group").select(F.explode("loci").alias("locus"), "code", "n")


def branch_edges(kmers: DataFrame, k: int) -> DataFrame:
    """The edges out of k-mers that have more than one, with the depths at both ends."""
    left = kmers.select(F.col("kmer").alias("a"), F.col("depth").alias("depth_a"), F.expr(f"right(kmer, {k - 1})").alias("_k"))
    edges = left.join(kmers.select(F.col("kmer").alias("b"), F.col("depth").alias("depth_b"), F.expr(f"left(kmer, {k - 1})").alias("_k")), "_k").drop("_k")
    many = edges.groupBy("a").count().where("count > 1").select("a")
    return edges.join(many, "a", "left_semi")


def compact(kmers: Iterable[str]) -> list[str]:
    """The unitigs of a set of k-mers: paths without branches, as long as they go; cycles are cut at their least k-mer."""
    nodes = set(kmers)
    after = lambda x: [y for b in "ACGT" if (y := x[1:] + b) in nodes]
    before = lambda x: [y for b in "ACGT" if (y := b + x[:-1]) in nodes]
    starts = lambda x: len(p := before(x)) != 1 or len(after(p[0])) != 1
    out, seen = [], set()
    for begin in [x for x in sorted(nodes) if starts(x)] + sorted(nodes):
        if begin in seen:
            continue
        path, x = [begin], begin
        seen.add(begin)
        while len(n := after(x)) == 1 and n[0] not in seen and len(before(n[0])) == 1:
            x = n[0]
            path.append(x)
            seen.add(x)
        out.append(path[0] + "".join(y[-1] for y in path[1:]))
    return sorted(out)


def unitigs(kmers: DataFrame, keys: list[str]) -> DataFrame:
    """G8 for every key: one graph is one locus of one sample, which the recruiting depth bounds."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        made = compact(pdf["kmer"])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(made) for c in keys}, "unitig": range(len(made)), "seq": made}, dtype=object)

    types = ", ".join(f"{c} {kmers.schema[c].dataType.simpleString()}" for c in keys)
    return kmers.groupBy(*keys).applyInPandas(kernel, f"{types}, unitig int, seq string")


def bridges(edges: list[tuple]) -> set[tuple]:
    """The edges without which their component falls apart, by depth-first order without recursion."""
    near = defaultdict(list)
    for i, (a, b) in enumerate(edges):
        near[a].append((b, i))
        near[b].append((a, i))
    order, low, found, clock = {}, {}, set(), 0
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = clock
        clock += 1
        stack = [(root, -1, iter(near[root]))]
        while stack:
            node, via, rest = stack[-1]
            for other, i in rest:
                if i == via:
                    continue
                if other in order:
                    low[node] = min(low[node], order[other])
                    continue
                order[other] = low[other] = clock
                clock += 1
                stack.append((other, i, iter(near[other])))
                break
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] > order[up]:
                        found.add(edges[via])
    return found


def bridge_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """G15 for every key; edges (a, b) once each."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf["a"], pdf["b"], strict=True))
        cut = bridges(pairs)
        return pdf.assign(bridge=[p in cut for p in pairs])

    types = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in [*keys, "a", "b"])
    return edges.select(*keys, "a", "b").groupBy(*keys).applyInPandas(kernel, f"{types}, bridge boolean")


def heaviest_path(nodes: dict, edges: dict) -> list | None:
    """The path of a graph without cycles whose sum of node weights is largest, ties to the least node names; null with a cycle."""
    into, out = defaultdict(int), defaultdict(list)
    for a, b in edges:
        out[a].append(b)
        into[b] += 1
    ready, order = sorted(x for x in nodes if not into[x]), []
    while ready:
        x = ready.pop(0)
        order.append(x)
        for y in sorted(out[x]):
            into[y] -= 1
            if not into[y]:
                ready.append(y)
        ready.sort()
    if len(order) < len(nodes):
        return None
    best: dict = {}
    for x in reversed(order):
        tails = [best[y] for y in out[x]]
        top = min(tails, key=lambda t: (-t[0], t[1]), default=(0, []))
        best[x] = (nodes[x] + top[0], [x, *top[1]])
    return min(best.values(), key=lambda t: (-t[0], t[1]))[1] if best else []


def _fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own, for a cogroup with a table of the same lineage."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def backbones(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """The heaviest path of each key's graph as (key, ord, node); none with a cycle. nodes (key, node, weight), edges (key, a, b)."""

    def kernel(k, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        path = heaviest_path(dict(zip(own["node"], own["weight"], strict=True)), list(zip(links["a"], links["b"], strict=True))) or []
        return pd.DataFrame({key: [k[0]] * len(path), "ord": range(len(path)), "node": path}, dtype=object)

    types = f"{key} {nodes.schema[key].dataType.simpleString()}, ord int, node {nodes.schema['node'].dataType.simpleString()}"
    return nodes.groupBy(key).cogroup(_fresh(edges).groupBy(key)).applyInPandas(kernel, types)


#: Steps of one walk, as the default of a parameter; a walk that uses them all is reported as truncated.
WALK_STEPS = 8192


class WalkGraph:
    """A locus's k-mers by depth, what the reference says of them, pairs that pass an edge, and k-mers that stand by pairs alone.

    reference: for a k-mer (weight, position), positions in thousandths of the reference as it is walked; pairs: for an
    edge (a, b) the number of fragments that pass it; rescued: thin k-mers that a mate's anchor has kept.
    """

    def __init__(self, depth: Mapping[str, int], reference: dict[str, tuple[int, int]] | None = None, pairs: dict[tuple[str, str], int] | None = None, rescued: set[str] | None = None):
        self.depth, self.reference, self.pairs, self.rescued = depth, reference or {}, pairs or {}, rescued or set()

    def terms(self, x: str, y: str) -> dict[str, int]:
        """What speaks for the step from x to y at a branch and what against it, by name.

        Fragments on the edge count from two on, up to four; without them a rescued k-mer loses. A step to the neighbouring
        place of the reference gains and a leap within it loses. A depth that rises to over four times that of x, and over
        8, is held for a repeat where the reference lacks the k-mer, and half of what is beyond does not count.
        """
        passing = self.pairs.get((x, y), 0)
        (own, here), (weight, there) = self.reference.get(x, (0, 0)), self.reference.get(y, (0, 0))
        inside = 0 < here < 1000 and 0 < there < 1000
        beyond = self.depth[y] - max(8, 4 * self.depth[x])
        return {
            "pairs": 6 * min(passing, 4) * (passing >= 2),
            "rescued": -16 * (passing < 2 and y in self.rescued),
            "neighbour": 8 * (inside and abs(there - here) <= 2),
            "leap": -8 * (inside and abs(there - here) > 2 and own > 0 and weight > 0),
            "surge": -(beyond // 2) * (beyond > 0 and not weight),
        }

    def continuations(self, x: str, closed: set[str]) -> list[tuple[int, str]]:
        """The k-mers after x that are not closed, as (weight, k-mer), the best first.

        A weight is the depth and the reference's weight, and where there are several ways also what their terms add up to.
        Ties go to what the reference has, then to the least k-mer.
        """
        ways = [y for b in "ACGT" if (y := x[1:] + b) in self.depth and y not in closed]
        plain = {y: self.depth[y] + self.reference.get(y, (0, 0))[0] for y in ways}
        weights = {y: n + sum(self.terms(x, y).values()) for y, n in plain.items()} if len(ways) > 1 else plain
        best_first = sorted(ways, key=lambda y: (-weights[y], self.reference.get(y, (0, 0))[1] <= 0, y))
        return [(weights[y], y) for y in best_first]

    def walk(self, seed: str, lookahead: int = 24, limit: int = WALK_STEPS) -> tuple[str, set[str], bool]:
        """What follows a seed, the k-mers used, and whether the limit cut it short.

        At a branch every way is followed some steps, always to its best continuation; the longest of these wins, then the
        heaviest, then the one of the best begin. The beginnings of the others are closed to the rest of the walk.
        """
        used, lost, out, x = {seed}, set(), [], seed
        for _ in range(limit):
            nodes = self.continuations(x, used | lost) if lost else self.continuations(x, used)
            if not nodes:
                return "".join(out), used, False
            chosen = nodes[0][1]
            if len(nodes) > 1:
                best = None
                for weight, y in nodes:
                    seen, total, steps, here, first = set(used), 0, 0, y, weight
                    while steps < lookahead and here not in seen:
                        seen.add(here)
                        total, steps = total + weight, steps + 1
                        following = self.continuations(here, seen | lost)
                        if not following:
                            break
                        weight, here = following[0]
                    if best is None or (steps, total, first) > best[0]:
                        best = ((steps, total, first), y)
                chosen = best[1]
                lost |= {y for _, y in nodes if y != chosen}
            used.add(chosen)
            out.append(chosen[-1])
            x = chosen
        return "".join(out), used, bool(self.continuations(x, used | lost))


class CodedDepths(Mapping):
    """Depths of k-mers and of their other strands, as sorted codes: 16 bytes for each. A k-mer that is there on both strands keeps its depth on each."""

    def __init__(self, code: np.ndarray, depth: np.ndarray, k: int):
        turned = other_codes(code, k)
        new = ~np.isin(turned, code)
        code, depth = np.concatenate([code, turned[new]]), np.concatenate([depth, depth[new]])
        order = np.argsort(code)
        self.code, self.depth, self.k, self.asked = code[order], depth[order], k, {}

    def get(self, x: str, default=None):
        if x not in self.asked:
            code = encoded(x)
            at = int(self.code.searchsorted(code))
            self.asked[x] = int(self.depth[at]) if at < len(self.code) and self.code[at] == code else None
        found = self.asked[x]
        return default if found is None else found

    def __contains__(self, x) -> bool:
        return self.get(x) is not None

    def __getitem__(self, x: str) -> int:
        if (found := self.get(x)) is None:
            raise KeyError(x)
        return found

    def __iter__(self) -> Iterator[str]:
        return iter(decoded(self.code, self.k))

    def __len__(self) -> int:
        return len(self.code)


_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def other_strand(x: str) -> str:
    return x.translate(_COMPLEMENT)[::-1]


def lower_quartile(values: list[int]) -> float:
    """the median of the lower half, the median itself left out of an odd number; of one value, itself."""
    half = sorted(values)[: len(values) // 2] or values
    return (half[(len(half) - 1) // 2] + half[len(half) // 2]) / 2


def boundary(weights: list[int], soft: int) -> int:
    """How many steps of a side stay: up to the last whose weight reaches the side's lower quartile, and some soft ones more; sides of up to two steps stay whole."""
    if len(weights) <= 2:
        return len(weights)
    least = lower_quartile(weights)
    last = max(i for i, w in enumerate(weights) if w >= least)
    return min(len(weights), last + 1 + soft)


def assembled(depth: Mapping[str, int], reference: list[str], lookahead: int = 24, limit: int = WALK_STEPS, soft_boundary: int | None = None, pairs: dict[tuple[str, str], int] | None = None, rescued: set[str] | None = None, error_limit: int | None = None) -> list[tuple[str, int, bool]]:
    """Contigs (sequence, weight, truncated) of a locus, from its k-mers and those of its reference in order.

    The heaviest reference k-mer that has reads is walked both ways; the seeds that its contig uses are done, on either
    strand, and the next one begins, until half of the seeds are used up. With a soft boundary each side is cut where its
    weights stay below their lower quartile. pairs and rescued go into the weights of branches. With an error limit depths
    are cut at the third quartile and one and a half times the middle half's width more, of the k-mers that are not rescued,
    and a reference k-mer of more depth than the limit weighs one more than that bound, else one (A6).
    """
    rescued = rescued or set()
    if isinstance(depth, CodedDepths):
        graph_depth = depth
    else:
        graph_depth = dict(depth)
        for x, d in depth.items():  # both strands of every k-mer, counted once where both are there already
            graph_depth.setdefault(other_strand(x), d)
    weigh = lambda x: 1
    if error_limit is not None and graph_depth:
        usual = sorted(d for x, d in graph_depth.items() if x not in rescued) or sorted(graph_depth.values())
        q1, q3 = lower_quartile(usual), -lower_quartile([-d for d in usual])
        most = int((q3 - q1) * 1.5 + q3)
        before = graph_depth
        graph_depth = {x: min(d, most) for x, d in before.items()}
        weigh = lambda x: most + 1 if before.get(x, 0) > error_limit else 1
    place = {x: (weigh(x), max(1, min(999, 1000 * (i + 1) // len(reference)))) for i, x in reversed(list(enumerate(reference)))}
    turned = {other_strand(x): (w, 1000 - p) for x, (w, p) in place.items()}
    right, left = (WalkGraph(graph_depth, where, pairs, rescued) for where in (place, turned))
    seeds = sorted((x for x in place if x in graph_depth), key=lambda x: (-graph_depth[x], x))
    most, out = len(seeds) // 2, []
    while seeds and len(seeds) > most:
        seed = seeds[0]
        after, used_after, cut_after = right.walk(seed, lookahead, limit)
        before, used_before, cut_before = left.walk(other_strand(seed), lookahead, limit)
        k = len(seed)
        if soft_boundary is not None:
            along = lambda begin, bases: [graph_depth[(begin + bases)[i : i + k]] for i in range(1, len(bases) + 1)]  # noqa: B023, E731
            after, before = after[: boundary(along(seed, after), soft_boundary)], before[: boundary(along(other_strand(seed), before), soft_boundary)]
        seq = other_strand(before) + seed + after
        out.append((seq, sum(graph_depth.get(seq[i : i + k], 0) for i in range(len(seq) - k + 1)), cut_after or cut_before))
        used = used_after | {other_strand(x) for x in used_before}
        seeds = [x for x in seeds if x not in used and other_strand(x) not in used]
    return out


def contigs(kmers: DataFrame, reference: DataFrame, key: str, lookahead: int = 24, limit: int = WALK_STEPS, soft_boundary: int | None = None) -> DataFrame:
    """For each locus the contig of the largest weight, ties to the longest, then to the least sequence: (key, seq, weight, candidates, truncated).

    kmers (key, kmer, depth), reference (key, pos, kmer). A locus's distinct k-mers meet in one task: the error filter
    bounds them by what several reads share. limit bounds one walk; truncated tells where it did.
    """

    def kernel(name, own: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        made = assembled(dict(zip(own["kmer"], own["depth"], strict=True)), ref.sort_values("pos")["kmer"].tolist(), lookahead, limit, soft_boundary)
        best = sorted(made, key=lambda c: (-c[1], -len(c[0]), c[0]))[:1]
        return pd.DataFrame([(name[0], *c[:2], len(made), c[2]) for c in best], columns=[key, "seq", "weight", "candidates", "truncated"], dtype=object)

    types = f"{key} {kmers.schema[key].dataType.simpleString()}, seq string, weight long, candidates int, truncated boolean"
    return kmers.groupBy(key).cogroup(_fresh(reference).groupBy(key)).applyInPandas(kernel, types)


def coded_contigs(codes: DataFrame, reference: DataFrame, key: str, k: int, least: int = 2, lookahead: int = 24, limit: int = WALK_STEPS) -> DataFrame:
    """contigs() of codes (key, code, n), whose n are added up first; only k-mers of least reads or of the reference take part."""

    def kernel(name, own: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(own["code"].to_numpy(), kind="stable")
        code, n = own["code"].to_numpy()[order], own["n"].to_numpy()[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
        code, depth = code[first], np.add.reduceat(n, first) if len(first) else n
        along = ref.sort_values("pos")["kmer"].tolist()
        deep = (depth >= least) | np.isin(code, np.array([encoded(x) for x in along], np.int64))
        made = assembled(CodedDepths(code[deep], depth[deep], k), along, lookahead, limit)
        best = sorted(made, key=lambda c: (-c[1], -len(c[0]), c[0]))[:1]
        return pd.DataFrame([(name[0], *c[:2], len(made), c[2]) for c in best], columns=[key, "seq", "weight", "candidates", "truncated"], dtype=object)

    types = f"{key} {codes.schema[key].dataType.simpleString()}, seq string, weight long, candidates int, truncated boolean"
    return codes.groupBy(key).cogroup(_fresh(reference).groupBy(key)).applyInPandas(kernel, types)
