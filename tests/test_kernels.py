"""Kernels against plain versions."""

import random

from strandframe.operators import alignment as A
from strandframe.operators import graphs as G


def plain_local(a, b, match, mismatch, gap):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
    return max(map(max, h))


def test_alignment_scores():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choices("ACGT", k=rng.randint(0, 30))) for _ in range(2))
        want = plain_local(a, b, 2, -3, -4)
        assert A.local_score(a, b) == want
        score, a0, a1, b0, b1, same = A.local_alignment(a, b)
        assert score == want and same <= min(a1 - a0, b1 - b0)
        assert A.banded_affine_score(a, b, 0, 60, open_=0, extend=-4) == want


def test_unitigs_spell_every_kmer_once():
    rng = random.Random(2)
    for _ in range(20):
        seq = "".join(rng.choices("ACGT", k=200))
        k = 6
        nodes = {seq[i : i + k] for i in range(len(seq) - k + 1)}
        spelled = [u[i : i + k] for u in G.compact(nodes) for i in range(len(u) - k + 1)]
        assert sorted(spelled) == sorted(nodes)


def parts(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return len({find(x) for x in root})


def test_bridges():
    rng = random.Random(3)
    for _ in range(40):
        edges = sorted({tuple(sorted(rng.sample(range(9), 2))) for _ in range(rng.randint(1, 12))})
        nodes = {x for e in edges for x in e}
        base = parts(edges)
        want = {e for e in edges if parts([x for x in edges if x != e]) + sum(all(v not in x for x in edges if x != e) for v in e) > base}
        assert G.bridges(edges) == want and nodes


def test_heaviest_path():
    nodes, edges = {"a": 1, "b": 5, "c": 2, "d": 1}, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    assert G.heaviest_path(nodes, edges) == ["a", "b", "d"]
    assert G.heaviest_path(nodes, [*edges, ("d", "a")]) is None


def test_walk_rebuilds_a_sequence():
    rng = random.Random(4)
    seq = "".join(rng.choices("ACGT", k=300))
    k = 15
    depth = {seq[i : i + k]: 5 for i in range(len(seq) - k + 1)}
    side = seq[100 : 100 + k - 1] + ("A" if seq[100 + k - 1] != "A" else "C")
    depth[side] = 1
    out, used, cut = G.WalkGraph(depth).walk(seq[:k])
    assert seq[:k] + out == seq and side not in used and not cut
    assert G.WalkGraph(depth).walk(seq[:k], limit=50)[2]


def test_continuations_weigh_pairs_places_and_peaks():
    x, a, c = "AACC", "ACCA", "ACCC"
    first = lambda depth, reference=None, pairs=None: G.WalkGraph({x: 5, **depth}, reference, pairs).continuations(x, set())
    assert first({a: 5, c: 6}) == [(6, c), (5, a)] and first({a: 5, c: 5})[0][1] == a
    assert first({a: 5, c: 6}, pairs={(x, a): 2}) == [(17, a), (6, c)]
    assert first({a: 5, c: 6}, pairs={(x, a): 1})[0] == (6, c)
    assert first({a: 5, c: 6}, {x: (1, 500), a: (1, 501)}) == [(14, a), (6, c)]
    assert first({a: 15, c: 6}, {x: (1, 500), a: (1, 700)})[0] == (8, a)
    assert first({a: 60, c: 30}) == [(40, a), (25, c)]  # beyond 20 by 40 and by 10
    assert first({c: 99}) == [(99, c)]


def test_contigs_go_on_until_half_of_the_seeds_are_used(spark):
    rng = random.Random(11)
    one, two = ("".join(rng.choices("ACGT", k=n)) for n in (120, 90))
    k = 17
    depth = {one[i : i + k]: 3 for i in range(len(one) - k + 1)} | {two[i : i + k]: 4 for i in range(len(two) - k + 1)}
    made = G.assembled(depth, [two[i : i + k] for i in range(20)] + [one[i : i + k] for i in range(60)])
    assert [m[0] for m in made] == [two, one]
    kmers = spark.createDataFrame([(1, x, d) for x, d in depth.items()], "locus int, kmer string, depth long")
    ref = spark.createDataFrame([(1, i, s[i : i + k]) for s, n in ((two, 20), (one, 60)) for i in range(n)], "locus int, pos int, kmer string")
    got = G.contigs(kmers, ref, "locus").first()
    assert (got["seq"], got["candidates"], got["truncated"]) == (max((one, two), key=lambda s: sum(depth[s[i : i + k]] for i in range(len(s) - k + 1))), 2, False)
    cut = G.contigs(kmers, ref, "locus", limit=10).first()
    assert cut["truncated"]


def test_sides_are_cut_where_they_stay_thin():
    assert G.boundary([9, 9, 8, 9, 1, 1], 0) == 6 and G.boundary([9, 9, 9, 9, 9, 9, 9, 1, 1], 0) == 7 and G.boundary([9] * 7 + [1, 1], 1) == 8 and G.boundary([1, 9], 0) == 2
    rng = random.Random(13)
    seq, k = "".join(rng.choices("ACGT", k=200)), 15
    depth = {seq[i : i + k]: 9 if i < 180 else 1 for i in range(len(seq) - k + 1)}
    ref = [seq[50 : 50 + k]]
    assert G.assembled(depth, ref)[0][0] == seq
    assert G.assembled(depth, ref, soft_boundary=0)[0][0] == seq[: 179 + k] and G.assembled(depth, ref, soft_boundary=2)[0][0] == seq[: 181 + k]


def test_a_long_contig_is_whole(spark):
    rng = random.Random(12)
    seq, k = "".join(rng.choices("ACGT", k=9000)), 21
    made = G.assembled({seq[i : i + k]: 2 for i in range(len(seq) - k + 1)}, [seq[4000 : 4000 + k]])
    assert made[0][0] == seq and not made[0][2]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_abundance_and_bootstrap(spark):
    classes = spark.createDataFrame([(["a"], 30), (["b"], 10), (["a", "b"], 40), ([], 5)], "targets array<string>, n long")
    for rounds, most, near in ((40, 100, 1e-6), (10, 1, 1e-3)):
        share = {r["target"]: r["share"] for r in A.abundance(classes, rounds, most).collect()}
        assert abs(share["a"] - 0.75) < near and abs(share["b"] - 0.25) < near
    assert A.abundance(classes.where("false")).count() == 0
    rows = spark.createDataFrame([("x", 30, 100)], "k string, h long, t long")
    one, two = (A.bootstrap_interval(rows, ["k"], "h", "t").first() for _ in range(2))
    assert one == two and one["low"] < 0.3 < one["high"]


def test_bridge_table_takes_every_customer(spark):
    from strandframe.plans import genome_queries

    folder = "/root/testdata/sf0.001"
    edges = {}
    for r in spark.read.parquet(f"{folder}/customer.parquet").select("c_nationkey", "c_custkey").collect():
        a, b = r["c_custkey"] % 17, (r["c_custkey"] * 7 + r["c_nationkey"]) % 19 + 3
        if a != b:
            edges.setdefault(r["c_nationkey"], set()).add((min(a, b), max(a, b)))

    def joined(own, a, b):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            near = {q if p == x else p for p, q in own if x in (p, q)} - seen
            seen |= near
            todo += near
        return b in seen

    want = {(n, *e, not joined(own - {e}, *e)) for n, own in edges.items() for e in own}
    assert {tuple(r) for r in genome_queries.bridge_table(spark, folder).collect()} == want
