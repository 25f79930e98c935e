"""The queries without SQL against plain versions over the smallest tables."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from strandframe.operators.alignment import local_score
from strandframe.plans import catalogue

SF = "/root/testdata/sf0.001"
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")


def rows(sql):
    return duckdb.sql(re.sub(r"\$(\w+)", rf"'{SF}/\1.parquet'", sql)).fetchall()


def bases(text):
    return re.sub("[^A-Za-z]", "", text).upper().translate(LETTERS)


def other(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def loci():
    return {i: bases(t) for i, t in rows("SELECT item_id, text FROM $benchmark")}


def windows(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1)]


def unitig_table(got):
    by = defaultdict(list)
    for r in got:
        by[r["locus"]].append(r["seq"])
    for locus, seq in loci().items():
        nodes, made = set(windows(seq, 13)), by.pop(locus, [])
        assert sorted(x for u in made for x in windows(u, 13)) == sorted(nodes)
        after = lambda x: [x[1:] + b for b in "ACGT" if x[1:] + b in nodes]  # noqa: B023, E731
        before = lambda x: [b + x[:-1] for b in "ACGT" if b + x[:-1] in nodes]  # noqa: B023, E731
        for u in made:
            inner = windows(u, 13)
            assert all(len(after(x)) == 1 for x in inner[:-1]) and all(len(before(x)) == 1 for x in inner[1:])
            end = after(inner[-1])
            assert len(end) != 1 or len(before(end[0])) != 1 or end[0] == inner[0]
    assert not by


def component_table(got):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in rows("SELECT DISTINCT l_orderkey, l_orderkey + 1 + l_suppkey % 2 FROM $lineitem"):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in root}


def bridge_table(got):
    edges = defaultdict(set)
    for n, c in rows("SELECT c_nationkey, c_custkey FROM $customer"):
        a, b = c % 17, (c * 7 + n) % 19 + 3
        if a != b:
            edges[n].add((min(a, b), max(a, b)))
    for r in got:
        rest, seen, todo = edges[r["locus"]] - {(r["a"], r["b"])}, {r["a"]}, [r["a"]]
        while todo:
            x = todo.pop()
            near = {q if p == x else p for p, q in rest if x in (p, q)} - seen
            seen |= near
            todo += near
        assert r["bridge"] == (r["b"] not in seen)
    assert len(got) == sum(map(len, edges.values()))


def backbone_table(got):
    weight, edges = Counter(), set()
    for n, c in rows("SELECT c_nationkey, c_custkey FROM $customer"):
        weight[n, c % 23] += 1
        edges.add((n, c % 23, c * 5 % 23))
    for n in {n for n, _ in weight}:
        nodes = sorted(x for m, x in weight if m == n)
        best = {}
        for x in reversed(nodes):
            best[x] = weight[n, x] + max((best[b] for m, a, b in edges if (m, a) == (n, x) and b > a and b in best), default=0)
        path = sorted((r["ord"], r["node"], r["start"], r["end"]) for r in got if r["locus"] == n)
        assert sum(weight[n, p[1]] for p in path) == max(best.values())
        assert all((n, a[1], b[1]) in edges for a, b in zip(path, path[1:], strict=False))
        assert [p[2] for p in path] == [0, *[p[3] for p in path[:-1]]] and all(p[3] - p[2] == weight[n, p[1]] for p in path)


def contig_table(got):
    reads = {i: bases(t or "") for i, t in rows("SELECT doc_id, text FROM $documents")}
    cut = {i: set(windows(s, 21)) for i, s in reads.items()}
    found = {r["locus"]: r for r in got}
    for locus, seq in loci().items():
        ref = set(windows(seq, 21))
        both = ref | {other(x) for x in ref}
        depth = Counter(x for own in cut.values() if own & both for x in own)
        kept = {x: d for x, d in depth.items() if d >= 2 or x in ref}
        graph = dict(kept)
        for x, d in kept.items():
            graph.setdefault(other(x), d)
        seeds = [x for x in ref if x in graph]
        assert bool(seeds) == (locus in found)
        if seeds:
            r = found[locus]
            assert r["weight"] == sum(graph[x] for x in windows(r["seq"], 21)) and not r["truncated"] and r["candidates"] >= 1
            top = max(graph[x] for x in seeds)
            assert any(graph.get(x) == top for x in windows(r["seq"], 21) if x in ref) or r["candidates"] > 1


def sharing(width):
    s = loci()
    own = {i: set(windows(x, width)) for i, x in s.items()}
    return s, [(a, b) for a in s for b in s if a != b and own[a] & own[b]]


def banded(a, b, band=8):
    low = -(10**9)
    h, e, f = (np.full((len(a) + 1, len(b) + 1), v) for v in (0, low, low))
    for i in range(1, len(a) + 1):
        for j in range(max(1, i - band), min(len(b), i + band) + 1):
            inside = lambda p, q: abs(p - q) <= band and q >= 1 and p >= 1
            e[i, j] = max((h[i, j - 1] if inside(i, j - 1) else low) - 6, (e[i, j - 1] if inside(i, j - 1) else low) - 1, -6 if not inside(i, j - 1) else low)
            f[i, j] = max((h[i - 1, j] if inside(i - 1, j) else 0) - 6, (f[i - 1, j] if inside(i - 1, j) else low) - 1)
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -3), e[i, j], f[i, j])
    return h.max()


def alignment_scores(got):
    s, pairs = sharing(9)
    assert {(r["a"], r["b"]) for r in got} == {p for p in pairs if p[0] < p[1]}
    for n, r in enumerate(sorted(got, key=lambda r: (r["a"], r["b"]))):
        a, b = s[r["a"]], s[r["b"]]
        assert r["local_score"] == local_score(a, b) and r["family_score"] == local_score(a, b, 2, -2, -3)  # itself held to a plain version
        if n < 4:
            assert r["banded_score"] == banded(a, b)


def best_foreign(got):
    s, pairs = sharing(9)
    best = {}
    for a, b in pairs:
        best[a] = max(best.get(a, (-1, 0)), (local_score(s[a], s[b]), -b))
    assert {r["locus"]: (r["own_score"], r["foreign_locus"], r["foreign_score"]) for r in got} == {i: (2 * len(x), -best[i][1] if i in best else None, best[i][0] if i in best else None) for i, x in s.items()}


def em_abundance(got):
    classes = Counter(tuple(sorted(set(t))) for (t,) in rows("SELECT list(event_type) FROM $events GROUP BY event_id // 4"))
    names = sorted({t for c in classes for t in c})
    share = {t: 1 / len(names) for t in names}
    for _ in range(64):
        new = dict.fromkeys(names, 0.0)
        for c, n in classes.items():
            for t in c:
                new[t] += n * share[t] / sum(share[x] for x in c)
        share = {t: v / sum(classes.values()) for t, v in new.items()}
    assert {r["target"]: pytest.approx(r["share"]) for r in got} == share


def bootstrap(got):
    want = {e: (h, n) for e, h, n in rows("SELECT event_type, count(*) FILTER (WHERE value >= 50), count(*) FROM $events GROUP BY 1")}
    assert {r["event_type"] for r in got} == set(want)
    for r in got:
        h, n = want[r["event_type"]]
        p, error = h / n, np.sqrt(h / n * (1 - h / n) / n)
        assert r["share"] == pytest.approx(p) and abs(r["low"] - max(0, p - 1.96 * error)) < 0.6 * error + 1e-9 and abs(r["high"] - min(1, p + 1.96 * error)) < 0.6 * error + 1e-9


def nation_graphs():
    out = defaultdict(set)
    for n, c in rows("SELECT c_nationkey, c_custkey FROM $customer"):
        out[n].add((str(c % 29), str((c * 3 + 1) % 31)))
    return out


def bubble_table(got):
    want = set()
    for n, edges in nation_graphs().items():
        out, into = defaultdict(set), defaultdict(set)
        for a, b in edges:
            out[a].add(b)
            into[b].add(a)
        for a in list(out):
            if len(out[a]) > 1:
                ends = []
                for x in out[a]:
                    steps = 0
                    while len(into[x]) == 1 and len(out[x]) == 1 and steps < 256:
                        (x,), steps = out[x], steps + 1
                    ends.append(x)
                same = len(ends) == 2 and ends[0] == ends[1] and len(into[ends[0]]) == 2
                kind = "simple" if same else "terminal" if any(not out[e] and len(into[e]) <= 1 for e in ends) else "complex"
                want.add((n, a, ends[0] if same else None, kind))
    assert {(r["locus"], r["begin"], r["meets"], r["kind"]) for r in got} == want and len(got) == len(want)


def shortest_bridges(got):
    paths = defaultdict(list)
    for r in sorted(got, key=lambda r: r["ord"]):
        paths[r["locus"]].append(r["node"])
    for n, edges in nation_graphs().items():
        ways, level, seen = None, {"1": [["1"]]}, {"1"}
        while level and "20" not in level:
            following = defaultdict(list)
            for x, some in level.items():
                for a, b in edges:
                    if a == x and b not in seen:
                        following[b] += [[*p, b] for p in some]
            seen |= set(following)
            level = following
        ways = level.get("20", [])
        assert paths.get(n, []) == (ways[0] if len(ways) == 1 else [])


def overlap_collapse(got):
    made = defaultdict(list)
    for r in got:
        made[r["locus"]].append(r["seq"])
    whole = 0
    for i, s in loci().items():
        pieces = [s[a : a + 110] for a in range(0, len(s), 60)]
        assert all(any(p in m or other(p) in m for m in made[i]) for p in pieces)
        assert all(m == min(m, other(m)) for m in made[i])
        whole += made[i] == [min(s, other(s))]
    assert whole >= 0.9 * len(made)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def arm_catalogue(got):
    import hashlib

    digest = lambda t: hashlib.md5(t.encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4))
    sketch = lambda s: set(sorted(set(windows(s, 11)))[:16])
    found = {(r["sample"], r["id"]): r["cluster"] for r in got}
    samples = defaultdict(list)
    for (p,) in rows("SELECT p_partkey FROM $part"):
        samples[p % 20].append((str(p), digest(str(p % 60)), digest(f"r{p % 60}")))
    assert len(found) == sum(map(len, samples.values()))
    for sample, arms in samples.items():
        centres = []
        for i, left, right in sorted(arms):
            near = sorted((distance(left, x) + distance(right, y), n) for n, (x, y) in enumerate(centres) if len(sketch(left) & sketch(x)) >= 2 and len(sketch(right) & sketch(y)) >= 2)
            near = [d for d in near if d[0] <= 3]
            if near and (len(near) == 1 or near[0][0] < near[1][0]):
                assert found[sample, i] == near[0][1]
            else:
                assert found[sample, i] == len(centres)
                centres.append((left, right))


def tiles():
    """Fragments of each locus as the queries make them: (locus, fragment) to sequence."""
    out = {}
    for i, s in loci().items():
        for t, start in enumerate(range(0, len(s), 30)):
            bait = (s + s + s)[start : start + min(60, len(s))]
            out[i, i * 1000 + t] = other(bait) if t % 2 else bait
    return out


def affine_on_diagonal(a, b, diagonal, band=8):
    """The best local score with gaps of 5 and 1 a base, in a band of places i in a and j in b with |i - j - diagonal| up to its width."""
    low, best = -(10**9), 0
    h, e, f = {}, {}, {}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if abs(i - j - diagonal) <= band:
                e[i, j] = max(h.get((i, j - 1), low) - 6, e.get((i, j - 1), low) - 1)
                f[i, j] = max(h.get((i - 1, j), low) - 6, f.get((i - 1, j), low) - 1)
                h[i, j] = max(0, h.get((i - 1, j - 1), 0) + (2 if a[i - 1] == b[j - 1] else -3), e[i, j], f[i, j])
                best = max(best, h[i, j])
    return best


def shadow_report(got):
    s, by = loci(), defaultdict(list)
    for n, ((_, fragment), x) in enumerate(tiles().items()):
        for locus, y in s.items():
            here = defaultdict(list)
            for j, w in enumerate(windows(y, 11)):
                here[w].append(j)
            offsets = Counter(j - i for i, w in enumerate(windows(x, 11)) for j in here.get(w, ()))
            if offsets:
                offset = min(offsets, key=lambda o: (-offsets[o], o))  # noqa: B023
                by[locus].append(affine_on_diagonal(x, y, -offset))
    assert {r["locus"]: (r["mates"], r["aligned"], r["best"], pytest.approx(r["mean"], abs=1e-5)) for r in got} == {i: (len(v), sum(x >= 80 for x in v), max(v), sum(v) / len(v)) for i, v in by.items()}


def circles(got):
    s = {i: x for i, x in loci().items() if len(x) >= 100}
    assert {r["locus"] for r in got} == set(s)
    for r in got:
        x = s[r["locus"]]
        text = x + x[:45]
        # the longest overlap of the two ends that is alike to 0.98 closes the circle
        longest = next(n for n in range(len(text) // 2, 0, -1) if len(text) - n >= 41 and sum(p == q for p, q in zip(text[:n], text[-n:], strict=True)) >= 0.98 * n)
        assert r["closed"] == text[: len(text) - longest] and r["standard"] in {x[i:] + x[:i] for i in range(len(x)) if (x + x)[i : i + 60] == x[:60]}


def local_alignments(got):
    s, found = loci(), {r["fragment"]: r for r in got}
    for (locus, fragment), x in tiles().items():
        r = found.pop(fragment)
        a, b = x[r["a_start"] : r["a_end"]], s[locus][r["b_start"] : r["b_end"]]
        assert r["score"] == local_score(x, s[locus])
        assert local_score(a, b) == r["score"] and r["same"] <= min(len(a), len(b))  # its spans alone give the score
        if len(a) == len(b) and r["score"] == 2 * len(a):
            assert a == b and r["same"] == len(a)
    assert not found


def sample_components(got):
    from strandframe.plans.bridges import GENOTYPES

    best = {}
    for site, sample, gt in rows(f"SELECT site, sample % 10, gt FROM {GENOTYPES.replace('FROM lineitem', 'FROM $lineitem')} WHERE gt NOT LIKE '%.%'"):
        best[site, sample] = max(best.get((site, sample), 0), gt.count("1"))
    sites = sorted({s for s, _ in best})
    x = np.array([[best.get((s, p), np.nan) for s in sites] for p in range(10)])
    p = np.nanmean(x, axis=0) / 2
    x, p = x[:, (p > 0) & (p < 1)], p[(p > 0) & (p < 1)]
    z = np.nan_to_num((x - 2 * p) / np.sqrt(2 * p * (1 - p)))
    u, d, _ = np.linalg.svd(z, full_matrices=False)
    for c in range(3):
        mine = np.array([r["value"] for r in sorted(got, key=lambda r: r["sample"]) if r["component"] == c + 1])
        assert abs(abs(mine @ u[:, c]) - 1) < 1e-6 and mine[np.abs(mine).argmax()] > 0
        assert next(r["share"] for r in got if r["component"] == c + 1) == pytest.approx(d[c] ** 2 / (d**2).sum())


def rescue_rounds(got):
    from strandframe.operators.graphs import assembled

    reads = {i: set(windows(bases(t or ""), 21)) for i, t in rows("SELECT doc_id, text FROM $documents")}
    found = {r["locus"]: r for r in got}
    for locus, whole in loci().items():
        seq = whole[len(whole) // 3 : len(whole) // 3 * 2]
        ref = windows(seq, 21)

        def recruited(texts):
            known = {x for t in texts for x in windows(t, 21)}
            known |= {other(x) for x in known}
            return {i for i, own in reads.items() if own & known}

        def contig(ids):
            depth = Counter(x for i in ids for x in reads[i])
            made = assembled({x: d for x, d in depth.items() if d >= 2 or x in set(ref)}, ref)  # noqa: B023; the walks have tests of their own
            return min(made, key=lambda c: (-c[1], -len(c[0]), c[0]))[0] if made else None

        one = recruited([seq])
        first = contig(one)
        assert (locus in found) == (first is not None)
        if first is None:
            continue
        two = one | recruited([first[:60], first[-60:]])
        second, r = contig(two), found[locus]
        state = "inactive" if two == one else "rescued" if len(second) > len(first) else "rolled_back"
        assert (r["length"], r["rescued_length"], r["new_reads"], r["state"]) == (len(first), len(second), len(two - one), state)


BRUTE = {f.__name__: f for f in (unitig_table, component_table, bridge_table, backbone_table, contig_table, alignment_scores, best_foreign, em_abundance, bootstrap, bubble_table, shortest_bridges, overlap_collapse, arm_catalogue, shadow_report, circles, local_alignments, rescue_rounds, sample_components)}


def test_every_query_has_sql_or_a_plain_version():
    from .test_flows import FLOWS

    assert set(catalogue.queries()) == set(catalogue.oracle_sql()) | set(BRUTE) | set(FLOWS)


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_query_against_plain_version(spark, name):
    BRUTE[name](catalogue.queries()[name](spark, SF).collect())
