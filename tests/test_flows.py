"""Whole flows against plain versions: closed circles, repeat families, pruned sites, contigs led by pairs, rounds of doubling, clades."""

import math
import random
from collections import Counter, defaultdict

import pytest

from strandframe.operators import closure as C
from strandframe.operators import repeats as R
from strandframe.plans import catalogue

from .test_brute import SF, bases, loci, other, rows, windows


def closed_circles(got):
    """Each fourth locus is a mixture of two circles; the others close to themselves."""
    own = loci()
    assert {r["sample"] for r in got} == set(own)
    for r in got:
        if r["sample"] % 4 == 0 and r["sample"] + 1 in own:
            assert (r["status"], r["reason"], r["circle"]) == ("linear_single_contig", "ambiguous", None) and r["standing"] >= 2
        else:
            assert (r["status"], r["reason"]) == ("circular", "verified_circular"), r
            assert C.canonical_circle(r["circle"]) == C.canonical_circle(own[r["sample"]])


def all_ways(nodes, start, goal, most):
    out = []

    def go(x, path, on):
        for b in "ACGT":
            y = x[1:] + b
            if len(path) + 1 > most or y in on or y != goal and y not in nodes:
                continue
            if y == goal:
                out.append(path + b)
            else:
                go(y, path + b, on | {y})

    go(start, "", {start})
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_closing_paths_are_all_simple_paths(seed):
    rng = random.Random(seed)
    k = 3
    text = "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 60)))
    nodes = {text[i : i + k]: rng.randint(1, 3) for i in range(len(text) - k + 1)}
    start, goal = text[:k], text[-k:]
    if start == goal:
        return
    for least, most in ((1, 12), (2, 20)):
        want = all_ways({x for x, n in nodes.items() if n >= least}, start, goal, most)
        found, more = C.closing_paths(nodes, start, goal, most, least, limit=10**6, tries=10**6)
        assert sorted(found) == want and not more
        some, more = C.closing_paths(nodes, start, goal, most, least, limit=2)
        assert more == (len(want) > 2) and len(some) == min(2, len(want))


def test_circles_have_one_name():
    rng = random.Random(1)
    for _ in range(200):
        s = "".join(rng.choice("ACG") for _ in range(rng.randint(1, 12)))
        turn = rng.randrange(len(s))
        assert C.least_turn(s) == min(s[i:] + s[:i] for i in range(len(s)))
        assert C.canonical_circle(s) == C.canonical_circle(other(s[turn:] + s[:turn]))
    assert C.canonical_circle("") == ""


def pairs_of(sample, circle, first, step=3, begin=0, end=None):
    around = circle + circle[:64]
    end = len(circle) if end is None else end
    return [(sample, first + i, around[i : i + 40], other(around[i : i + 64][-40:])) for i in range(begin, end, step) if len(around[i : i + 64]) == 64]


def test_reasons_of_circles_that_do_not_close(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    whole, lone, far, overlap, odd = text(400), text(300), text(300), text(380), text(200)
    contigs = [
        ("closed", 0, whole[:390]),
        ("lone", 1, lone),
        ("parts", 2, far[:140]), ("parts", 3, text(150)),
        ("overlap", 4, overlap + overlap[:40]),
        ("lap", 5, odd + odd + odd[:20]),
        ("none", 6, ""), ("none", 7, None),
        ("short", 8, "ACGTACGTTT"),
        ("strand", 9, whole[:200]), ("strand", 10, other(whole[205:390])),
    ]
    pairs = [
        *pairs_of("closed", whole, 0), *pairs_of("lone", lone, 10_000, begin=0, end=230),
        *pairs_of("overlap", overlap, 20_000, begin=0, end=310), *pairs_of("lap", odd, 30_000),
        *pairs_of("strand", whole, 40_000),
        ("short", 50_000, None, "ACGT"),
    ]
    df = C.closed_circles(spark.createDataFrame(contigs, "sample string, id long, seq string"), spark.createDataFrame(pairs, "sample string, fragment long, seq1 string, seq2 string"))
    got = {r["sample"]: r for r in df.collect()}
    assert {s: r["reason"] for s, r in got.items()} == {
        "closed": "verified_circular", "lone": "insufficient_coverage", "parts": "partial_multi_component", "overlap": "closure_candidate_unverified",
        "lap": "verified_circular", "short": "insufficient_coverage", "strand": "verified_circular",
    }
    assert got["lap"]["method"] == "unrolled_cycle" and C.canonical_circle(got["lap"]["circle"]) == C.canonical_circle(odd)
    for s in ("closed", "strand"):
        assert C.canonical_circle(got[s]["circle"]) == C.canonical_circle(whole)
    assert sorted(got["strand"]["members"]) == [9, 10] and got["strand"]["components"] == 1
    empty = df.sparkSession.createDataFrame([], "sample string, id long, seq string")
    assert not C.closed_circles(empty, df.sparkSession.createDataFrame([], "sample string, fragment long, seq1 string, seq2 string")).count()


def period_of(s):
    return next((p for p in range(1, len(s) // 2 + 1) if sum(s[i] == s[i % p] for i in range(len(s))) >= 0.85 * len(s)), None)


def motif_of(s):
    return min(t[i:] + t[:i] for t in (s, other(s)) for i in range(len(s)))


def plain_families(reads, k=25, least=8):
    """{family: {kmer: n}} by pairwise joining."""
    counts = Counter(min(x, other(x)) for _, _, s in reads for x in windows(s, k))
    freq = {x: n for x, n in counts.items() if n >= least}
    group = {x: x for x in freq}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ends, begins, motifs = defaultdict(set), defaultdict(set), {}
    for x in freq:
        for z in (x, other(x)):
            ends[z[1:]].add(x)
            begins[z[:-1]].add(x)
        if period_of(x):
            motif = motif_of(x[: period_of(x)])
            a, b = find(x), find(motifs.setdefault(motif, x))
            group[max(a, b)] = min(a, b)
    for key in ends:
        if len(ends[key]) == 1 and len(begins[key]) == 1:
            a, b = find(*ends[key]), find(*begins[key])
            group[max(a, b)] = min(a, b)
    out = defaultdict(dict)
    for x, n in freq.items():
        out[find(x)][x] = n
    return out


def plain_extension(depth, seed, paths=3, ratio=1.5):
    live, done = [(depth[seed], seed)], []
    while live:
        grown = []
        for total, text in live:
            on = set(windows(text, len(seed)))
            ways = [(depth[y], y) for b in "ACGT" if (y := text[-len(seed) + 1 :] + b) in depth and y not in on]
            ways = [(d, y) for d, y in ways if d * ratio > max(ways)[0]]
            grown += [(total + d, text + y[-1]) for d, y in ways]
            if not ways:
                done.append((total, text))
        live = sorted(grown, key=lambda t: (-t[0], t[1]))[:paths]
    return sorted(done, key=lambda t: (-t[0], t[1]))[:paths]


def plain_library(reads, families, k=25):
    out = {}
    for name, kmers in families.items():
        own = [s for _, _, s in reads if any(x in kmers or other(x) in kmers for x in windows(s, k))]
        depth = Counter(x for s in own for x in {min(x, other(x)) for x in windows(s, k)})
        depth = {x: n for x, n in depth.items() if n >= 3 and n >= 0.05 * len(own)}
        depth |= {other(x): n for x, n in depth.items()}
        seed = min(kmers, key=lambda x: (-kmers[x], x))
        if seed not in depth:
            tandem = [x for x in kmers if period_of(x)]
            if tandem:
                seed = min(tandem, key=lambda x: (-kmers[x], x))
                out[name] = [(kmers[seed], seed[: period_of(seed)] * math.ceil(3 * k / period_of(seed)))]
            continue
        both = {}
        for a, x in plain_extension(depth, other(seed)):
            for b, y in plain_extension(depth, seed):
                text = other(x) + y[k:]
                key = min(text, other(text))
                both[key] = max(both.get(key, 0), a + b - depth[seed])
        out[name] = sorted(((n, s) for s, n in both.items()), key=lambda t: (-t[0], t[1]))[:3]
    return out


def plain_hits(reads, library, k=25):
    """{(sample, read): {family: identity}}"""
    out = defaultdict(dict)
    for name, ways in library.items():
        for sample, read, s in reads:
            lines = Counter()
            for path, (_, c) in enumerate(ways):
                for strand, text in ((0, c), (1, other(c))):
                    at = defaultdict(list)
                    for i, x in enumerate(windows(text, k)):
                        at[x].append(i)
                    for i, x in enumerate(windows(s, k)):
                        for j in at.get(x, ()):
                            lines[path, strand, j - i] += 1
            if not lines:
                continue
            path, strand, shift = min(lines, key=lambda t: (-lines[t], t))
            text = ways[path][1] if not strand else other(ways[path][1])
            pairs = [(text[i + shift], s[i]) for i in range(len(s)) if 0 <= i + shift < len(text)]
            same = sum(a == b for a, b in pairs) / len(pairs)
            if same >= 0.8 and len(pairs) / min(len(s), len(text)) >= 0.6:
                out[sample, read][name] = same
    return out


def plain_signal(reads, hits):
    size, own = Counter(r[0] for r in reads), defaultdict(list)
    for (sample, _), found in hits.items():
        near = {f: i for f, i in found.items() if i > max(found.values()) - 0.1}
        for f, i in near.items():
            own[sample, f].append((len(near) == 1, i))
    return {key: (size[key[0]], sum(a for a, _ in v), sum(not a for a, _ in v), sum(i for _, i in v) / len(v)) for key, v in own.items()}


def document_reads():
    return [(s, i, bases(t)) for i, s, t in rows("SELECT doc_id, source, text FROM $documents")]


def repeat_families(got):
    reads = document_reads()
    families = plain_families(reads)
    library = plain_library(reads, families)
    heard = plain_signal(reads, plain_hits(reads, library))
    assert {r["family"] for r in got} == set(families) and len(got) == len(families)
    for r in got:
        own, name = families[r["family"]], r["family"]
        assert (r["seeds"], r["occurrences"]) == (len(own), sum(own.values()))
        assert r["class"] == ("tandem-like" if any(map(period_of, own)) else "dispersed-repeat")
        ways = library.get(name, [])
        assert (r["paths"], r["seq"], r["support"]) == (len(ways), *((ways[0][1], ways[0][0]) if ways else (None, None)))
        mine = [v for (_, f), v in heard.items() if f == name]
        specific, ambiguous = sum(v[1] for v in mine), sum(v[2] for v in mine)
        assert (r["specific"], r["ambiguous"], r["samples"]) == (specific, ambiguous, sum(v[1] > 0 for v in mine))
        if r["decision"] != "flagged_low_complexity":
            assert r["decision"] == ("retained" if specific >= 10 and specific >= 0.7 * (specific + ambiguous) else "retained_low_support" if specific or not ambiguous else "flagged_ambiguous")


def repeat_signal(got):
    reads = document_reads()
    want = plain_signal(reads, plain_hits(reads, plain_library(reads, plain_families(reads))))
    assert {(r["sample"], r["family"]) for r in got} == set(want)
    for r in got:
        n, specific, ambiguous, identity = want[r["sample"], r["family"]]
        assert (r["effective"], r["specific"], r["ambiguous"]) == (n, specific, ambiguous)
        assert abs(r["mean_identity"] - identity) < 1e-5 and abs(r["rpm"] - 1e6 * specific / n) < 1e-5


def test_planted_families_are_recovered(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    first, second, motif = text(180), text(150), "ACGGT"

    def noisy(s):
        return "".join(rng.choice("ACGT") if rng.random() < 0.01 else c for c in s)

    reads = []
    for i in range(160):
        at = rng.randrange(81)
        reads.append(noisy(first[at : at + 100]) if i % 2 else other(noisy(first[at : at + 100])))
        at = rng.randrange(51)
        reads.append(noisy(second[at : at + 100]))
        reads.append(text(40) + motif * 9 + text(15))
    reads += [text(100) for _ in range(120)] + ["", None, "ACGTNNNN", "N" * 60]
    df = spark.createDataFrame([("s1" if i % 2 else "s2", i, s) for i, s in enumerate(reads)], "sample string, read long, seq string")
    members, library, signals = R.discovered(df)
    got = R.curated(members, library, signals).collect()
    best = {min(r["seq"], other(r["seq"])): r for r in got if r["specific"] >= 50}
    for planted in (first, second):
        # the consensus holds the family but for a few bases at its ends, which few reads cover
        assert any(planted[12:-12] in s or other(planted[12:-12]) in s for s in best), planted
    tandem = [r for r in got if r["class"] == "tandem-like"]
    assert any(motif_of(motif) == motif_of(r["family"][:5]) for r in tandem)
    assert all(r["decision"] == "retained" for r in best.values())
    state = {(r["sample"], r["family"]): r["state"] for r in signals.collect()}
    assert all(state[s, r["family"]] == "PRESENT" for r in best.values() for s in ("s1", "s2"))


def test_extension_keeps_open_paths_and_tells_cuts():
    depth = {x: 1 for x in windows("CCGGTTTG", 4)} | {x: 5 for s in ("AACCGGTTA", "ACCGGTTCAG") for x in windows(s, 4)}
    found, cut = R.extended(depth, "AACC")
    assert found == plain_extension(depth, "AACC") and not cut and len(found) == 2
    found, cut = R.extended(depth, "AACC", most=3)
    assert found == [(20, "AACCGGT")] and cut


def plain_pruning(calls, window=50, step=5, most=0.2):
    """{(chrom, site): kept}, windows gone through one after the other; calls {chrom: {site: {sample: n}}}."""
    out = {}
    for chrom, by_site in calls.items():
        order = sorted(by_site)
        kept = dict.fromkeys(order, True)
        maf = {s: min(p, 1 - p) for s, v in by_site.items() for p in [sum(v.values()) / (2 * len(v))]}

        def linked(s, t):
            both = [(by_site[s][x], by_site[t][x]) for x in by_site[s] if x in by_site[t]]  # noqa: B023
            c, x, y = len(both), sum(a for a, _ in both), sum(b for _, b in both)
            cov = c * sum(a * b for a, b in both) - x * y
            return cov * cov > most * ((c * sum(a * a for a, _ in both) - x * x) * (c * sum(b * b for _, b in both) - y * y))

        for begin in range(0, max(1, len(order)), step):
            held = order[begin : begin + window]
            for i, s in enumerate(held):
                for t in held[i + 1 :]:
                    if kept[s] and kept[t] and linked(s, t):
                        kept[s if maf[s] < maf[t] else t] = False
        out |= {(chrom, s): k for s, k in kept.items()}
    return out


def pruned_sites(got):
    calls = defaultdict(lambda: defaultdict(dict))
    for chrom, site, sample, gt in rows(
        """SELECT p_brand, l_partkey, l_suppkey, CASE WHEN sum(l_linenumber) % 5 = 0 THEN './.' WHEN min(l_returnflag) = 'A' THEN '0/1' WHEN min(l_returnflag) = 'N' THEN '1/1' ELSE '0/0' END
        FROM $lineitem JOIN $part ON p_partkey = l_partkey GROUP BY ALL"""
    ):
        if "." not in gt:
            calls[chrom][site][sample] = gt.count("1")
    want = plain_pruning(calls)
    assert {(r["chrom"], r["site"]): r["kept"] for r in got} == want and len(got) == len(want)
    assert 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("window,step,most", [(50, 5, 0.2), (10, 3, 0.5), (7, 7, 0.1), (4, 1, 0.3)])
def test_pruning_equals_a_sequential_reading(spark, window, step, most):
    from strandframe.operators.pruning import pruned

    rng = random.Random(window)
    calls = {}
    for chrom, n in (("c1", 120), ("c2", 30), ("c3", 1)):
        sites, last = {}, [rng.choice((0, 1, 2)) for _ in range(25)]
        for s in range(n):
            if rng.random() < 0.3:
                last = [rng.choice((0, 1, 2)) for _ in range(25)]
            own = [rng.choice((0, 1, 2)) if rng.random() < 0.15 else x for x in last]
            sites[10 * s] = {i: x for i, x in enumerate(own) if rng.random() < 0.95}
        sites[10 * n + 5] = dict.fromkeys(range(25), 1)  # does not vary
        calls[chrom] = sites
    table = [(c, s, x, float(n)) for c, v in calls.items() for s, w in v.items() for x, n in w.items()]
    got = pruned(spark.createDataFrame(table, "chrom string, site long, sample int, n double").repartition(5), "chrom", window, step, most)
    assert {(r["chrom"], r["site"]): r["kept"] for r in got.collect()} == plain_pruning(calls, window, step, most)
    assert pruned(spark.createDataFrame([], "chrom string, site long, sample int, n double"), "chrom").count() == 0


def plain_kmers(pairs, ref, k, error_limit=2, least=2):
    """{kmer: (depth, rescued)} of one locus and its mates as (fragment, sequence, is anchored, whose other is)."""
    both = set(ref) | {other(x) for x in ref}
    anchored = lambda s: any(x in both for x in windows(s, k))
    mates = [(f, s, anchored(s), anchored(t)) for f, a, b in pairs for s, t in ((a, b), (b, a))]
    depth, vouched = Counter(), Counter()
    for _, s, own, opposite in mates:
        for x in set(windows(s, k)) | set(windows(other(s), k)):
            depth[x] += 1
            vouched[x] += opposite and not own
    keep = {x: (d, False) for x, d in depth.items() if d > error_limit or x in both}
    keep |= {x: (d, True) for x, d in depth.items() if x not in keep and vouched[x] >= least}
    return keep, mates


def plain_edges(kmers, mates, k):
    forks = {x + b for x in kmers for b in "ACGT" if x[1:] + b in kmers and sum(x[1:] + c in kmers for c in "ACGT") > 1}
    passed = {e: set() for e in forks}
    for f, s, _, opposite in mates:
        if opposite:
            for e in set(windows(s, k + 1)) | set(windows(other(s), k + 1)):
                if e in forks:
                    passed[e].add(f)
    return {e: len(v) for e, v in passed.items()}


def circle_pairs():
    own, out = loci(), {}
    for n, seq in own.items():
        texts = [seq]
        if n % 4 == 0 and n + 1 in own:
            texts.append(seq[:-12] + own[n + 1][:30])
        out[n] = [((of, at), f[:40], other(f[-40:])) for of, t in enumerate(texts) for at in range(0, len(t), 3) for f in [(t[at:] + t[:at])[:64]]]
    return out


def branch_support(got):
    want = {}
    for n, pairs in circle_pairs().items():
        seq = loci()[n]
        kmers, mates = plain_kmers(pairs, windows(seq[: 2 * len(seq) // 3], 21), 21)
        want |= {(n, e): c for e, c in plain_edges(kmers, mates, 21).items()}
    assert {(r["locus"], r["edge"]): r["fragments"] for r in got} == want and any(want.values())


def paired_contigs(got):
    from strandframe.operators.graphs import assembled

    reads = {i: bases(t or "") for i, t in rows("SELECT doc_id, text FROM $documents")}
    both = lambda s: set(windows(s, 21)) | set(windows(other(s), 21))
    every = set().union(*map(both, loci().values()))
    cut = [((i, at), s[at : at + 40], other(s[at + 50 : at + 90])) for i, s in reads.items() if set(windows(s, 21)) & every for at in range(0, len(s) - 89, 15)]
    found = {r["locus"]: r for r in got}
    for n, seq in loci().items():
        own = both(seq)
        pairs = [p for p in cut if set(windows(p[1], 21)) & own or set(windows(p[2], 21)) & own]
        kmers, mates = plain_kmers(pairs, windows(seq, 21), 21)
        edges = {(e[:-1], e[1:]): c for e, c in plain_edges(kmers, mates, 21).items() if c}
        made = assembled({x: d for x, (d, _) in kmers.items()}, windows(seq, 21), soft_boundary=5, pairs=edges, rescued={x for x, (_, r) in kmers.items() if r}, error_limit=2)
        assert bool(made) == (n in found)
        if made:
            best = min(made, key=lambda c: (-c[1], -len(c[0]), c[0]))
            assert (found[n]["seq"], found[n]["weight"], found[n]["candidates"]) == (best[0], best[1], len(made))


def test_a_repeat_is_crossed_by_pairs_alone(spark):
    from strandframe.functions import sequence as S
    from strandframe.operators.pair_edges import paired_contigs as run

    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, repeat, b, c, d = text(120), text(30), "T" + text(119), text(120), "A" + text(119)
    right, wrong = a + repeat + b, c + repeat + d  # the second one is foreign, as deep, and comes first where nothing else decides
    pairs = lambda s, times, first, gap: [("x", first + 1000 * t + i, s[i : i + 50], other(s[i + gap : i + gap + 50])) for t in range(times) for i in range(0, len(s) - gap - 49, 4)]
    singles = lambda rows: [(n, f + 500_000 + 10_000 * m, s, "") for n, f, x, y in rows for m, s in ((1, x), (2, y))]
    rows_ = pairs(right, 1, 0, 70) + pairs(wrong, 1, 100_000, 70)
    loc = spark.createDataFrame([("x", a)], "locus string, seq string")
    ref = S.kmers(loc, 21).select("locus", "pos", "kmer")
    frame_ = lambda rows: spark.createDataFrame(rows, "locus string, fragment long, seq1 string, seq2 string")
    led = run(frame_(rows_), ref).first()
    alone = run(frame_(singles(rows_)), ref).first()
    assert b[:60] in led["seq"] and d[:60] not in led["seq"]
    assert d[:60] in alone["seq"] and b[:60] not in alone["seq"]
    assert run(frame_([]), ref).count() == 0 and run(frame_([("x", 1, None, "")]), ref).count() == 0


def test_thin_kmers_stay_where_a_mate_vouches_for_them(spark):
    from strandframe.operators import graphs as G
    from strandframe.operators import pair_edges as P

    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    anchor, flank, error = text(60), text(40), text(40)
    pairs = [("x", 1, anchor, other(flank)), ("x", 2, anchor[5:], other(flank)), ("x", 3, error, error), ("x", 4, error, "")]
    ref = spark.createDataFrame([("x", i, w) for i, w in enumerate(windows(anchor, 21))], "locus string, pos int, kmer string")
    mates = P.anchored_mates(spark.createDataFrame(pairs, "locus string, fragment long, seq1 string, seq2 string"), ref, 21)
    got = {r["kmer"]: (r["depth"], r["rescued"]) for r in P.weighed_kmers(mates, ref, 21).collect()}
    want, _ = plain_kmers([p[1:] for p in pairs], windows(anchor, 21), 21)
    assert got == want and got[flank[:21]] == (2, True) and windows(error, 21)[0] in got
    terms = G.WalkGraph({"AAC": 5, "ACG": 2, "ACT": 3}, {}, {("AAC", "ACT"): 3}, {"ACG"})
    assert terms.terms("AAC", "ACG")["rescued"] == -16 and terms.terms("AAC", "ACT")["pairs"] == 18
    assert terms.continuations("AAC", set()) == [(21, "ACT"), (-14, "ACG")]


def plain_rounds(reads, see, initial, maximum):
    """{sample: (observation, rounds, reads, settled)} by a plain loop, and which samples each round took."""
    out, took, before, limit, number = {}, [], {}, initial, 0
    while limit <= maximum:
        active = [s for s in reads if s not in out]
        if not active:
            break
        took.append((limit, sorted(active)))
        now = {s: see(s, reads[s][:limit]) for s in active}
        number += 1
        last = limit == maximum
        for s in active:
            if before.get(s) == now[s] or last:
                out[s] = (now[s], number, limit, before.get(s) == now[s])
        before, limit = now, maximum + 1 if last else min(2 * limit, maximum)
    return out, took


def adaptive_circles(got):
    import hashlib

    from strandframe.operators.graphs import assembled

    own = loci()

    def see(sample, pairs):
        ref = windows(own[sample][:60], 21)
        kmers, mates = plain_kmers(pairs, ref, 21, error_limit=0)
        edges = {(e[:-1], e[1:]): c for e, c in plain_edges(kmers, mates, 21).items() if c}
        made = assembled({x: d for x, (d, _) in kmers.items()}, ref, pairs=edges, error_limit=0)
        if not made:
            return "missing", None
        seq = min(made, key=lambda c: (-c[1], -len(c[0]), c[0]))[0]
        circle = next((seq[:p] for p in range(1, len(seq) - 19) if seq[p:] == seq[:-p]), None)
        return ("circular", C.canonical_circle(circle)) if circle else ("linear", min(seq, other(seq)))

    number = lambda sample, f: (sample * 2 + f[0]) * 100000 + f[1]
    reads = {n: [p for _, p in sorted(((number(n, p[0]) * 48271 % 2147483647, number(n, p[0])), p) for p in pairs)] for n, pairs in circle_pairs().items()}
    want, took = plain_rounds(reads, see, 12, 192)
    assert len(took) > 2 and len(took[-1][1]) < len(took[0][1])
    assert {r["sample"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        (status, seq), rounds, n, settled = want[r["sample"]]
        assert (r["status"], r["seq"], r["rounds"], r["reads"], r["settled"]) == (status, seq, rounds, n, settled)
        assert r["digest"] == hashlib.sha256((seq or "").encode()).hexdigest()
    assert sum(r["status"] == "circular" and r["settled"] for r in got) > len(got) // 2


def test_settled_samples_are_not_read_again(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandframe.operators import doubling as D

    df = spark.createDataFrame([(s, i, v) for s, values in {"early": "aaaaaaaaaaaaaaaa", "late": "abcdefgggggggggg", "never": "abcdefghijklmnop", "short": "x"}.items() for i, v in enumerate(values)], "sample string, ord long, value string")
    stored = D.stored_by_sample(df)
    plans, took = [], []

    def observe(reads):
        plans.append(reads._jdf.queryExecution().toString())
        took.append(sorted({r["sample"] for r in reads.select("sample").distinct().collect()}))
        return reads.groupBy("sample").agg(F.max("value").alias("seq")).withColumn("status", F.lit("linear"))

    for listed in (1000, 0):
        monkeypatch.setattr(D, "LISTED", listed)
        plans.clear()
        took.clear()
        results, history = D.adaptive(stored, observe, 2, 12)
        reads = {s: [v for _, v in sorted((r["ord"], r["value"]) for r in df.collect() if r["sample"] == s)] for s in ("early", "late", "never", "short")}
        want, rounds = plain_rounds(reads, lambda s, v: ("linear", max(v)), 2, 12)
        assert {r["sample"]: ((r["status"], r["seq"]), r["rounds"], r["reads"], r["settled"]) for r in results.collect()} == want
        assert took == [r[1] for r in rounds] and took[-1] == ["late", "never"]
        assert sorted({(r["reads"], r["sample"]) for r in history.collect()}) == sorted((n, s) for n, names in rounds for s in names)
        if listed:
            assert all("PartitionFilters: [" in p and "sample" in p for p in plans)
    assert D.adaptive(stored, observe, 20, 12)[0].count() == 0
    assert D.adaptive(D.stored_by_sample(df.where("false")), observe, 2, 12)[0].count() == 0
    silent = D.adaptive(stored, lambda reads: observe(reads).where("sample = 'late'"), 2, 4)[0].collect()
    assert {r["status"] for r in silent if r["sample"] != "late"} == {"missing"}


def plain_tree(leaves, seqs, k=7):
    cut = {x: {min(w, other(w)) for w in windows(seqs[x], k)} for x in leaves}
    far = lambda x, y: 1 - len(cut[x] & cut[y]) / len(cut[x] | cut[y])
    groups = [[x] for x in sorted(leaves)]
    trees = {x: x for x in leaves}
    while len(groups) > 1:
        mean = lambda g, h: round(sum(far(x, y) for x in g for y in h) / (len(g) * len(h)), 12)
        g, h = min(((g, h) for i, g in enumerate(groups) for h in groups[i + 1 :]), key=lambda p: (mean(*p), min(p[0][0], p[1][0]), max(p[0][0], p[1][0])))
        if h[0] < g[0]:
            g, h = h, g
        groups = sorted([x for x in groups if x not in (g, h)] + [g + h])
        trees[g[0]] = (trees[g[0]], trees[h[0]])
    return trees[groups[0][0]]


def leaves_of(t):
    return [t] if isinstance(t, str) else [x for c in t for x in leaves_of(c)]


def plain_clades(tree, least, outgroups=frozenset()):
    """Every way to part the tree by one edge, both sides."""
    whole, sides = set(leaves_of(tree)), []

    def go(t):
        for c in () if isinstance(t, str) else t:
            own = frozenset(leaves_of(c))
            sides.extend([own, frozenset(whole - own)])
            go(c)

    go(tree)
    names = lambda own: {x.split("|")[0] for x in own}
    if outgroups and len({frozenset([s, frozenset(whole - s)]) for s in sides if names(s) == outgroups}) != 1:
        return None
    every = set(sides) | (set() if outgroups else {frozenset(whole)})
    good = sorted((sorted(s) for s in every if len(names(s)) == len(s) >= least and not names(s) & outgroups), key=lambda s: (-len(s), s))
    out = []
    for s in good:
        if not any(set(s) & set(t) for t in out):
            out.append(s)
    return out


def single_copy_clades(got):
    families = defaultdict(dict)
    for n, seq in loci().items():
        families[n // 10][f"s{n % 7 % 5}|{n // 10}|{n}"] = seq
    found = defaultdict(list)
    for r in got:
        assert r["error"] is None and r["n"] == len(r["leaves"]) == len(r["samples"])
        found[r["family"]].append((r["clade"], r["leaves"]))
    want = {f: plain_clades(plain_tree(list(own), own), 3) for f, own in families.items()}
    assert {f: [x for _, x in sorted(v)] for f, v in found.items()} == {f: v for f, v in want.items() if v} and found


@pytest.mark.parametrize("seed", range(25))
def test_clades_are_those_of_all_bipartitions(seed):
    from strandframe.operators.clades import chosen_clades

    rng = random.Random(seed)
    trees = [f"s{rng.randrange(6)}|{i}" for i in range(rng.randint(1, 14))]
    while len(trees) > 1:
        k = min(len(trees), rng.choice((2, 2, 3)))
        joined = tuple(trees.pop(rng.randrange(len(trees))) for _ in range(k))
        trees.append(joined)
    text = lambda t: t if isinstance(t, str) else "(" + ",".join(text(c) for c in t) + "):0.1"
    for outgroups in (frozenset(), frozenset({"s0"}), frozenset({"s1", "s2"})):
        error, found = chosen_clades(text(trees[0]) + ";", 2, outgroups)
        want = plain_clades(trees[0], 2, outgroups)
        assert (error is not None) == (want is None)
        assert want is None or [list(x) for x, _ in found] == want


def test_trees_that_cannot_be_read_are_told(spark):
    from strandframe.operators.clades import single_copy

    df = spark.createDataFrame([(1, "((a|1,b|1),(c|1,d|1));"), (2, "((a|1,b|1)"), (3, None), (4, "((a|1,a|2),(b|1,a|3));")], "family int, newick string")
    got = {(r["family"], r["clade"]): (r["leaves"], r["error"]) for r in single_copy(df, 2).collect()}
    assert got[1, 0] == (["a|1", "b|1", "c|1", "d|1"], None) and got[2, None][1] and got[4, 0][0] == ["a|3", "b|1"]


def extensions(got):
    found = {(r["locus"], r["kind"]): (r["seq"], r["truncated"]) for r in got}
    own, branched = loci(), 0
    assert len(found) == 3 * len(own) == len(got)
    for n, pairs in circle_pairs().items():
        depth, seed = Counter(x for _, a, b in pairs for s in (a, b) for x in set(windows(s, 15)) | set(windows(other(s), 15))), own[n][:15]
        assert found[n, "beam"] == (plain_extension(depth, seed)[0][1], False)
        text = seed
        while True:  # the greedy one
            ways = sorted(((depth[y], y) for b in "ACGT" if (y := text[-14:] + b) in depth and y not in windows(text, 15)), reverse=True)
            if not ways or len(ways) > 1 and ways[0][0] < 1.5 * ways[1][0]:
                break
            text += ways[0][1][-1]
        assert found[n, "greedy"] == (text, False)
        deepest, cut = found[n, "deepest"]
        weight = lambda s: sum(depth[x] for x in windows(s, 15))  # noqa: B023, E731
        path = windows(deepest, 15)
        assert path[0] == seed and len(set(path)) == len(path) and set(path) <= set(depth)
        branched += cut
        if not cut:  # all was searched
            assert weight(deepest) >= max(weight(found[n, "beam"][0]), weight(text))
    assert branched < len(own)


def test_searches_tell_when_they_are_cut_short():
    from strandframe.operators import assembly as Y

    rng = random.Random(4)
    text = "".join(rng.choice("ACGT") for _ in range(3000))
    depth = Counter(windows(text, 15))
    assert Y.deepest_walk(depth, text[:15]) == (text, False) and Y.deepest_walk(depth, text[:15], 100) == (text[:115], True)
    assert Y.deepest_walk(depth, text[:15], 2985) == (text, False)
    assert Y.beam_extension(depth, text[:15]) == ([text], False) and Y.beam_extension(depth, text[:15], length=100) == ([text[:115]], True)
    assert Y.beam_extension(depth, text[:15], length=2985) == ([text], False)
    assert Y.greedy_extension(depth, text[:15]) == text
    long = [(f"a{i:04}", f"a{i + 1:04}") for i in range(600)] + [("a0000", "b"), ("b", "a0600")]
    assert Y.bubbles(long) == [("a0000", "a0600", "simple")]
    assert Y.bubbles([("a", "b"), ("a", "c"), ("c", "d"), ("d", "c"), ("b", "e"), ("e", "f"), ("f", "e")]) == [("a", None, "complex")]


def test_duplicates_of_pairs_and_single_mates(spark):
    from strandframe.operators.duplicates import marked

    best, fine, poor = "I" * 10, "5" * 10, "#" * 10

    def pair(name, at, end, q, clip=0, sample="s"):
        first = f"{clip}S{10 - clip}M" if clip else "10M"
        return [(sample, name, 65, "c", at + clip, first, q), (sample, name, 145, "c", end - 11, "4M2D6M", q)]

    table = [
        *pair("a", 100, 200, fine), *pair("b", 100, 200, best), *pair("c", 100, 200, poor, clip=3),  # three copies, one of them clipped
        *pair("d", 100, 205, best), *pair("e", 100, 200, best, sample="t"),  # another end, another sample
        *pair("h", 100, 200, best), ("s", "h", 65 | 256, "c", 7, "10M", best),  # as good as b; a second alignment does not count
        ("s", "f", 73, "c", 100, "10M", best), ("s", "f", 133, "*", 0, "*", best),  # one mate, where pairs begin
        ("s", "g", 73, "c", 300, "10M", fine), ("s", "i", 73, "c", 300, "2H10M", fine), ("s", "j", 73, "c", 298, "10M", best), ("s", "k", 89, "c", 289, "10M", best),
        ("s", "l", 77, "*", 0, "*", best), ("s", "m", 73, "c", 900, "10M", None), ("s", "n", 73, "c", 900, "10M", "*"),
    ]
    got = {(r["sample"], r["qname"]): (r["ends"], r["duplicate"], r["of"]) for r in marked(spark.createDataFrame(table, "sample string, qname string, flag int, rname string, pos int, cigar string, qual string")).collect()}
    assert got == {
        ("s", "a"): (2, True, "b"), ("s", "b"): (2, False, "b"), ("s", "c"): (2, True, "b"), ("s", "h"): (2, True, "b"), ("s", "d"): (2, False, "d"), ("t", "e"): (2, False, "e"),
        ("s", "f"): (1, True, None), ("s", "g"): (1, False, "g"), ("s", "i"): (1, True, "j"), ("s", "j"): (1, False, "j"), ("s", "k"): (1, False, "k"),
        ("s", "m"): (1, False, "m"), ("s", "n"): (1, True, "m"),
    }


FLOWS = {f.__name__: f for f in (closed_circles, repeat_families, repeat_signal, pruned_sites, branch_support, paired_contigs, adaptive_circles, single_copy_clades, extensions)}


@pytest.mark.parametrize("name", sorted(FLOWS))
def test_flow_against_plain_version(spark, name):
    FLOWS[name](catalogue.queries()[name](spark, SF).collect())


def test_pairs_send_only_the_reference_whole(spark):
    """k-mers of mates, their edges and fragments meet in merge joins, however small the files that they are cut from."""
    from strandframe.operators import pair_edges as P

    pairs = spark.createDataFrame([(1, i, "ACGTTGCAACGTGG"[i % 3 :], "TTGACCAGTACGAT") for i in range(9)], "locus long, fragment long, seq1 string, seq2 string")
    ref = spark.createDataFrame([(1, 0, "ACGTT"), (1, 1, "CGTTG")], "locus long, pos int, kmer string")
    mates = P.anchored_mates(pairs, ref, 5)
    kmers = P.weighed_kmers(mates, ref, 5)
    for table, sent in ((mates, 1), (P.branch_support(mates, kmers, 5), None)):
        plan = table._jdf.queryExecution().sparkPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        whole = [line for line in joins if "Broadcast" in line]
        assert len(joins) > len(whole) and all("BuildRight" in line and "kmer" in line for line in whole)
        assert sent is None or len(whole) == sent
