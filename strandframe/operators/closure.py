"""Circles from contigs and pairs of reads: components are bridged, every way to close one is looked for, and reads judge each way."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from .assembly import collapsed, flipped
from .evidence import near_windows
from .graphs import written

STATES = {"verified_circular": "circular", "partial_multi_component": "partial_multi_contig"}


def least_turn(s: str) -> str:
    """the least rotation of a text, in time proportional to its length."""
    doubled, i, j, n = s + s, 0, 1, 0
    while i < len(s) and j < len(s) and n < len(s):
        a, b = doubled[i + n], doubled[j + n]
        if a == b:
            n += 1
            continue
        if a > b:
            i += n + 1
        else:
            j += n + 1
        j, n = j + (i == j), 0
    at = min(i, j)
    return doubled[at : at + len(s)]


def canonical_circle(s: str) -> str:
    """The same text for every rotation of a circle on either strand."""
    return min(least_turn(s), least_turn(flipped(s)))


def closing_paths(depth: dict[str, int], start: str, goal: str, most: int, least: int = 2, limit: int = 16, tries: int = 20_000) -> tuple[list[str], bool]:
    """Every way from one k-mer to another that uses no k-mer twice and has at most so many bases: what is appended, in order of bases.

    The steps that are still needed to the goal are counted backwards first, so a way that cannot end in time is not begun.
    The second value tells that there are more ways than limit, or that tries steps did not suffice.
    """
    need, queue = {goal: 0}, deque([goal])
    while queue:
        x = queue.popleft()
        if need[x] < most:
            for b in "ACGT":
                y = b + x[:-1]
                if y not in need and (depth.get(y, 0) >= least or y == start):
                    need[y] = need[x] + 1
                    queue.append(y)
    out, path, on, tried = [], [], {start}, 0
    following = lambda x: iter([b for b in "ACGT" if (y := x[1:] + b) not in on and len(path) + 1 + need.get(y, most + 1) <= most])
    stack = [(start, following(start))]
    while stack:
        x, rest = stack[-1]
        b = next(rest, None)
        if b is None:
            stack.pop()
            on.discard(x)
            if path:
                path.pop()
            continue
        tried += 1
        if tried > tries:
            return out, True
        y = x[1:] + b
        if y == goal:
            if len(out) == limit:
                return out, True
            out.append("".join(path) + b)
            continue
        path.append(b)
        on.add(y)
        stack.append((y, following(y)))
    return out, False


def only_path(depth: dict[str, int], left: str, right: str, k: int, most: int, least: int) -> str | None:
    """What stands between two sequences if one way alone leads from one to the other, else null; at negative length they overlap, which collapsing has seen."""
    if len(left) < k or len(right) < k:
        return None
    found, more = closing_paths(depth, left[-k:], right[:k], most + k, least, limit=1)
    return found[0][:-k] if len(found) == 1 and not more and len(found[0]) >= k else None


def bridged(contigs: dict[int, str], links: dict[tuple[int, int], int], depth: dict[str, int], k: int, most: int, least_depth: int, least_pairs: int) -> list[tuple[list[int], str]]:
    """Components (members, sequence), the longest first: pairs link oriented ends, and the best-supported link that one way alone bridges is taken, until none is left.

    links: for (2 * id of the left contig, one more for its other strand; the right one alike) the pairs that say so.
    """
    parts = {i: [(i, False)] for i in contigs}
    seqs = dict(contigs)
    turned = lambda i: [(m, not t) for m, t in reversed(parts[i])]
    while True:
        ends = {}
        for i in parts:
            for strand, order in ((0, parts[i]), (1, turned(i))):
                ends[2 * order[-1][0] + order[-1][1], "right"] = (i, strand)
                ends[2 * order[0][0] + order[0][1], "left"] = (i, strand)
        for (a, b), n in sorted(links.items(), key=lambda t: (-t[1], t[0])):
            one, two = ends.get((a, "right")), ends.get((b, "left"))
            if n < least_pairs or one is None or two is None or one[0] == two[0]:
                continue
            left, right = (flipped(seqs[i]) if s else seqs[i] for i, s in (one, two))
            between = only_path(depth, left, right, k, most, least_depth)
            if between is None:
                continue
            order = (turned(one[0]) if one[1] else parts[one[0]]) + (turned(two[0]) if two[1] else parts[two[0]])
            for i in (one[0], two[0]):
                del parts[i], seqs[i]
            parts[order[0][0]], seqs[order[0][0]] = order, left + between + right
            break
        else:
            return sorted((([m for m, _ in parts[i]], seqs[i]) for i in parts), key=lambda t: (-len(t[1]), t[1]))


def unrolled(seq: str, shortest: int, second_lap: float = 0.9, identity: float = 0.995) -> int | None:
    """The least period of a sequence that goes round its circle nearly twice or more."""
    for p in range(shortest, int(len(seq) / (1 + second_lap)) + 1):
        rest = len(seq) - p
        wrong = int(rest * (1 - identity)) + 1
        for a, b in zip(seq[p:], seq, strict=False):
            wrong -= a != b
            if not wrong:
                break
        else:
            return p
    return None


def overlaps(seq: str, least: int, identity: float) -> list[int]:
    """All lengths, from least to half of the sequence, at which its end repeats its begin."""
    out = []
    for n in range(least, len(seq) // 2 + 1):
        wrong = int(n * (1 - identity)) + 1
        for a, b in zip(seq[-n:], seq, strict=False):
            wrong -= a != b
            if not wrong:
                break
        else:
            out.append(n)
    return out


def candidates(seq: str, depth: dict[str, int], k: int, most: int, least_depth: int, least_overlap: int, identity: float, shortest: int, limit: int = 16) -> tuple[list[tuple[str, str, list[int], int]], bool]:
    """The circles that a component may close to: (method, circle, joints, least depth over them), each circle once, and whether there may be more.

    joints are the places in the circle before which bases meet that do not follow each other in the component. The depth is
    the least over the k-mers that cross a joint or lie in a bridge.
    """
    found: list[tuple[str, str, list[int]]] = []
    period = unrolled(seq, shortest)
    if period:
        found.append(("unrolled_cycle", seq[:period], [0]))
    else:
        found += [("overlap", seq[: len(seq) - n], [0]) for n in overlaps(seq, least_overlap, identity)]
    more = False
    if len(seq) >= 2 * k:
        paths, more = closing_paths(depth, seq[-k:], seq[:k], most + k, least_depth, limit)
        for p in paths:
            circle = seq + p[:-k] if len(p) >= k else seq[: len(seq) - k + len(p)]
            found.append(("bridge" if len(p) > k else "overlap", circle, [0, len(seq)] if len(p) > k else [0]))
    out, seen = [], set()
    for method, circle, joints in found:
        name = canonical_circle(circle)
        if len(circle) >= k and name not in seen:
            seen.add(name)
            around = circle[-k + 1 :] + circle + circle[: k - 1]
            spots = {i for j in joints for i in range(j - k + 1, j)} | (set(range(joints[-1] - k + 1, len(circle))) if len(joints) > 1 else set())
            crossing = [around[(i + k - 1) % len(circle) :][:k] for i in spots]
            out.append((method, circle, joints, min((depth.get(x, 0) for x in crossing), default=0)))
    return out[:limit], more or len(out) > limit


def mate_links(contigs: DataFrame, pairs: DataFrame, k: int, window: int, least: int) -> DataFrame:
    """J16 within each sample: rows (sample, a, b, pairs) between oriented ends, 2 * id and one more for the other strand.

    contigs (sample, id, seq), pairs (sample, fragment, seq1, seq2). The left mate must have one best target among the ends
    of the sample's oriented contigs, the right mate, turned, among the begins; either mate may be the left one.
    """
    oriented = contigs.selectExpr("sample", "2 * id AS target", "seq").unionByName(contigs.selectExpr("sample", "2 * id + 1 AS target", f"{S.reverse_complement('seq')} AS seq"))
    both = pairs.selectExpr("sample", "2 * fragment AS read", "seq1", "seq2").unionByName(pairs.selectExpr("sample", "2 * fragment + 1 AS read", "seq2 AS seq1", "seq1 AS seq2"))

    def target(mates: DataFrame, ends: DataFrame, name: str) -> DataFrame:
        hits = S.kmers(mates, k).select("sample", "read", "kmer").distinct().join(S.kmers(ends, k).select("sample", "target", "kmer").distinct(), ["sample", "kmer"]).groupBy("sample", "read", "target").agg(F.count("*").alias("n"))
        best = hits.groupBy("sample", "read").agg(F.max(F.struct("n", F.col("target").alias("t"))).alias("top"), F.max("n").alias("most"))
        tied = hits.join(best, ["sample", "read"]).where("n = most").groupBy("sample", "read").agg(F.count("*").alias("c"), F.first("most").alias("most"), F.min("target").alias(name))
        return tied.where(F.expr(f"c = 1 AND most >= {least}")).select("sample", "read", name)

    left = target(both.selectExpr("sample", "read", "seq1 AS seq"), oriented.selectExpr("sample", "target", f"right(seq, {window}) AS seq"), "a")
    right = target(both.selectExpr("sample", "read", f"{S.reverse_complement('seq2')} AS seq"), oriented.selectExpr("sample", "target", f"left(seq, {window}) AS seq"), "b")
    return left.join(right, ["sample", "read"]).groupBy("sample", "a", "b").agg(F.count("*").alias("pairs"))


def depths(reads: DataFrame, k: int, least: int) -> DataFrame:
    """A2: rows (sample, kmer, depth): in how many reads (sample, read, seq) each k-mer is, on both strands, at least so many."""
    own = S.kmers(reads, k).select("sample", "read", F.explode(F.expr(f"array(kmer, {S.reverse_complement('kmer')})")).alias("kmer")).distinct()
    return own.groupBy("sample", "kmer").agg(F.count("*").alias("depth")).where(F.col("depth") >= least)


FOUND = "members array<long>, components int, choice int, k int, method string, circle string, joints array<int>, joint_depth int, usual_depth double, more boolean"


def closings(contigs: DataFrame, links: DataFrame, kmers: DataFrame, k: int, most: int, least_depth: int, least_overlap: int, identity: float, shortest: int, least_pairs: int) -> DataFrame:
    """Rows FOUND of every sample: its longest component after collapsing and bridging, once for each circle it may close to (choice from 0), or once with a null circle.

    A sample's contigs, links and solid k-mers meet in one task: one circle's assembly, which its coverage bounds.
    """
    linked = links.groupBy("sample").agg(F.collect_list(F.struct("a", "b", "pairs")).alias("links"))
    own = contigs.groupBy("sample").agg(F.collect_list(F.struct("id", "seq")).alias("contigs")).join(linked, "sample", "left")

    def kernel(key, one: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, sample in one.iterrows():
            depth = dict(zip(graph["kmer"], graph["depth"], strict=True))
            seqs = {r["id"]: r["seq"] for r in sample["contigs"] if r["seq"]}
            merged = collapsed(list(seqs.values()), least_overlap, identity)
            if len(merged) < len(seqs):  # names of merged contigs are lost, and with them their links
                seqs, named = dict(enumerate(merged)), {}
            else:
                named = {(r["a"], r["b"]): r["pairs"] for r in (sample["links"] if sample["links"] is not None else [])}
            parts = bridged(seqs, named, depth, k, most, least_depth, least_pairs)
            if not parts:
                continue
            members, seq = parts[0]
            seen = sorted(depth.get(seq[i : i + k], 0) for i in range(len(seq) - k + 1)) or [0]
            usual = (seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 2
            ways, more = candidates(seq, depth, k, most, least_depth, least_overlap, identity, shortest) if len(parts) == 1 else ([], False)
            for n, (method, circle, joints, low) in enumerate(ways):
                rows.append((key[0], members, len(parts), n, k, method, circle, joints, low, usual, more))
            if not ways:
                rows.append((key[0], members, len(parts), 0, k, None, None, None, None, usual, more))
        return pd.DataFrame(rows, columns=["sample", *[c.split()[0] for c in FOUND.split(", ")]], dtype=object)

    kind = contigs.schema["sample"].dataType.simpleString()
    return own.groupBy("sample").cogroup(kmers.select(*[F.col(c).alias(c) for c in kmers.columns]).groupBy("sample")).applyInPandas(kernel, f"sample {kind}, {FOUND}")


def joint_support(ways: DataFrame, reads: DataFrame, k: int, band: int = 3) -> DataFrame:
    """A34 at every joint: rows (sample, choice, support): the least number of the sample's reads over the windows of k bases that straddle a joint; one mismatch is allowed.

    A window that also occurs in the circle away from its joint is no evidence; a joint without other windows has support 0.
    """
    middle = k // 2
    low, high = max(1, middle - band), min(k - 1, middle + band)
    joint = ways.where(f"circle IS NOT NULL AND length(circle) >= {k}").select("sample", "choice", F.explode("joints").alias("joint"), "circle")
    turned = joint.selectExpr("struct(sample, choice, joint) AS locus", "concat(substring(circle, joint + 1), left(circle, joint)) AS seq")  # the joint lies before the first base
    cut = turned.select("locus", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("t"), "seq").selectExpr("locus", "t", f"concat(right(seq, t), left(seq, {k} - t)) AS window")
    inside = near_windows(turned, cut.selectExpr("locus AS of", "t", "window"), "locus", k).where("locus = of").select("locus", "t")
    own = cut.join(inside, ["locus", "t"], "left_anti")
    either = own.selectExpr("locus", "t", "window").unionByName(own.selectExpr("locus", "t", f"{S.reverse_complement('window')} AS window"))
    named = reads.selectExpr("struct(sample, read) AS read_id", "seq")
    spanning = near_windows(named, either, "read_id", k).where("read_id.sample = locus.sample").groupBy("locus", "t").agg(F.count_distinct("read_id").alias("n"))
    counted = own.join(spanning, ["locus", "t"], "left").groupBy("locus").agg(F.min(F.coalesce("n", F.lit(0))).alias("support"))
    return turned.select("locus").join(counted, "locus", "left").groupBy("locus.sample", "locus.choice").agg(F.min(F.coalesce("support", F.lit(0))).alias("support"))


def closed_circles(contigs: DataFrame, pairs: DataFrame, k: int = 21, link_k: int = 15, window: int = 60, least_hits: int = 3, least_pairs: int = 2, least_depth: int = 2, most: int = 300, least_overlap: int = 21, identity: float = 0.98, shortest: int = 100, least_support: int = 2, depth_ratio: float = 0.25) -> DataFrame:
    """One row for each sample: status, reason, method, circle, members, components, candidates, standing, support, k.

    A way to close stands if enough reads span each of its joints and the depth there is not below depth_ratio of what the
    component usually has. One standing circle is circular (verified_circular). Two or more that differ as circles, or a
    search that found too many ways, are ambiguous, and the contig stays linear. Where nothing stands the reason says why:
    partial_multi_component, closure_candidate_unverified (an overlap no read spans), no_junction_evidence (a bridge none
    spans), junction_support_below_threshold, depth_mismatch, insufficient_coverage (no link of enough pairs), no_unique_path.
    Samples without any way are tried again with k - 10, then k + 10, alone.

    contigs (sample, id, seq), pairs (sample, fragment, seq1, seq2); empty and null sequences are left out, a sample without
    contigs gives no row.
    """
    contigs = contigs.where("seq <> ''")
    reads = pairs.selectExpr("sample", "2 * fragment AS read", "seq1 AS seq").unionByName(pairs.selectExpr("sample", "2 * fragment + 1 AS read", "seq2 AS seq"))
    links = written(mate_links(contigs, pairs, link_k, window, least_hits))
    found, rest = None, contigs
    for size in dict.fromkeys(x for x in (k, k - 10, k + 10) if x >= 11):
        some = rest.select("sample").distinct()
        made = written(closings(rest, links.join(some, "sample", "left_semi"), depths(reads.join(some, "sample", "left_semi"), size, least_depth), size, most, least_depth, least_overlap, identity, shortest, least_pairs))
        done = made.where("circle IS NOT NULL").select("sample").distinct()
        now = made.join(done, "sample", "left_semi")
        left = made.join(done, "sample", "left_anti")
        found, last = now if found is None else found.unionByName(now), left
        rest = written(rest.join(left.select("sample").distinct(), "sample", "left_semi"))
    ways = written(found.unionByName(last))
    support = joint_support(ways, reads, link_k)
    judged = ways.join(support, ["sample", "choice"], "left").withColumn("deep", F.expr(f"joint_depth >= {least_depth} AND joint_depth >= {depth_ratio} * usual_depth")).withColumn("stands", F.expr(f"circle IS NOT NULL AND coalesce(support, 0) >= {least_support} AND deep"))
    best = F.max(F.when(F.col("circle").isNotNull(), F.struct("stands", F.coalesce("support", F.lit(0)).alias("s"), (-F.col("choice")).alias("c"), "method", "circle", F.coalesce("support", F.lit(0)).alias("support"), "deep")))
    each = judged.groupBy("sample").agg(
        F.first("members").alias("members"), F.first("components").alias("components"), F.first("k").alias("k"), F.count("circle").alias("candidates"), F.sum(F.col("stands").cast("int")).alias("standing"), F.bool_or("more").alias("more"), best.alias("best")
    )
    pairs_most = links.groupBy("sample").agg(F.max("pairs").alias("pairs"))
    reason = f"""CASE WHEN components > 1 THEN 'partial_multi_component'
        WHEN standing > 1 OR more AND standing > 0 THEN 'ambiguous'
        WHEN standing = 1 THEN 'verified_circular'
        WHEN candidates > 0 AND best.support >= {least_support} THEN 'depth_mismatch'
        WHEN candidates > 0 AND best.support > 0 THEN 'junction_support_below_threshold'
        WHEN candidates > 0 AND best.method = 'bridge' THEN 'no_junction_evidence'
        WHEN candidates > 0 THEN 'closure_candidate_unverified'
        WHEN coalesce(pairs, 0) < {least_pairs} THEN 'insufficient_coverage' ELSE 'no_unique_path' END"""
    status = "CASE reason " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATES.items()) + " ELSE 'linear_single_contig' END"
    out = each.join(pairs_most, "sample", "left").withColumn("reason", F.expr(reason))
    return out.selectExpr("sample", f"{status} AS status", "reason", "CASE WHEN reason = 'verified_circular' THEN best.method END AS method", "CASE WHEN reason = 'verified_circular' THEN best.circle END AS circle", "members", "components", "k", "candidates", "coalesce(standing, 0) AS standing", "coalesce(best.support, 0) AS support")
