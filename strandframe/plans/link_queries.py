"""Queries of pair hashes, diagonals, end links, and assembly kernels by locus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import alignment as A
from ..operators import assembly as Y
from ..operators import links as L
from ..operators import recruitment as R
from ..operators import tables as T
from . import bridges as B
from .recruitment_queries import RC, _kmers


def bounded_stacks(spark, sf):
    m = B.mates(spark, sf)
    pairs = m.where("mate = 1").selectExpr("fragment AS id", "seq AS seq1").join(m.where("mate = 2").selectExpr("fragment AS id", "seq AS seq2"), "id").withColumn("stack", F.expr("id % 3"))
    return L.bounded_stacks(pairs, "stack", 16).select("stack", "id", "hash")


def fragments(spark, sf):
    """Tiles of 60 bases every 30 round each locus as a circle; every second one is turned."""
    tiles = B.loci(spark, sf).where("seq <> ''").select("locus", F.posexplode(F.expr("sequence(0, length(seq) - 1, 30)")).alias("tile", "start"), "seq").selectExpr("locus", "locus * 1000 + tile AS fragment", "tile", f"{S.circular_slice('seq', 'start', 'least(60, length(seq))')} AS bait")
    return tiles.selectExpr("locus", "fragment", f"CASE WHEN tile % 2 = 1 THEN {S.reverse_complement('bait')} ELSE bait END AS seq")


FRAGMENTS = f"(SELECT locus, fragment, CASE WHEN tile % 2 = 1 THEN {RC.format('bait')} ELSE bait END AS seq FROM (SELECT locus, locus * 1000 + start // 30 AS fragment, start // 30 AS tile, substr(seq || seq || seq, CAST(start + 1 AS BIGINT), least(60, length(seq))) AS bait FROM (SELECT *, unnest(range(0, length(seq), 30)) AS start FROM {B.LOCI} WHERE seq <> '')))"


def library_hits(spark, sf):
    """Tiles against all loci, whose class is their number modulo 5."""
    loci = B.loci(spark, sf)
    return L.library_hits(L.diagonals(fragments(spark, sf), loci, 11, 16), loci.selectExpr("locus", "locus % 5 AS class"))


def anchored_fragments(spark, sf):
    """Tiles against all loci, on both strands."""
    loci, own = B.loci(spark, sf), fragments(spark, sf)
    turned = own.withColumn("seq", F.expr(S.reverse_complement("seq")))
    both = L.diagonals(own, loci, 15, 32, ["fragment", "locus"]).withColumn("strand", F.lit(1)).unionByName(L.diagonals(turned, loci, 15, 32, ["fragment", "locus"]).withColumn("strand", F.lit(2)))
    return L.anchored(both, 15)


def end_links(spark, sf):
    """Pairs from the end of each locus and the begin of the next."""
    loci = B.loci(spark, sf).where("length(seq) >= 60")
    pairs = loci.select(F.col("locus").alias("fragment"), F.expr("right(seq, 50)").alias("seq1")).join(loci.selectExpr("locus - 1 AS fragment", f"{S.reverse_complement('left(seq, 50)')} AS seq2"), "fragment")
    return L.end_links(loci.withColumnRenamed("locus", "id"), pairs, 12, 60, 5)


def unitig_pairs(spark, sf):
    """Loci as unitigs, by their own windows of 12 bases on either strand."""
    single = R.reference_index(B.loci(spark, sf), 12).groupBy("kmer").agg(F.countDistinct("locus").alias("n"), F.min("locus").alias("unitig")).where("n = 1").select("kmer", "unitig")
    found = R.matching_kmers(B.mates(spark, sf), single, B.loci(spark, sf), 12, ("fragment", "mate")).join(R.sized(single, B.loci(spark, sf)), "kmer").select("fragment", "mate", "unitig")
    return L.pair_support(found)


def seed_index(spark, sf):
    """Seeds of 23 bases of halves of loci, unique or ambiguous."""
    halves = B.loci(spark, sf).selectExpr("explode(array(struct(locus * 2 AS u, left(seq, length(seq) div 2 + 30) AS s), struct(locus * 2 + 1 AS u, substring(seq, length(seq) div 2 - 30) AS s))) AS x").selectExpr("x.u AS unitig", "x.s AS seq")
    own = S.kmers(halves, 23).select("unitig", "kmer").distinct()
    return own.join(own.groupBy("kmer").agg(F.count("*").alias("n")), "kmer").groupBy("unitig").agg(F.count("*").alias("seeds"), F.count_if(F.expr("n = 1")).alias("unique"), F.count_if(F.expr("n > 1")).alias("ambiguous"))


def family_calls(spark, sf):
    """Candidates of each family against a third of its longest reference, 40 at least."""
    p = B.table(spark, sf, "part").selectExpr("p_partkey AS id", "p_partkey % 30 AS family", "p_partkey % 3 = 0 AS is_reference", "length(p_name) * (p_partkey % 7 + 1) AS n")
    longest = p.where("is_reference").groupBy("family").agg(F.max("n").alias("longest"))
    return p.where("NOT is_reference").join(longest, "family", "left").selectExpr("id", "family", "n", "longest", "CASE WHEN longest IS NULL THEN 'no_reference' WHEN n >= greatest(longest / 3, 40) THEN 'candidate' ELSE 'short' END AS call")


def auto_k(spark, sf):
    """For each locus the odd k from 21 to 51 that the upper median of its match lengths still reaches."""
    counts = R.match_spans(B.reads(spark, sf), B.loci(spark, sf), 21).groupBy("locus", F.col("length").alias("v")).agg(F.count("*").alias("c"))
    middle = T.order_statistics(counts, ["locus"], "v", {"middle": "_n div 2"})
    return middle.selectExpr("locus", "_n AS runs", "cast(greatest(21, least(51, middle)) - (1 - greatest(21, least(51, middle)) % 2) AS int) AS k")


def shadow_report(spark, sf):
    """Tiles aligned to each locus along their best diagonal, summed up by locus."""
    loci, own = B.loci(spark, sf), fragments(spark, sf)
    best = L.diagonals(own, loci, 11, 1, ["fragment", "locus"])
    pairs = best.join(own.select("fragment", F.col("seq").alias("a_seq")), "fragment").join(loci.withColumnRenamed("seq", "b_seq"), "locus").select("fragment", "locus", "a_seq", "b_seq", (-F.col("offset")).alias("diagonal"))
    scored = A.scored_on_diagonals(pairs.repartition(spark.sparkContext.defaultParallelism))
    return scored.groupBy("locus").agg(F.count("*").alias("mates"), F.count_if(F.expr("score >= 80")).alias("aligned"), F.max("score").alias("best"), F.round(F.avg("score"), 6).alias("mean"))


def circles(spark, sf):
    """Loci that run on into their own begin, closed, and turned from the other strand to begin with their first 60 bases."""

    def kernel(p):
        seq = p["seq"].iloc[0]
        found = Y.closed(seq + seq[:45])
        turned = Y.standardised(Y.flipped(seq[50:] + seq[:50]), seq[:60])
        return [(found, turned)]

    return Y.per_group(B.loci(spark, sf).where("length(seq) >= 100"), ["locus"], "closed string, standard string", kernel)


def local_alignments(spark, sf):
    """Each tile against its own locus, with the spans of the best local alignment."""
    pairs = fragments(spark, sf).withColumnRenamed("seq", "a").join(B.loci(spark, sf).withColumnRenamed("seq", "b"), "locus").repartition(spark.sparkContext.defaultParallelism, "fragment")
    return Y.per_group(pairs, ["fragment"], "score int, a_start int, a_end int, b_start int, b_end int, same int", lambda p: [A.local_alignment(p["a"].iloc[0], p["b"].iloc[0])])


BYTES = "list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS HUGEINT))"
MATE = f"(SELECT fragment AS id, seq FROM {B.MATES} WHERE mate = {{0}})"
DIAGONALS = """h{t} AS (SELECT fragment, locus, l.pos - f.pos AS off, count(*) AS seeds FROM {f} f JOIN {l} l USING (kmer) GROUP BY ALL),
  t{t} AS (SELECT * FROM h{t} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY seeds DESC, locus, off) <= {top}),
  o{t} AS (SELECT t.*, a.seq AS a, b.seq AS b, least(length(a.seq) - greatest(0, -off), length(b.seq) - greatest(0, off)) AS n FROM t{t} t JOIN {frag} a USING (fragment) JOIN {loci} b ON b.locus = t.locus),
  d{t} AS (SELECT fragment, locus, off, seeds, n, length(a) AS la, len(list_filter(range(1, n + 1), lambda i: substr(a, i + greatest(0, -off), 1) = substr(b, i + greatest(0, off), 1))) / n AS identity, n / length(a) AS coverage FROM o{t})"""
TURNED = f"(SELECT locus, fragment, {RC.format('seq')} AS seq FROM {FRAGMENTS})"


def _diagonals(tag: str, frag: str, k: int, top: int, by: str) -> str:
    return DIAGONALS.format(t=tag, f=_kmers(frag, "fragment", k), l=_kmers(B.LOCI, "locus", k), by=by, top=top, frag=frag, loci=B.LOCI)


ANCHORED = "SELECT *, {0} AS strand FROM d{0} WHERE n >= 15 AND identity >= 0.8 QUALIFY row_number() OVER (PARTITION BY fragment, locus ORDER BY seeds DESC, identity DESC, n DESC, off) = 1"
ENDS = f"(SELECT 2 * locus AS target, seq FROM {B.LOCI} WHERE length(seq) >= 60 UNION ALL SELECT 2 * locus + 1, {RC.format('seq')} FROM {B.LOCI} WHERE length(seq) >= 60)"
BEST = "SELECT fragment, min(target) AS x FROM (SELECT *, max(n) OVER (PARTITION BY fragment) AS most FROM (SELECT fragment, target, count(*) AS n FROM (SELECT DISTINCT fragment, kmer FROM {0}) JOIN {1} USING (kmer) GROUP BY ALL)) WHERE n = most AND most >= 5 GROUP BY fragment HAVING count(*) = 1"

QUERIES = {
    "bounded_stacks": (
        bounded_stacks,
        f"""WITH p AS (SELECT id, id % 3 AS stack, a.seq AS s, b.seq AS t FROM {MATE.format(1)} a JOIN {MATE.format(2)} b USING (id)),
        h AS (SELECT stack, id, list_reduce(list_concat([14695981039346656037::HUGEINT], CASE WHEN s = '' THEN [] ELSE {BYTES.format('s')} END, [255::HUGEINT], CASE WHEN t = '' THEN [] ELSE {BYTES.format('t')} END), lambda x, b: xor(x, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT) AS h FROM p)
        SELECT stack, id, printf('%08x', CAST(h // 4294967296 AS BIGINT)) || printf('%08x', CAST(h % 4294967296 AS BIGINT)) AS hash FROM h QUALIFY row_number() OVER (PARTITION BY stack ORDER BY h, id) <= 16""",
    ),
    "library_hits": (
        library_hits,
        f"""WITH {_diagonals('1', FRAGMENTS, 11, 16, 'fragment')}, s AS (SELECT *, locus % 5 AS class, identity * coverage AS score FROM d1), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY fragment ORDER BY score DESC, locus, off) = 1)
        SELECT b.fragment, b.locus, b.class, round(b.identity, 6) AS identity, round(b.coverage, 6) AS coverage, round(b.score, 6) AS score, round(coalesce((SELECT max(s.score) FROM s WHERE s.fragment = b.fragment AND s.class <> b.class), 0), 6) AS "second" FROM b""",
    ),
    "anchored_fragments": (
        anchored_fragments,
        f"WITH {_diagonals('1', FRAGMENTS, 15, 32, 'fragment, locus')}, {_diagonals('2', TURNED, 15, 32, 'fragment, locus')}, u AS (({ANCHORED.format(1)}) UNION ALL ({ANCHORED.format(2)})) SELECT fragment, locus, strand, n AS aligned, round(identity, 6) AS identity FROM u QUALIFY row_number() OVER (PARTITION BY fragment, locus ORDER BY identity DESC, strand) = 1",
    ),
    "end_links": (
        end_links,
        f"""WITH c AS (SELECT * FROM {B.LOCI} WHERE length(seq) >= 60), p AS (SELECT x.locus AS fragment, right(x.seq, 50) AS s, {RC.format('left(y.seq, 50)')} AS t FROM c x JOIN c y ON y.locus = x.locus + 1),
        a AS ({BEST.format(_kmers('(SELECT fragment, s AS seq FROM p)', 'fragment', 12), _kmers(f'(SELECT target, right(seq, 60) AS seq FROM {ENDS})', 'target', 12))}), b AS ({BEST.format(_kmers(f"(SELECT fragment, {RC.format('t')} AS seq FROM p)", 'fragment', 12), _kmers(f'(SELECT target, left(seq, 60) AS seq FROM {ENDS})', 'target', 12))})
        SELECT a.x AS a, b.x AS b, count(*) AS fragments FROM a JOIN b USING (fragment) GROUP BY ALL""",
    ),
    "unitig_pairs": (
        unitig_pairs,
        f"""WITH i AS (SELECT kmer, min(locus) AS u FROM (SELECT locus, kmer FROM {_kmers(B.LOCI, 'locus', 12)} UNION SELECT locus, {RC.format('kmer')} FROM {_kmers(B.LOCI, 'locus', 12)}) GROUP BY kmer HAVING count(DISTINCT locus) = 1),
        o AS (SELECT fragment, mate, min(u) AS u FROM {_kmers(B.MATES, 'fragment, mate', 12)} JOIN i USING (kmer) GROUP BY ALL HAVING count(DISTINCT u) = 1), p AS (SELECT x.u AS a, y.u AS b FROM o x JOIN o y USING (fragment) WHERE x.mate = 1 AND y.mate = 2 AND x.u <> y.u)
        SELECT unitig, count(*) AS fragments FROM (SELECT a AS unitig FROM p UNION ALL SELECT b FROM p) GROUP BY unitig""",
    ),
    "seed_index": (
        seed_index,
        f"""WITH h AS (SELECT locus * 2 AS unitig, left(seq, length(seq) // 2 + 30) AS seq FROM {B.LOCI} UNION ALL SELECT locus * 2 + 1, substr(seq, greatest(1, length(seq) // 2 - 30)) FROM {B.LOCI}), k AS (SELECT DISTINCT unitig, kmer FROM {_kmers('h', 'unitig', 23)}), n AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS n FROM k)
        SELECT unitig, count(*) AS seeds, count(*) FILTER (WHERE n = 1) AS "unique", count(*) FILTER (WHERE n > 1) AS ambiguous FROM n GROUP BY unitig""",
    ),
    "family_calls": (family_calls, "WITH p AS (SELECT p_partkey AS id, p_partkey % 30 AS family, p_partkey % 3 = 0 AS r, length(p_name) * (p_partkey % 7 + 1) AS n FROM part), l AS (SELECT family, max(n) AS longest FROM p WHERE r GROUP BY family) SELECT id, family, n, longest, CASE WHEN longest IS NULL THEN 'no_reference' WHEN n >= greatest(longest / 3, 40) THEN 'candidate' ELSE 'short' END AS call FROM p LEFT JOIN l USING (family) WHERE NOT r"),
    "auto_k": (
        auto_k,
        f"""WITH s AS (SELECT read_id, locus, strand, a.pos - b.pos AS diagonal, a.pos FROM {_kmers(B.READS, 'read_id', 21)} a JOIN {_kmers(f"(SELECT locus, 1 AS strand, seq FROM {B.LOCI} UNION ALL SELECT locus, 2, {RC.format('seq')} FROM {B.LOCI})", 'locus, strand', 21)} b USING (kmer)),
        i AS (SELECT *, pos - row_number() OVER (PARTITION BY read_id, locus, strand, diagonal ORDER BY pos) AS island FROM s), m AS (SELECT locus, count(*) + 20 AS length FROM i GROUP BY read_id, locus, strand, diagonal, island),
        k AS (SELECT locus, count(*) AS runs, greatest(21, least(51, list_sort(list(length))[count(*) // 2 + 1])) AS k FROM m GROUP BY locus) SELECT locus, runs, CAST(k - (1 - k % 2) AS INTEGER) AS k FROM k""",
    ),
    "shadow_report": (shadow_report, None),
    "circles": (circles, None),
    "local_alignments": (local_alignments, None),
}
