"""Queries of evidence: reference positions, slices, terminals, seams, seeds, unitigs and genotype structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import evidence as V
from ..operators import recruitment as R
from . import bridges as B
from .recruitment_queries import RC, _kmers

K, SLICE = 15, 24


def reference_positions(spark, sf):
    return V.reference_positions(B.loci(spark, sf), K)


def slice_support(spark, sf):
    """Loci as contigs, every fifth window of a document as a slice of a read."""
    there = S.kmers(B.loci(spark, sf), SLICE).select("kmer").distinct()
    slices = R.matching_kmers(B.reads(spark, sf), there, B.loci(spark, sf), SLICE, ("read_id",)).where("pos % 5 = 0").groupBy("kmer").agg(F.count("*").alias("n"))
    return V.slice_support(B.loci(spark, sf), slices, SLICE)


def terminal_evidence(spark, sf):
    """What each read's longest match says of the locus's ends."""
    best = R.longest_match(R.match_spans(B.reads(spark, sf), B.loci(spark, sf), 21))
    rows = best.join(B.reads(spark, sf).selectExpr("read_id", "length(seq) AS read_length"), "read_id").join(B.loci(spark, sf).selectExpr("locus", "length(seq) AS ref_length"), "locus")
    rows = rows.selectExpr("read_id", "locus", "strand", "read_start", "read_start + length AS read_end", "read_length", "ref_start", "ref_start + length AS ref_end", "ref_length")
    return V.terminal_evidence(rows, 25).select("read_id", "locus", "effective_window", "original_start", "original_end", "left_overhang", "right_overhang", "near_left", "near_right", "extends_left", "extends_right")


def side_products(spark, sf):
    rows = B.table(spark, sf, "lineitem").groupBy(F.expr("l_partkey % 40").alias("locus"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'left' ELSE 'right' END").alias("side"), F.col("l_suppkey").alias("id")).agg(F.count("*").alias("reads"))
    return V.side_products(rows)


def junction_support(spark, sf):
    """Loci as circles, their tiles as reads."""
    circles = B.loci(spark, sf).where("length(seq) >= 60")
    reads = circles.select((F.col("locus") * 1000).alias("base"), "seq", F.posexplode(F.expr("sequence(0, length(seq) - 1, 9)")).alias("i", "start")).selectExpr("base + i AS read_id", f"{S.circular_slice('seq', 'start', '40')} AS seq")
    return V.junction_support(circles, reads, 20)


def reference_lengths(spark, sf):
    """The rounded mean length of each group's sequences."""
    return B.loci(spark, sf).groupBy(F.expr("locus % 7").alias("locus")).agg(F.round(F.avg(F.length("seq"))).cast("long").alias("mean_length"), F.count("*").alias("sequences"))


def largest_components(spark, sf):
    """The largest groups first, ties by the least member, 256 at most as a report."""
    sizes = B.table(spark, sf, "lineitem").groupBy(F.expr("l_partkey % 700 + l_suppkey % 3").alias("root")).agg(F.count("*").alias("size"), F.min("l_orderkey").alias("first"))
    return sizes.orderBy(F.desc("size"), "first", "root").limit(256)


def species_order(spark, sf):
    """F36."""
    p = B.table(spark, sf, "part").selectExpr("CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE concat(p_partkey % 30, '_', p_name) END AS name").distinct()
    return p.withColumn("k", V.numeric_order("name")).select("name", F.col("k.number").alias("number"), F.col("k.rest").alias("rest"))


def solid_minimizers(spark, sf):
    return V.solid_minimizers(B.mates(spark, sf), ("fragment", "mate"), 11, 3)


def bait_orientation(spark, sf):
    return V.bait_orientation(B.reads(spark, sf), B.loci(spark, sf))


def gene_anchors(spark, sf):
    """names and segments drawn from the loci's numbers."""
    g = B.loci(spark, sf).withColumn("name", F.expr("get(array('tRNA-Phe', 'COX1', 'nad1-b', 'rrnS', 'cytb', 'MT-CO1', 'trnF(gaa)', '12S'), cast(locus % 8 AS int))"))
    g = g.withColumn("segments", F.expr("array(struct(locus % 7 AS start, locus % 7 + 20 AS end), struct(30 AS start, 50 AS end), struct(40 AS start, 9999 AS end))"))
    return g.select("locus", "name", V.anchor_rank("name").alias("rank"), V.gene_sequence("seq", "segments", "locus % 2 = 1").alias("anchor"))


def terminal_recruits(spark, sf):
    """Reads recruited by the ends of loci, kept where they match the whole locus of that name exactly over 25 bases."""
    ends = B.loci(spark, sf).selectExpr("locus", "explode(array(left(seq, 40), right(seq, 40))) AS seq")
    recruited = R.hits(B.reads(spark, sf), ends, K)
    verified = R.match_spans(B.reads(spark, sf), B.loci(spark, sf), 25).groupBy("read_id", "locus").agg(F.max("length").alias("longest"))
    return recruited.join(verified, ["read_id", "locus"]).select("read_id", "locus", "shared", "longest")


def right_to_left(spark, sf):
    return V.windows_from_the_right(B.loci(spark, sf), 21)


def contig_headers(spark, sf):
    """Header lines of the loci's support."""
    s = slice_support(spark, sf)
    return s.select("locus", V.contig_header("'contig'", ("contig_length", "unique_reads", "multi_reads", "reads", "extent"), "supported", "flank_balance").alias("header"))


def _unitig_hits(spark, sf):
    halves = S.kmers(B.loci(spark, sf).selectExpr("locus", "seq", "length(seq) AS length"), 21).selectExpr("kmer", "locus * 2 + CASE WHEN pos * 2 >= length THEN 1 ELSE 0 END AS unitig")
    own = halves.groupBy("kmer").agg(F.count("*").alias("n"), F.min("unitig").alias("unitig")).where("n = 1").select("kmer", "unitig")
    return R.matching_kmers(B.reads(spark, sf), own, B.loci(spark, sf), 21, ("sample", "read_id")).join(R.sized(own, B.loci(spark, sf)), "kmer").select("sample", "read_id", "unitig", "pos")


def unitig_evidence(spark, sf):
    """Halves of loci as unitigs."""
    return V.unitig_paths(_unitig_hits(spark, sf))[0]


def unitig_edges(spark, sf):
    """Which halves of loci follow one another in a read."""
    return V.unitig_paths(_unitig_hits(spark, sf))[1]


def _dosages(spark, sf):
    return V.dosages(B.view(spark, sf, "lineitem").sql(f"SELECT * FROM {B.GENOTYPES}"))


def linked_sites(spark, sf):
    """Sites within five places of one another in a group, of r2 from 0.1 on."""
    return V.linked_sites(_dosages(spark, sf).withColumn("locus", F.expr("site % 50")), "locus", 5, 0.1)


def shared_alleles(spark, sf):
    """Identity by state of every two samples of a tenth of the suppliers' numbers, taken as populations."""
    return V.shared_alleles(_populations(spark, sf))


def _populations(spark, sf):
    return _dosages(spark, sf).groupBy("site", F.expr("sample % 10").alias("sample")).agg(F.max("n").alias("n"))


def sample_components(spark, sf):
    """Principal components of these populations."""
    return V.sample_components(_populations(spark, sf))


GT = f"d AS (SELECT site, sample, CAST(length(gt) - length(replace(gt, '1', '')) AS DOUBLE) AS n FROM {B.GENOTYPES} WHERE gt NOT LIKE '%.%')"
SLICES = f"""slices AS (SELECT kmer, count(*) AS n FROM {_kmers(B.READS, 'read_id', SLICE)} WHERE pos % 5 = 0 AND kmer IN (SELECT kmer FROM {_kmers(B.LOCI, 'locus', SLICE)}) GROUP BY kmer),
  found AS (SELECT locus, kmer, any_value(s.n) AS n, count(*) AS places, min(pos) AS start FROM {_kmers(B.LOCI, 'locus', SLICE)} k JOIN slices s USING (kmer) GROUP BY locus, kmer),
  sums AS (SELECT locus, sum(n) AS reads, coalesce(sum(n) FILTER (WHERE places = 1), 0) AS unique_reads, coalesce(sum(n) FILTER (WHERE places > 1), 0) AS multi_reads FROM found GROUP BY locus),
  cover AS (SELECT DISTINCT locus, unnest(range(start, start + {SLICE})) AS i FROM found WHERE places = 1),
  gaps AS (SELECT locus, i, i - lag(i) OVER (PARTITION BY locus ORDER BY i) - 1 AS g FROM cover),
  spans AS (SELECT locus, count(*) AS supported, min(i) AS l, max(i) + 1 AS r, coalesce(max(g), 0) AS inner_gap FROM gaps GROUP BY locus),
  support AS (SELECT o.locus, CAST(length(seq) AS INTEGER) AS contig_length, CAST(reads AS BIGINT) AS reads, CAST(unique_reads AS BIGINT) AS unique_reads, CAST(multi_reads AS BIGINT) AS multi_reads, coalesce(r - l, 0) AS extent, coalesce(supported, 0) AS supported, round(coalesce(supported, 0) / length(seq), 6) AS breadth,
    coalesce(greatest(l, length(seq) - r, inner_gap), length(seq)) AS max_gap, CASE WHEN l IS NULL THEN 0.0 WHEN l = 0 AND r = length(seq) THEN 1.0 ELSE round(least(l, length(seq) - r) / greatest(l, length(seq) - r), 6) END AS flank_balance
    FROM {B.LOCI} o JOIN sums USING (locus) LEFT JOIN spans USING (locus))"""
STRANDS = f"(SELECT locus, 1 AS strand, seq FROM {B.LOCI} UNION ALL SELECT locus, 2, {RC.format('seq')} FROM {B.LOCI})"
MATCHES = """i AS (SELECT *, pos - row_number() OVER (PARTITION BY read_id, locus, strand, diagonal ORDER BY pos) AS island FROM s),
  m AS (SELECT read_id, locus, strand, diagonal, min(pos) AS start, count(*) + {0} AS length FROM i GROUP BY read_id, locus, strand, diagonal, island)"""
UNITIGS = f"""own AS (SELECT kmer, min(locus * 2 + CASE WHEN pos * 2 >= n THEN 1 ELSE 0 END) AS unitig FROM {_kmers(B.LOCI, 'locus', 21)} GROUP BY kmer HAVING count(*) = 1),
  h AS (SELECT sample, read_id, unitig, pos FROM {_kmers(B.READS, 'sample, read_id', 21)} JOIN own USING (kmer))"""
CASES = "CASE " + " ".join(f"WHEN contains(lower(name), '{a}') THEN {i}" for i, a in enumerate(V.ANCHORS)) + " END"

QUERIES = {
    "reference_positions": (
        reference_positions,
        f"""WITH w AS (SELECT locus, kmer, pos, n - {K - 1} AS total FROM {_kmers(B.LOCI, 'locus')}), v AS (SELECT locus, kmer, total, total - pos AS visit, false AS is_reverse FROM w UNION ALL SELECT locus, {RC.format('kmer')}, total, pos + 1, true FROM w),
        r AS (SELECT *, row_number() OVER (PARTITION BY locus, kmer ORDER BY is_reverse, visit) AS k, count(*) OVER (PARTITION BY locus, kmer) AS depth FROM v) SELECT locus, kmer, depth, CAST(floor(visit / total * 1000) AS INTEGER) AS position, is_reverse FROM r WHERE k = 1""",
    ),
    "slice_support": (slice_support, f"WITH {SLICES} SELECT * FROM support"),
    "terminal_evidence": (
        terminal_evidence,
        f"""WITH s AS (SELECT read_id, locus, strand, a.pos - b.pos AS diagonal, a.pos FROM {_kmers(B.READS, 'read_id', 21)} a JOIN {_kmers(STRANDS, 'locus, strand', 21)} b USING (kmer)), {MATCHES.format(20)},
        b AS (SELECT read_id, locus, strand, start AS q, start - diagonal AS f, length AS n FROM (SELECT *, row_number() OVER (PARTITION BY read_id, locus ORDER BY length DESC, strand, start - diagonal, start) AS r FROM m) WHERE r = 1),
        x AS (SELECT b.*, length(d.seq) AS ql, length(l.seq) AS rl, least(25, greatest(length(l.seq) // 5, 1)) AS w FROM b JOIN {B.READS} d USING (read_id) JOIN {B.LOCI} l USING (locus)),
        y AS (SELECT read_id, locus, w AS effective_window, CASE strand WHEN 1 THEN f ELSE rl - f - n END AS original_start, CASE strand WHEN 1 THEN f + n ELSE rl - f END AS original_end, CASE strand WHEN 1 THEN q ELSE ql - q - n END AS left_overhang, CASE strand WHEN 1 THEN ql - q - n ELSE q END AS right_overhang, rl FROM x)
        SELECT read_id, locus, effective_window, original_start, original_end, left_overhang, right_overhang, original_start <= effective_window AS near_left, rl - original_end <= effective_window AS near_right, original_start <= effective_window AND left_overhang > 0 AS extends_left, rl - original_end <= effective_window AND right_overhang > 0 AS extends_right FROM y""",
    ),
    "side_products": (side_products, """WITH c AS (SELECT l_partkey % 40 AS locus, l_linenumber % 2 AS s, l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY locus, s ORDER BY n DESC, id) <= 3) SELECT x.locus, x.id AS "left", y.id AS "right", x.n + y.n AS reads FROM b x JOIN b y ON x.locus = y.locus AND x.s = 0 AND y.s = 1"""),
    "junction_support": (
        junction_support,
        f"""WITH c AS (SELECT locus, seq FROM {B.LOCI} WHERE length(seq) >= 60), w AS (SELECT locus, t, right(seq, t) || left(seq, 20 - t) AS win FROM (SELECT *, unnest(range(7, 14)) AS t FROM c)),
        inner_w AS (SELECT locus, substr(seq, i, 20) AS x FROM (SELECT *, unnest(range(1, length(seq) - 18)) AS i FROM c)), gone AS (SELECT DISTINCT w.locus, t FROM w JOIN inner_w USING (locus) WHERE hamming(win, x) <= 1),
        own AS (SELECT * FROM w ANTI JOIN gone USING (locus, t)), e AS (SELECT locus, t, win FROM own UNION ALL SELECT locus, t, {RC.format('win')} FROM own),
        r AS (SELECT locus * 1000 + start // 9 AS read_id, substr(seq || seq, start + 1, 40) AS seq FROM (SELECT *, unnest(range(0, length(seq), 9)) AS start FROM c)), x AS (SELECT DISTINCT read_id, substr(seq, i, 20) AS x FROM (SELECT *, unnest(range(1, length(seq) - 18)) AS i FROM r)),
        p AS (SELECT read_id, locus, t, win, x FROM x JOIN e ON left(x, 10) = left(win, 10) UNION ALL SELECT read_id, locus, t, win, x FROM x JOIN e ON right(x, 10) = right(win, 10)), n AS (SELECT locus, t, count(DISTINCT read_id) AS n FROM p WHERE hamming(win, x) <= 1 GROUP BY ALL),
        s AS (SELECT locus, count(*) AS windows, min(coalesce(n, 0)) AS support FROM own LEFT JOIN n USING (locus, t) GROUP BY locus) SELECT locus, coalesce(windows, 0) AS windows, coalesce(support, 0) AS support FROM c LEFT JOIN s USING (locus)""",
    ),
    "reference_lengths": (reference_lengths, f"SELECT locus % 7 AS locus, CAST(round(avg(length(seq))) AS BIGINT) AS mean_length, count(*) AS sequences FROM {B.LOCI} GROUP BY locus % 7"),
    "largest_components": (largest_components, "SELECT l_partkey % 700 + l_suppkey % 3 AS root, count(*) AS size, min(l_orderkey) AS first FROM lineitem GROUP BY 1 ORDER BY size DESC, first, root LIMIT 256"),
    "species_order": (species_order, r"""WITH p AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE (p_partkey % 30) || '_' || p_name END AS name FROM part), n AS (SELECT name, regexp_extract(name, '^([+-]?[0-9]+)_', 1) AS d FROM p)
        SELECT name, CASE WHEN d = '' THEN 0 ELSE CAST(d AS BIGINT) END AS number, CASE WHEN d = '' THEN name ELSE substr(name, length(d) + 2) END AS rest FROM n"""),
    "solid_minimizers": (solid_minimizers, f"WITH k AS (SELECT fragment, mate, least(kmer, {RC.format('kmer')}) AS c FROM {_kmers(B.MATES, 'fragment, mate', 11)}), s AS (SELECT c FROM k GROUP BY c HAVING count(*) >= 3) SELECT fragment, mate, min(c) AS minimizer FROM k JOIN s USING (c) GROUP BY ALL"),
    "bait_orientation": (
        bait_orientation,
        f"""WITH i AS (SELECT DISTINCT locus, kmer FROM {_kmers(B.LOCI, 'locus', 23)}), w AS (SELECT read_id, pos, n, kmer FROM {_kmers(B.READS, 'read_id', 23)}), f AS (SELECT read_id, count(*) AS forward FROM w JOIN i USING (kmer) WHERE pos % 23 = 0 GROUP BY read_id),
        r AS (SELECT read_id, count(*) AS "reverse" FROM w JOIN (SELECT locus, {RC.format('kmer')} AS kmer FROM i) USING (kmer) WHERE (n - 23 - pos) % 23 = 0 GROUP BY read_id),
        a AS (SELECT read_id, count(*) AS anchored, max(n) AS best FROM (SELECT read_id, locus, count(*) AS n FROM {_kmers(B.READS, 'read_id', 21)} JOIN (SELECT DISTINCT locus, kmer FROM {_kmers(B.LOCI, 'locus', 21)}) USING (kmer) GROUP BY read_id, locus) GROUP BY read_id)
        SELECT read_id, coalesce(forward, 0) AS forward, coalesce("reverse", 0) AS "reverse", coalesce("reverse", 0) > coalesce(forward, 0) AS turned, coalesce(anchored, 0) AS anchored, coalesce(best, 0) AS best FROM f FULL JOIN r USING (read_id) FULL JOIN a USING (read_id)""",
    ),
    "gene_anchors": (
        gene_anchors,
        f"""WITH g AS (SELECT locus, seq, ['tRNA-Phe', 'COX1', 'nad1-b', 'rrnS', 'cytb', 'MT-CO1', 'trnF(gaa)', '12S'][locus % 8 + 1] AS name FROM {B.LOCI}),
        s AS (SELECT locus, name, CASE WHEN locus % 7 + 20 <= length(seq) THEN substr(seq, locus % 7 + 1, 20) ELSE '' END || CASE WHEN length(seq) >= 50 THEN substr(seq, 31, 20) ELSE '' END || CASE WHEN length(seq) >= 9999 THEN substr(seq, 41, 9959) ELSE '' END AS x FROM g)
        SELECT locus, name, {CASES} AS rank, CASE WHEN locus % 2 = 1 THEN {RC.format('x')} ELSE x END AS anchor FROM s""",
    ),
    "terminal_recruits": (
        terminal_recruits,
        f"""WITH e AS (SELECT locus, left(seq, 40) AS seq FROM {B.LOCI} UNION ALL SELECT locus, right(seq, 40) FROM {B.LOCI}), ix AS (SELECT DISTINCT locus, least(kmer, {RC.format('kmer')}) AS c FROM {_kmers('e', 'locus')}),
        h AS (SELECT read_id, locus, count(DISTINCT c) AS shared FROM (SELECT read_id, least(kmer, {RC.format('kmer')}) AS c FROM {_kmers(B.READS, 'read_id')}) JOIN ix USING (c) GROUP BY read_id, locus),
        s AS (SELECT read_id, locus, strand, a.pos - b.pos AS diagonal, a.pos FROM {_kmers(B.READS, 'read_id', 25)} a JOIN {_kmers(STRANDS, 'locus, strand', 25)} b USING (kmer)), {MATCHES.format(24)}
        SELECT read_id, locus, any_value(shared) AS shared, max(length) AS longest FROM h JOIN m USING (read_id, locus) GROUP BY read_id, locus""",
    ),
    "right_to_left": (right_to_left, f"SELECT locus, 1 AS strand, CAST(n - 21 - pos AS INTEGER) AS ordinal, kmer FROM {_kmers(B.LOCI, 'locus', 21)} WHERE pos >= 1 UNION ALL SELECT locus, 2, CAST(pos AS INTEGER), {RC.format('kmer')} FROM {_kmers(B.LOCI, 'locus', 21)} WHERE pos <= n - 22"),
    "contig_headers": (contig_headers, f"WITH {SLICES} SELECT locus, '>contig_' || contig_length || '_' || unique_reads || '_' || multi_reads || '_' || reads || '_' || extent || '_supported_' || supported || '_balance_' || printf('%.3f', CAST(flank_balance AS DOUBLE)) AS header FROM support"),
    "unitig_evidence": (unitig_evidence, f"WITH {UNITIGS} SELECT unitig, count(DISTINCT sample) AS samples, count(DISTINCT read_id) AS reads, count(*) AS depth FROM h GROUP BY unitig"),
    "unitig_edges": (unitig_edges, f"WITH {UNITIGS}, l AS (SELECT *, lag(unitig) OVER (PARTITION BY sample, read_id ORDER BY pos) AS a FROM h) SELECT a, unitig AS b, count(DISTINCT read_id) AS reads, count(DISTINCT sample) AS samples FROM l WHERE a <> unitig GROUP BY ALL"),
    "linked_sites": (
        linked_sites,
        f"""WITH {GT}, p AS (SELECT site % 50 AS locus, site, row_number() OVER (PARTITION BY site % 50 ORDER BY site) AS i FROM (SELECT DISTINCT site FROM d)), q AS (SELECT locus, i, d.* FROM d JOIN p USING (site)),
        r AS (SELECT x.locus, x.site AS a, y.site AS b, pow(corr(x.n, y.n), 2) AS r2 FROM q x JOIN q y ON x.locus = y.locus AND x.sample = y.sample AND y.i BETWEEN x.i + 1 AND x.i + 5 GROUP BY ALL) SELECT locus, a, b, round(r2, 6) AS r2 FROM r WHERE round(r2, 6) >= 0.1 AND NOT isnan(r2)""",
    ),
    "sample_components": (sample_components, None),
    "shared_alleles": (shared_alleles, f"WITH {GT}, g AS (SELECT site, sample % 10 AS sample, max(n) AS n FROM d GROUP BY ALL) SELECT x.sample AS a, y.sample AS b, count(*) AS sites, round(avg(1 - abs(x.n - y.n) / 2), 6) AS ibs FROM g x JOIN g y ON x.site = y.site AND x.sample < y.sample GROUP BY ALL"),
}
