"""Recruitment queries: documents as reads, benchmark items as loci, conversations as mates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import recruitment as R
from . import bridges as B

K = 15
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _canon(x: str) -> str:
    return f"least({x}, {RC.format(x)})"


def _kmers(source: str, keys: str, k: int = K) -> str:
    """DuckDB: the k-mers of a source, with pos from 0."""
    return f"(SELECT {keys}, pos, substr(seq, CAST(pos + 1 AS BIGINT), {k}) AS kmer, length(seq) AS n FROM (SELECT *, unnest(range(0, length(seq) - {k} + 1)) AS pos FROM {source} s))"


def _index(k: int = K) -> str:
    return f"(SELECT locus, kmer, {_canon('kmer')} AS canonical, pos FROM {_kmers(B.LOCI, 'locus', k)})"


REF = f"ref AS (SELECT DISTINCT locus, canonical FROM {_index()})"
HITS = f"{REF}, hits AS (SELECT read_id, locus, count(DISTINCT canonical) AS shared FROM (SELECT read_id, {_canon('kmer')} AS canonical FROM {_kmers(B.READS, 'read_id')}) JOIN ref USING (canonical) GROUP BY read_id, locus)"
STRANDS = f"(SELECT locus, 1 AS strand, seq FROM {B.LOCI} UNION ALL SELECT locus, 2, {RC.format('seq')} FROM {B.LOCI})"


def recruit_counts(spark, sf):
    return R.read_counts(R.hits(B.reads(spark, sf), B.loci(spark, sf), K))


def recruit_hits(spark, sf):
    return R.hits(B.reads(spark, sf), B.loci(spark, sf), K)


def recruit_stepped(spark, sf):
    return R.read_counts(R.hits(B.reads(spark, sf), B.loci(spark, sf), K, step=4))


def recruit_tiered(spark, sf):
    return R.tiered(B.reads(spark, sf), B.loci(spark, sf), (31, 21)).groupBy("locus", "k").agg(F.count("*").alias("reads"), F.sum("shared").alias("shared"))


def recruit_siblings(spark, sf):
    direct = R.hits(B.reads(spark, sf), B.loci(spark, sf), K).select("read_id", "locus", (F.col("read_id") % 2 + 1).cast("int").alias("arm"))
    return R.sibling_hits(direct, 3)


def recruit_fragments(spark, sf):
    """Fragments with a mate that hits, with the mates' loci united (U1) and intersected."""
    found = R.hits(B.mates(spark, sf), B.loci(spark, sf), 9, keys=("fragment", "mate"))
    sets = found.groupBy("fragment").agg(*[F.coalesce(F.array_sort(F.collect_set(F.when(F.col("mate") == m, F.col("locus")))), F.array().cast("array<long>")).alias(f"m{m}") for m in (1, 2)])
    both, either = F.array_intersect("m1", "m2"), F.array_union("m1", "m2")
    state = F.when(F.size(both) == 1, "strong").when(F.size(both) > 1, "ambiguous").when(F.size(either) == 1, "single_mate").otherwise("ambiguous")
    return sets.select("fragment", F.size(either).cast("long").alias("n_either"), F.size(both).cast("long").alias("n_both"), state.alias("state"))


def pair_orientation(spark, sf):
    return R.orientation(B.mates(spark, sf), B.loci(spark, sf), 11).withColumn("linked", F.expr("NOT (o1 = o2 AND o1 IN (0, 1, 2))"))


def mates_kept(spark, sf):
    """Of linked pairs both mates, or only those with a strand."""
    kept = R.linked_pairs(R.orientation(B.mates(spark, sf), B.loci(spark, sf), 11))
    mates = kept.select("fragment", "locus", F.explode(F.array(F.struct(F.lit(1).alias("mate"), F.col("o1").alias("o")), F.struct(F.lit(2).alias("mate"), F.col("o2").alias("o")))).alias("x")).select("fragment", "locus", "x.*")
    return mates.groupBy("locus").agg(F.count("*").alias("linked"), F.count_if(F.expr("o > 0")).alias("oriented"))


def posting_sizes(spark, sf):
    """K-mers by how many loci own them; those of several are ambiguous."""
    index = R.reference_index(B.loci(spark, sf), 9).groupBy("canonical").agg(F.countDistinct("locus").alias("owners"))
    return index.groupBy("owners").agg(F.count("*").alias("kmers"))


def unique_minimizers(spark, sf):
    """For each locus its minimizers, and those that no other locus owns."""
    own = B.loci(spark, sf).select("locus", F.explode(F.expr(S.minimizers("seq", 9, 6))).alias("m"))
    owners = own.groupBy("m").agg(F.countDistinct("locus").alias("n"))
    return own.join(owners, "m").groupBy("locus").agg(F.count("*").alias("minimizers"), F.count_if(F.expr("n = 1")).alias("own"))


def exact_matches(spark, sf):
    return R.longest_match(R.match_spans(B.reads(spark, sf), B.loci(spark, sf), 21))


def match_profile(spark, sf):
    """All maximal exact matches by locus and strand."""
    return R.match_spans(B.reads(spark, sf), B.loci(spark, sf), 21).groupBy("locus", "strand").agg(F.count("*").alias("matches"), F.max("length").alias("longest"), F.sum("length").alias("bases"))


def orientation_votes(spark, sf):
    votes = R.unique_votes(B.reads(spark, sf), B.loci(spark, sf), 21)
    return votes.withColumn("orient", F.expr("CASE WHEN forward > reverse THEN 1 WHEN reverse > forward THEN 2 ELSE 0 END"))


def ownership_breadth(spark, sf):
    """Of each locus's own k-mers the share that some read covers."""
    index = R.reference_index(B.loci(spark, sf), K)
    single = index.groupBy("canonical").agg(F.countDistinct("locus").alias("n"), F.min("locus").alias("locus")).where("n = 1").select("canonical", "locus")
    keys = index.select("kmer", "canonical").distinct().join(single, "canonical")
    seen = R.matching_kmers(B.reads(spark, sf), keys, B.loci(spark, sf), K, ()).select("kmer").distinct().join(R.sized(keys, B.loci(spark, sf)), "kmer").select("canonical").distinct().withColumn("seen", F.lit(1))
    return single.join(seen, "canonical", "left").groupBy("locus").agg(F.count("*").alias("own"), F.count("seen").alias("covered")).withColumn("breadth", F.round(F.col("covered") / F.col("own"), 6))


def scan_only(spark, sf):
    """How many reads hit anything, without the hits."""
    index = R.reference_index(B.loci(spark, sf), K).select("kmer").distinct()
    found = R.matching_kmers(B.reads(spark, sf), index, B.loci(spark, sf), K, ("sample", "read_id")).select("sample", "read_id").distinct()
    return found.groupBy("sample").agg(F.count("*").alias("reads"))


def effective_lengths(spark, sf):
    grouped = B.loci(spark, sf).withColumn("locus", F.expr("locus % 7")).groupBy("locus").agg(F.max(F.length("seq")).alias("longest"), F.countDistinct("seq").alias("sequences"))
    return grouped.withColumn("effective", F.expr(S.effective_length("longest", "sequences")))


QUERIES = {
    "recruit_counts": (recruit_counts, f"WITH {HITS} SELECT locus, count(*) AS reads, CAST(sum(shared) AS BIGINT) AS shared FROM hits GROUP BY locus"),
    "recruit_hits": (recruit_hits, f"WITH {HITS} SELECT * FROM hits"),
    "recruit_stepped": (
        recruit_stepped,
        f"""WITH {REF}, hits AS (SELECT read_id, locus, count(DISTINCT canonical) AS shared FROM (SELECT read_id, {_canon('kmer')} AS canonical FROM {_kmers(B.READS, 'read_id')} WHERE pos % 4 = 0 OR pos = n - {K}) JOIN ref USING (canonical) GROUP BY read_id, locus)
        SELECT locus, count(*) AS reads, CAST(sum(shared) AS BIGINT) AS shared FROM hits GROUP BY locus""",
    ),
    "recruit_tiered": (
        recruit_tiered,
        f"""WITH a AS (SELECT read_id, locus, count(DISTINCT canonical) AS shared FROM (SELECT read_id, {_canon('kmer')} AS canonical FROM {_kmers(B.READS, 'read_id', 31)}) JOIN (SELECT DISTINCT locus, canonical FROM {_index(31)}) USING (canonical) GROUP BY ALL),
        b AS (SELECT read_id, locus, count(DISTINCT canonical) AS shared FROM (SELECT read_id, {_canon('kmer')} AS canonical FROM {_kmers(B.READS, 'read_id', 21)} WHERE read_id NOT IN (SELECT read_id FROM a)) JOIN (SELECT DISTINCT locus, canonical FROM {_index(21)}) USING (canonical) GROUP BY ALL)
        SELECT locus, k, count(*) AS reads, CAST(sum(shared) AS BIGINT) AS shared FROM (SELECT *, 31 AS k FROM a UNION ALL SELECT *, 21 FROM b) GROUP BY locus, k""",
    ),
    "recruit_siblings": (
        recruit_siblings,
        f"WITH {HITS}, first AS (SELECT read_id, locus, arm FROM (SELECT read_id, locus, CAST(read_id % 2 + 1 AS INTEGER) AS arm, row_number() OVER (PARTITION BY locus, read_id % 2 ORDER BY read_id) AS r FROM hits) WHERE r <= 3) SELECT * FROM first UNION SELECT read_id, locus, 3 - arm FROM first",
    ),
    "recruit_fragments": (
        recruit_fragments,
        f"""WITH h AS (SELECT DISTINCT fragment, mate, locus FROM (SELECT fragment, mate, {_canon('kmer')} AS canonical FROM {_kmers(B.MATES, 'fragment, mate', 9)}) JOIN (SELECT DISTINCT locus, canonical FROM {_index(9)}) USING (canonical)),
        l AS (SELECT fragment, locus, count(*) AS n FROM h GROUP BY ALL), c AS (SELECT fragment, count(*) AS n_either, count(*) FILTER (WHERE n = 2) AS n_both FROM l GROUP BY fragment)
        SELECT *, CASE WHEN n_both = 1 THEN 'strong' WHEN n_both > 1 THEN 'ambiguous' WHEN n_either = 1 THEN 'single_mate' ELSE 'ambiguous' END AS state FROM c""",
    ),
    "pair_orientation": (
        pair_orientation,
        f"""WITH r AS (SELECT locus, kmer, bit_or(o) AS o FROM (SELECT locus, kmer, 1 AS o FROM {_kmers(B.LOCI, 'locus', 11)} UNION ALL SELECT locus, {RC.format('kmer')}, 2 FROM {_kmers(B.LOCI, 'locus', 11)}) GROUP BY ALL)
        SELECT *, NOT (o1 = o2 AND o1 IN (0, 1, 2)) AS linked FROM (SELECT fragment, locus, coalesce(bit_or(o) FILTER (WHERE mate = 1), 0) AS o1, coalesce(bit_or(o) FILTER (WHERE mate = 2), 0) AS o2 FROM {_kmers(B.MATES, 'fragment, mate', 11)} JOIN r USING (kmer) GROUP BY fragment, locus)""",
    ),
    "mates_kept": (
        mates_kept,
        f"""WITH r AS (SELECT locus, kmer, bit_or(o) AS o FROM (SELECT locus, kmer, 1 AS o FROM {_kmers(B.LOCI, 'locus', 11)} UNION ALL SELECT locus, {RC.format('kmer')}, 2 FROM {_kmers(B.LOCI, 'locus', 11)}) GROUP BY ALL),
        p AS (SELECT fragment, locus, coalesce(bit_or(o) FILTER (WHERE mate = 1), 0) AS o1, coalesce(bit_or(o) FILTER (WHERE mate = 2), 0) AS o2 FROM {_kmers(B.MATES, 'fragment, mate', 11)} JOIN r USING (kmer) GROUP BY fragment, locus)
        SELECT locus, 2 * count(*) AS linked, CAST(sum((o1 > 0)::INT + (o2 > 0)::INT) AS BIGINT) AS oriented FROM p WHERE NOT (o1 = o2 AND o1 IN (0, 1, 2)) GROUP BY locus""",
    ),
    "posting_sizes": (posting_sizes, f"SELECT owners, count(*) AS kmers FROM (SELECT canonical, count(DISTINCT locus) AS owners FROM {_index(9)} GROUP BY canonical) GROUP BY owners"),
    "unique_minimizers": (
        unique_minimizers,
        f"""WITH c AS (SELECT locus, pos, {_canon('kmer')} AS c FROM {_kmers(B.LOCI, 'locus', 9)}), m AS (SELECT DISTINCT locus, m FROM (SELECT locus, pos, min(c) OVER (PARTITION BY locus ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS m, count(*) OVER (PARTITION BY locus) AS n FROM c) WHERE pos <= greatest(0, n - 6)),
        o AS (SELECT m, count(*) AS n FROM m GROUP BY m) SELECT locus, count(*) AS minimizers, count(*) FILTER (WHERE n = 1) AS own FROM m JOIN o USING (m) GROUP BY locus""",
    ),
    "exact_matches": (
        exact_matches,
        f"""WITH s AS (SELECT read_id, locus, strand, a.pos - b.pos AS diagonal, a.pos FROM {_kmers(B.READS, 'read_id', 21)} a JOIN {_kmers(STRANDS, 'locus, strand', 21)} b USING (kmer)),
        i AS (SELECT *, pos - row_number() OVER (PARTITION BY read_id, locus, strand, diagonal ORDER BY pos) AS island FROM s),
        m AS (SELECT read_id, locus, strand, diagonal, min(pos) AS start, count(*) + 20 AS length FROM i GROUP BY read_id, locus, strand, diagonal, island)
        SELECT read_id, locus, strand, start AS read_start, start - diagonal AS ref_start, length FROM (SELECT *, row_number() OVER (PARTITION BY read_id, locus ORDER BY length DESC, strand, start - diagonal, start) AS r FROM m) WHERE r = 1""",
    ),
    "match_profile": (
        match_profile,
        f"""WITH s AS (SELECT read_id, locus, strand, a.pos - b.pos AS diagonal, a.pos FROM {_kmers(B.READS, 'read_id', 21)} a JOIN {_kmers(STRANDS, 'locus, strand', 21)} b USING (kmer)),
        i AS (SELECT *, pos - row_number() OVER (PARTITION BY read_id, locus, strand, diagonal ORDER BY pos) AS island FROM s),
        m AS (SELECT locus, strand, count(*) + 20 AS length FROM i GROUP BY read_id, locus, strand, diagonal, island) SELECT locus, strand, count(*) AS matches, max(length) AS longest, CAST(sum(length) AS BIGINT) AS bases FROM m GROUP BY ALL""",
    ),
    "orientation_votes": (
        orientation_votes,
        f"""WITH o AS (SELECT locus, kmer, min(strand) AS strand FROM {_kmers(STRANDS, 'locus, strand', 21)} GROUP BY ALL HAVING count(*) = 1)
        SELECT *, CASE WHEN forward > reverse THEN 1 WHEN reverse > forward THEN 2 ELSE 0 END AS orient FROM (SELECT read_id, locus, count(*) FILTER (WHERE strand = 1) AS forward, count(*) FILTER (WHERE strand = 2) AS reverse FROM {_kmers(B.READS, 'read_id', 21)} JOIN o USING (kmer) GROUP BY ALL)""",
    ),
    "ownership_breadth": (
        ownership_breadth,
        f"""WITH s AS (SELECT canonical, min(locus) AS locus FROM {_index()} GROUP BY canonical HAVING count(DISTINCT locus) = 1), r AS (SELECT DISTINCT {_canon('kmer')} AS canonical FROM {_kmers(B.READS, 'read_id')})
        SELECT locus, count(*) AS own, count(r.canonical) AS covered, round(count(r.canonical) / count(*), 6) AS breadth FROM s LEFT JOIN r USING (canonical) GROUP BY locus""",
    ),
    "scan_only": (scan_only, f"WITH {REF} SELECT sample, count(DISTINCT read_id) AS reads FROM (SELECT sample, read_id, {_canon('kmer')} AS canonical FROM {_kmers(B.READS, 'sample, read_id')}) SEMI JOIN ref USING (canonical) GROUP BY sample"),
    "effective_lengths": (effective_lengths, f"SELECT *, CAST(floor(longest * (log10(sequences) + 1)) AS BIGINT) AS effective FROM (SELECT locus % 7 AS locus, max(length(seq)) AS longest, count(DISTINCT seq) AS sequences FROM {B.LOCI} GROUP BY locus % 7)"),
}
