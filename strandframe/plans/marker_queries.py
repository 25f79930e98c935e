"""Queries of coloured marker references: loci with groups, turns of conversations as decoys, tiles of documents as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markers as M
from . import bridges as B
from .recruitment_queries import RC, _kmers

K, TILE = 21, 100


def colours(spark, sf):
    """Loci in seven groups by a map, and turns as decoys."""
    loci = B.loci(spark, sf).selectExpr("concat('m', locus) AS ref", "seq", "concat('g', locus % 7) AS grp")
    decoys = B.mates(spark, sf).groupBy("seq").agg(F.min(F.struct("fragment", "mate")).alias("x")).selectExpr("concat('d', x.fragment, '_', x.mate) AS ref", "seq")
    return M.coloured(M.grouped(loci.select("ref", "seq"), loci.select("ref", "grp")), decoys)


def tiles(spark, sf):
    """Documents in tiles of 100 bases, all of them."""
    cut = B.reads(spark, sf).where("seq <> ''").select("sample", "read_id", F.posexplode(F.expr(f"transform(sequence(1, length(seq), {TILE}), i -> substring(seq, i, {TILE}))")).alias("tile", "seq"))
    return cut.selectExpr("sample", "read_id", "tile", "seq")


KEYS = ("read_id", "tile")


def colour_classes(spark, sf):
    """The classes of colours, with their k-mers of either strand and their colours."""
    kmers, members = M.colour_classes(colours(spark, sf), K)
    return kmers.groupBy("class").agg(F.count("*").alias("kmers")).join(members.groupBy("class").agg(F.count("*").alias("colours"), F.min("colour").alias("first")), "class")


def marker_support(spark, sf):
    """Support of each reference by the tiles of all documents."""
    own = colours(spark, sf)
    return M.reference_support(M.pseudoaligned(tiles(spark, sf), own, K, keys=KEYS), own, KEYS)


def marker_quality(spark, sf):
    """Tiles by sample, those with a colour, and those that only decoys hold."""
    own, t = colours(spark, sf), tiles(spark, sf)
    return M.marker_quality(t, M.pseudoaligned(t, own, K, keys=KEYS), own, "sample", KEYS)


COLOURS = f"""c AS (SELECT row_number() OVER (ORDER BY decoy, ref) - 1 AS colour, * FROM (SELECT 0 AS decoy, 'm' || locus AS ref, 'g' || locus % 7 AS grp, seq FROM {B.LOCI}
  UNION ALL SELECT 1, 'd' || min(fragment * 10 + mate) // 10 || '_' || min(fragment * 10 + mate) % 10, 'DECOY', seq FROM {B.MATES} GROUP BY seq) WHERE seq <> ''),
  i AS MATERIALIZED (SELECT DISTINCT colour, kmer FROM (SELECT colour, kmer FROM {_kmers('c', 'colour', K)} UNION ALL SELECT colour, {RC.format('kmer')} FROM {_kmers('c', 'colour', K)}))"""
ALIGNED = f"""t AS MATERIALIZED (SELECT sample, read_id, j AS tile, substr(seq, j * {TILE} + 1, {TILE}) AS seq FROM (SELECT *, unnest(range(0, (length(seq) + {TILE - 1}) // {TILE})) AS j FROM {B.READS})),
  w AS MATERIALIZED (SELECT read_id, tile, pos, kmer FROM {_kmers('t', 'read_id, tile', K)}), n AS (SELECT read_id, tile, count(*) AS windows, count(*) FILTER (WHERE kmer IN (SELECT kmer FROM i)) AS known FROM w GROUP BY ALL),
  a AS (SELECT read_id, tile, colour FROM (SELECT read_id, tile, colour, count(*) AS hits FROM w JOIN i USING (kmer) GROUP BY ALL) JOIN n USING (read_id, tile) WHERE known >= 0.5 * windows AND hits >= 0.8 * known)"""

QUERIES = {
    "colour_classes": (
        colour_classes,
        f"""WITH {COLOURS}, s AS (SELECT kmer, list(colour ORDER BY colour) AS colours FROM i GROUP BY kmer)
        SELECT min(least(kmer, {RC.format('kmer')})) AS class, count(*) AS kmers, len(colours) AS colours, colours[1] AS "first" FROM s GROUP BY s.colours""",
    ),
    "marker_support": (
        marker_support,
        f"""WITH {COLOURS}, {ALIGNED}, m AS (SELECT *, count(*) OVER (PARTITION BY read_id, tile) AS n FROM a)
        SELECT colour, any_value(ref) AS ref, any_value(grp) AS grp, count(*) AS queries, round(sum(1 / n), 8) AS weight, count(*) FILTER (WHERE n = 1) AS alone, CASE WHEN count(*) FILTER (WHERE n = 1) > 0 THEN 'has_singleton_support' ELSE 'shared_only' END AS status
        FROM m JOIN c USING (colour) GROUP BY colour""",
    ),
    "marker_quality": (
        marker_quality,
        f"""WITH {COLOURS}, {ALIGNED}, m AS (SELECT read_id, tile, bool_and(grp = 'DECOY') AS d FROM a JOIN c USING (colour) GROUP BY ALL)
        SELECT sample, count(*) AS queries, count(d) AS aligned, count(*) FILTER (WHERE d) AS absorbed FROM t LEFT JOIN m USING (read_id, tile) GROUP BY sample""",
    ),
}
