"""Duplicate marking over SAM rows: templates whose mates begin at the same places are copies of one molecule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S

#: Flags of rows that are no mate's own alignment, of an unmapped mate and of the other strand.
EXTRA, UNMAPPED, REVERSE = 0x100 | 0x800, 0x4, 0x10
#: Base qualities count from this on.
LEAST_QUALITY = 15


def five_prime(sam: DataFrame) -> DataFrame:
    """sam (sample, qname, flag, rname, pos, cigar, qual) without extra rows, with end, where the mate begins before any clipping (null if unmapped), and score, the sum of its good base qualities."""
    own = sam.where(F.expr(f"flag & {EXTRA} = 0")).withColumn("_ops", F.expr(f"CASE WHEN flag & {UNMAPPED} = 0 AND cigar <> '*' THEN {S.cigar_operations('cigar')} END"))
    clipped = "filter({0}, (o, i) -> forall(slice({0}, 1, i + 1), x -> x.op IN ('S', 'H')))"
    sized = own.withColumn("_lead", F.expr(f"aggregate({clipped.format('_ops')}, 0L, (s, o) -> s + o.n)")).withColumn("_trail", F.expr(f"aggregate({clipped.format('reverse(_ops)')}, 0L, (s, o) -> s + o.n)"))
    spanned = sized.withColumn("_span", F.expr("aggregate(filter(_ops, o -> o.op IN ('M', 'D', 'N', '=', 'X')), 0L, (s, o) -> s + o.n)"))
    end = f"CASE WHEN _ops IS NOT NULL THEN struct(rname, CASE WHEN flag & {REVERSE} <> 0 THEN pos + _span - 1 + _trail ELSE pos - _lead END AS at, flag & {REVERSE} <> 0 AS reverse) END"
    quality = f"aggregate(transform(sequence(1, length(qual)), i -> ascii(substring(qual, i, 1)) - 33), 0L, (s, q) -> s + CASE WHEN q >= {LEAST_QUALITY} THEN q ELSE 0 END)"
    return spanned.select("sample", "qname", F.expr(end).alias("end"), F.expr(f"CASE WHEN length(qual) > 0 AND qual <> '*' THEN {quality} ELSE 0L END").alias("score"))


def marked(sam: DataFrame) -> DataFrame:
    """Rows (sample, qname, ends, duplicate, of) of every template with a mapped mate.

    Templates of a sample that begin at the same places on the same strands at both ends are copies: the one of the highest
    score stays, ties to the least name. A template with one mapped mate is a copy where any pair has that end, else of the
    best such single one. of names the template that stays; it is null for a single one that a pair outdoes. Only one row for
    each place meets the rows of its copies, so a place of many copies is added up before it is shuffled.
    """
    ends = five_prime(sam).groupBy("sample", "qname").agg(F.array_sort(F.collect_list("end")).alias("key"), F.sum("score").alias("score"))
    templates = ends.where("size(key) BETWEEN 1 AND 2").withColumn("ends", F.size("key"))
    best = templates.groupBy("sample", "key").agg(F.min(F.struct((-F.col("score")).alias("s"), "qname")).alias("best")).select("sample", "key", F.col("best.qname").alias("of"))
    paired = templates.where("ends = 2").select("sample", F.explode("key").alias("_end")).distinct().select("sample", F.array("_end").alias("key"), F.lit(True).alias("outdone"))
    both = templates.join(best, ["sample", "key"]).join(paired, ["sample", "key"], "left")
    return both.selectExpr("sample", "qname", "ends", "coalesce(outdone, false) OR of <> qname AS duplicate", "CASE WHEN outdone THEN NULL ELSE of END AS of")
