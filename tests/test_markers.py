"""Coloured markers against a plain reading: decoys absorb, shared stretches divide, maps of groups must agree."""

import random
from collections import Counter, defaultdict

import pytest

from strandframe.operators import markers as M

from .test_brute import other

K = 15


def draw(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def planted(spark):
    rng = random.Random(3)
    shared, decoy = draw(rng, 80), draw(rng, 160)
    refs = [(f"r{i}", draw(rng, 90) + (shared if i < 3 else "")) for i in range(6)] + [("r6", decoy[:70] + draw(rng, 60)), ("r7", "")]
    decoys = [("d0", decoy), ("d1", draw(rng, 100))]
    reads = [(i, s) for i, s in enumerate([refs[0][1][:60], other(refs[1][1][10:70]), shared[5:65], decoy[5:65], decoy[85:150], draw(rng, 60), refs[5][1][:20] + draw(rng, 60), refs[4][1][:30] + "N" + refs[4][1][31:70], "", None, "ACGT"])]
    refs_df = spark.createDataFrame(refs, "ref string, seq string")
    return refs, decoys, reads, refs_df, spark.createDataFrame(decoys, "ref string, seq string"), spark.createDataFrame(reads, "read_id long, seq string")


def plain_support(refs, decoys, reads):
    colours = [r for r in sorted(refs) if r[1]] + sorted(decoys)
    sets = [{s[i : i + K] for s in (q, other(q)) for i in range(len(q) - K + 1)} for _, q in colours]
    support = defaultdict(Counter)
    for _, q in reads:
        own = [w for i in range(len(q or "") - K + 1) if "N" not in (w := q[i : i + K])]
        known = [w for w in own if any(w in s for s in sets)]
        if not known or len(known) < 0.5 * len(own):
            continue
        found = [c for c, s in enumerate(sets) if (hits := sum(w in s for w in known)) and hits >= 0.8 * len(known)]
        for c in found:
            support[c] += Counter(queries=1, weight=1 / len(found), alone=len(found) == 1)
    return {(c, colours[c][0]): (s["queries"], round(s["weight"], 8), s["alone"]) for c, s in support.items()}


def test_support_equals_plain_reading(spark):
    refs, decoys, reads, r, d, q = planted(spark)
    own = M.coloured(M.grouped(r, r.selectExpr("ref", "concat('g', ref) AS grp")), d)
    aligned = M.pseudoaligned(q, own, K)
    got = M.reference_support(aligned, own).collect()
    assert {(x["colour"], x["ref"]): (x["queries"], x["weight"], x["alone"]) for x in got} == plain_support(refs, decoys, reads)
    by_ref = {x["ref"]: x for x in got}
    assert by_ref["d0"]["grp"] == M.DECOY and by_ref["d0"]["alone"] == 1 and by_ref["r6"]["status"] == "shared_only"
    assert [by_ref[f"r{i}"]["weight"] for i in (0, 1, 2)] == [round(4 / 3, 8), round(4 / 3, 8), round(1 / 3, 8)]
    (row,) = M.marker_quality(q.selectExpr("'s' AS sample", "*"), aligned, own, "sample").collect()
    assert (row["queries"], row["absorbed"]) == (len(reads), 1)


def test_classes_are_the_sets_of_colours(spark):
    refs, decoys, _, r, d, _ = planted(spark)
    own = M.coloured(r.selectExpr("ref", "ref AS grp", "seq"), d)
    kmers, members = M.colour_classes(own, K)
    of = defaultdict(set)
    for x in members.collect():
        of[x["class"]].add(x["colour"])
    got = {x["kmer"]: frozenset(of[x["class"]]) for x in kmers.collect()}
    want = defaultdict(set)
    for c, (_, q) in enumerate([x for x in sorted(refs) if x[1]] + sorted(decoys)):
        for s in (q, other(q)):
            for i in range(len(q) - K + 1):
                want[s[i : i + K]].add(c)
    assert got == {w: frozenset(s) for w, s in want.items()}


@pytest.mark.parametrize(
    ("rows", "fault"),
    [([("a", "x"), ("a", "y"), ("b", "x")], "more than one group: a$"), ([("a", "x")], "without a group: b$"), ([("a", "x"), ("b", "x"), ("c", "x")], "without a reference: c$")],
)
def test_faulty_maps_of_groups_are_refused(spark, rows, fault):
    refs = spark.createDataFrame([("a", "ACGT"), ("b", "ACGT")], "ref string, seq string")
    with pytest.raises(ValueError, match=fault):
        M.grouped(refs, spark.createDataFrame(rows, "ref string, grp string"))


def test_repeated_rows_of_a_map_agree_and_empty_tables_give_none(spark):
    refs = spark.createDataFrame([("a", "ACGT" * 5)], "ref string, seq string")
    own = M.coloured(M.grouped(refs, spark.createDataFrame([("a", "x"), (" a", "x ")], "ref string, grp string")))
    assert [tuple(r) for r in own.select("colour", "ref", "grp").collect()] == [(0, "a", "x")]
    none = spark.createDataFrame([], "read_id long, seq string")
    assert M.pseudoaligned(none, own, K).isEmpty()


def test_classes_shuffle_codes_once(spark):
    """Colours meet as codes, one row for both strands, and a class of one colour needs no join for its member."""
    _, _, _, r, d, _ = planted(spark)
    own = M.coloured(r.selectExpr("ref", "ref AS grp", "seq"), d)
    kmers, members = M.colour_classes(own, K)
    wide, far = M.colour_classes(own, 33)
    assert kmers.schema["kmer"].dataType == wide.schema["kmer"].dataType and members.columns == far.columns
    sizes = {x["class"]: x["n"] for x in members.groupBy("class").agg({"colour": "count"}).withColumnRenamed("count(colour)", "n").collect()}
    assert set(sizes) == {x["class"] for x in kmers.select("class").distinct().collect()} and max(sizes.values()) == 3
    assert members.distinct().count() == members.count() and kmers.select("kmer").distinct().count() == kmers.count()


def test_queries_meet_colours_as_codes(spark):
    """before, a k-mer of either strand and the name of its class went as texts into the join with every window."""
    _, _, _, r, d, q = planted(spark)
    own = M.coloured(r.selectExpr("ref", "ref AS grp", "seq"), d)
    got = M.pseudoaligned(q, own, K)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "code#" in plan and "kmer#" not in plan and "canonical#" not in plan
    assert got.columns == M.pseudoaligned(q, own, 33).columns and got.schema["hits"] == M.pseudoaligned(q, own, 33).schema["hits"]
    sets = M._coded_sets(own, K)
    assert sets.where("n = 1 AND h IS NOT NULL OR n > 1 AND h IS NULL").isEmpty() and not sets.where("n > 1").isEmpty()
