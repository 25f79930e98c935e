"""Pairs within groups are dealt to many tasks, and repeated arms are not compared anew."""

import random

import pytest

from strandframe.operators import assembly, packed, tables, variants

from .test_brute import other
from .test_pieces import K, drawn, windows


def test_pairs_are_spread_over_tasks(spark):
    """one file and one group still make many tasks' work; a broadcast of the small side would leave it to one."""
    a = spark.range(300).selectExpr("id div 1000 AS g", "id AS a").coalesce(1)
    both = tables.spread_pairs(a, a.withColumnRenamed("a", "b"), ["g"], "a")
    assert "Broadcast" not in both._jdf.queryExecution().sparkPlan().toString()
    sizes = both.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 300 * 300 and max(sizes) < 300 * 300 / 8
    assert both.where("a < b").distinct().count() == 300 * 299 // 2


def test_identities_equal_a_plain_reading(spark):
    """F11."""
    rng = random.Random(8)
    rows = [(i % 2, i, "".join(rng.choice("ACGT-N") for _ in range(rng.choice([0, 5, 12, 30])))) for i in range(30)] + [(0, 99, None), (None, 98, "ACGTACGT")]
    got = variants.pair_identities(spark.createDataFrame(rows, "locus long, id long, seq string"), ["locus"])
    assert "MapInPandas" in got._jdf.queryExecution().toString()
    want = {}
    for p, i, x in rows:
        for q, j, y in rows:
            if p is not None and p == q and i < j:
                pairs = [(c, d) for c, d in zip(x, y) if c not in "-N" and d not in "-N"] if x is not None and y is not None else None
                n, same = (None, None) if pairs is None else (len(pairs), sum(c == d for c, d in pairs))
                want[p, i, j] = (n, same, round(same / n, 6) if n is not None and n >= 7 else None)
    found = {(r["locus"], r["a"], r["b"]): (r["n"], r["same"], r["identity"]) for r in got.collect()}
    assert found.keys() == want.keys()
    for key, (n, same, identity) in want.items():
        assert found[key][:2] == (n, same) and found[key][2] == pytest.approx(identity, abs=1e-6)


def plain_catalogue(arms, seeds=16, k=11, shared=2, most=3):
    sketch = lambda s: set(sorted({s[i : i + k] for i in range(len(s) - k + 1)})[:seeds])
    centres, out = [], []
    for id, left, right in sorted(arms):
        found = []
        for n, (x, y) in enumerate(centres):
            if len(sketch(left) & sketch(x)) >= shared and len(sketch(right) & sketch(y)) >= shared:
                d, e = assembly.edit_distance(left, x, most), assembly.edit_distance(right, y, most)
                if d is not None and e is not None and d + e <= most:
                    found.append((d + e, n))
        found.sort()
        if found and (len(found) == 1 or found[0][0] < found[1][0]):
            out.append((id, found[0][1]))
        else:
            out.append((id, len(centres)))
            centres.append((left, right))
    return out


def test_repeated_arms_are_compared_once(monkeypatch):
    """the same clusters as by comparing every pair with every centre, with work by distinct arms."""
    rng = random.Random(4)
    base = ["".join(rng.choice("ACGT") for _ in range(32)) for _ in range(3)]
    near = [*base, *(b[:10] + "A" + b[11:] for b in base), *(b[:20] + "C" + b[21:] for b in base), *(b[:10] + "A" + b[11:20] + "C" + b[21:] for b in base)]
    arms = [(f"{i:04d}", rng.choice(near), base[rng.randrange(3)]) for i in range(400)]
    want = plain_catalogue(arms)
    assert len({c for _, c in want}) > 9
    calls, own = [], assembly.edit_distance
    monkeypatch.setattr(assembly, "edit_distance", lambda *x: calls.append(x) or own(*x))
    assert assembly.catalogue(arms) == want
    centres = len({c for _, c in want})
    assert len(calls) <= 2 * centres * len({a[1:] for a in arms})


def test_distinct_counts(spark):
    """k-mers of a read are counted where it lies."""
    reads = spark.createDataFrame(list(enumerate(drawn())), "read_id long, seq string")
    got = packed.distinct_counts(reads, K, "read_id")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {i: len(own) for i, s in enumerate(drawn()) if (own := {min(w, other(w)) for w in windows(s)})}
    assert {r["read_id"]: r["n"] for r in got.collect()} == want
