"""An index that is too long to send whole goes by a sieve and a join; it must find what the short one finds, and what plain reading finds."""

import random

import numpy as np
import pytest

from strandframe.operators import recruitment as R

from .test_brute import other


def planted(spark, seed, n=60):
    rng = random.Random(seed)
    draw = lambda m: "".join(rng.choice("ACGT") for _ in range(m))
    loci = [(i, draw(150)) for i in range(12)]
    reads = []
    for i in range(n):
        s = rng.choice(loci)[1][(at := rng.randrange(80)) : at + 70]
        s = rng.choice([s, other(s), draw(70), s[:40] + "N" + s[41:], draw(30) + s])
        reads.append((i, rng.choice([s, s[:10], "", None]) if rng.random() < 0.2 else s))
    return reads, loci, spark.createDataFrame(reads, "read_id long, seq string").repartition(3), spark.createDataFrame(loci, "locus long, seq string")


@pytest.mark.parametrize("k", [11, 31, 32, 48, 65])
def test_sieved_windows_are_those_of_plain_reading(spark, k):
    reads, loci, r, l = planted(spark, k)
    known = {s[i : i + k] for _, q in loci for s in (q, other(q)) for i in range(len(q) - k + 1)}
    want = sorted((n, i, s[i : i + k]) for n, s in reads if s for i in range(len(s) - k + 1) if s[i : i + k] in known)
    index = R.reference_index(l, k)
    assert want
    assert sorted(map(tuple, R.matching_kmers(r, index, l, k, ("read_id",), most=0).collect())) == want
    assert sorted(map(tuple, R.matching_kmers(r, index, l, k, ("read_id",)).collect())) == want


def test_a_crowded_sieve_still_gives_exact_windows(spark, monkeypatch):
    """All bits stand: every window passes the sieve and the join alone decides."""
    monkeypatch.setattr(R, "sieve", lambda index, k, n: np.full(1 << 17, 255, np.uint8))
    _, _, r, l = planted(spark, 5)
    index = R.reference_index(l, 15)
    assert sorted(map(tuple, R.matching_kmers(r, index, l, 15, ("read_id",), most=0).collect())) == sorted(map(tuple, R.matching_kmers(r, index, l, 15, ("read_id",)).collect()))


def test_sieve_of_an_empty_index(spark):
    _, _, r, l = planted(spark, 6)
    assert R.matching_kmers(r, R.reference_index(l.limit(0), 15), l, 15, ("read_id",), most=0).isEmpty()


def test_sieve_lets_little_else_pass(spark):
    """Sixteen bits a k-mer: of random windows fewer than one in eight pass."""
    _, _, _, l = planted(spark, 7)
    index = R.reference_index(l, 21)
    flags = R.sieve(index, 21, 2 * 12 * 150)
    assert 0 < np.unpackbits(flags).sum() <= index.count()
    assert np.unpackbits(flags).mean() < 1 / 8
