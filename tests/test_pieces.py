"""Batches are worked on piece by piece: the same k-mers, whatever a piece's length, and no memory in proportion to a batch."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from strandframe.operators import packed, recruitment

from .test_brute import other

K = 5


def drawn():
    rng = random.Random(5)
    return ["".join(rng.choice("ACGTN") if rng.random() < 0.2 else rng.choice("ACGT") for _ in range(n)) for n in (0, 3, 5, 40, 7, 200, 0, 33, 4)] + [None]


def windows(s):
    return [w for i in range(len(s or "") - K + 1) if "N" not in (w := s[i : i + K])]


def batch_of(seqs):
    return pa.RecordBatch.from_arrays([pa.array(range(len(seqs))), pa.array(seqs, pa.string())], names=["key", "seq"])


@pytest.mark.parametrize("most", [1, 2, 7, 50, 1 << 20])
def test_distinct_codes_of_pieces(monkeypatch, most):
    monkeypatch.setattr(recruitment, "PIECE_BASES", most)
    monkeypatch.setattr(packed, "PIECE_BASES", most)
    seqs = drawn()
    for strands, of in (("own", lambda w: [w]), ("canonical", lambda w: [min(w, other(w))]), ("both", lambda w: [w, other(w)])):
        want = Counter((x, i) for i, s in enumerate(seqs) for w in windows(s) for x in of(w))
        got = Counter()
        for code, row, n in packed.distinct_codes(batch_of(seqs), 1, K, strands):
            for x, i, m in zip(packed.decoded(code, K), row.tolist(), n.tolist(), strict=True):
                assert (x, i) not in got
                got[x, i] = m
        assert got == want


@pytest.mark.parametrize("most", [1, 3, 60])
def test_windows_of_pieces(monkeypatch, most):
    monkeypatch.setattr(recruitment, "PIECE_BASES", most)
    text = np.frombuffer("".join(s or "" for s in drawn()).encode(), np.uint8)
    got = [begin + i for begin, piece in recruitment.window_pieces(text, K) for i in np.flatnonzero(recruitment.window_codes(piece, K)[1]).tolist()]
    assert got == np.flatnonzero(recruitment.window_codes(text, K)[1]).tolist()


def test_recruitment_takes_a_batch_in_pieces(spark):
    """The places handed to one test are bounded, whatever a batch holds."""
    most = recruitment.PIECE_BASES + K - 1
    calls, over = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    reads = spark.range(100).selectExpr("id AS read_id", "concat(repeat('A', 40000), 'CGTT', repeat('G', id)) AS seq").coalesce(1)

    def test():
        def leaves(text):
            calls.add(1)
            over.add(len(text) > most)
            return np.flatnonzero(recruitment.window_codes(text, K)[0] == 0b0001101111)

        return leaves

    found = recruitment._passing(reads, ("read_id",), K, test).collect()
    assert calls.value >= 4 and over.value == 0
    assert sorted(map(tuple, found)) == [(i, 39_999, "ACGTT") for i in range(100)]


def test_depths_of_groups(spark):
    reads = [("a", s) for s in drawn()] + [("b", s) for s in drawn()[:5]] + [(None, "ACGTACGT")]
    want = Counter((g, x) for g, s in reads for x in {min(w, other(w)) for w in windows(s)})
    got = packed.read_depths(spark.createDataFrame(reads, "g string, seq string").coalesce(1), K, ["g"]).collect()
    assert {(r["g"], packed.decoded(np.array([r["code"]]), K)[0]): r["depth"] for r in got} == want


def test_solid_minimizers_send_no_kmers_whole(spark):
    from strandframe.operators import evidence

    seqs = [s for s in drawn() if s] + ["ACGTACGTNACGTT", "ACGTACGT"]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read long, seq string")
    got = evidence.solid_minimizers(reads, ("read",), K, 3)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    every = Counter(min(w, other(w)) for s in seqs for w in windows(s))
    solid = {i: [x for w in windows(s) if every[x := min(w, other(w))] >= 3] for i, s in enumerate(seqs)}
    assert {r["read"]: r["minimizer"] for r in got.collect()} == {i: min(own) for i, own in solid.items() if own}


@pytest.mark.parametrize("repeated", [False, True])
def test_solid_kmers_are_counted_before_the_shuffle(spark, repeated):
    """no row for each k-mer of a read is shuffled; an id of several rows still counts once."""
    from strandframe.operators import graphs

    seqs = [(i // 2 if repeated else i, s) for i, s in enumerate(drawn())]
    reads = spark.createDataFrame(seqs, "read_id long, seq string").coalesce(1)
    want = Counter(x for _, x in {(i, x) for i, s in seqs for w in windows(s) for x in (w, other(w))})
    got = graphs.solid_kmers(reads, K, 2)
    assert {r["kmer"]: r["depth"] for r in got.collect()} == {x: n for x, n in want.items() if n >= 2}
    assert ("MapInArrow" in got._jdf.queryExecution().toString()) is not repeated


@pytest.mark.parametrize("repeated", [False, True])
def test_recruited_depths(spark, repeated):
    """reads of a locus are counted before the shuffle, as they stand."""
    from strandframe.operators import graphs

    seqs = [(i // 2 if repeated else i, s) for i, s in enumerate(drawn())]
    found = [(i, locus) for i in range(10) for locus in (1, 2) if (i + locus) % 3]
    got = graphs.recruited_depths(spark.createDataFrame(seqs, "read_id long, seq string"), spark.createDataFrame(found, "read_id long, locus long"), K)
    want = Counter((locus, x) for locus, _, x in {(locus, i, w) for i, s in seqs for j, locus in found if j == i for w in windows(s)})
    assert {(r["locus"], r["kmer"]): r["depth"] for r in got.collect()} == want
    assert ("MapInArrow" in got._jdf.queryExecution().toString()) is not repeated


class _Columns:
    """A table of reads that keeps the kernel it is given, so that a test can run it in its own process."""

    def __init__(self, spark, schema):
        self.sparkSession, self.schema = spark, schema

    def select(self, *columns):
        return self

    def mapInArrow(self, kernel, schema):
        return kernel


def peak_of(kernel, batch):
    """Most bytes that Python and NumPy take beside the batch, and the rows that come out."""
    sum(b.num_rows for b in kernel([batch.slice(0, 1)]))
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in kernel([batch]))
        return tracemalloc.get_traced_memory()[1], rows
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_recruiting_takes_no_memory_in_proportion_to_a_batch(spark, most):
    """Exact codes (most 1,000,000) and a sieve (0) both take a batch of 24 MB with little more than one of 6 MB."""
    k, locus = 21, "ACGGTCATTGCAAGTCCATGACCTGA"
    loci = spark.createDataFrame([(1, locus)], "locus long, seq string")
    reads = _Columns(spark, T.StructType([T.StructField("read_id", T.LongType()), T.StructField("seq", T.StringType())]))
    index = recruitment.reference_index(loci, k)
    if most:
        kernel = recruitment.matching_kmers(reads, index, loci, k, ("read_id",), most)
    else:
        kernel = recruitment._sieved(reads, index, len(locus), k, ("read_id",))
    rng = random.Random(3)
    own = "".join(rng.choices("ACGT", k=20_000 - len(locus))) + locus
    peaks = []
    for n in (300, 1200):
        peak, rows = peak_of(kernel, batch_of([own] * n))
        own_rows = n * (len(locus) - k + 1)
        assert rows == own_rows if most else rows >= own_rows  # a sieve lets a few more pass
        peaks.append(peak)
    assert peaks[1] < 1.2 * peaks[0] and peaks[1] < 160 << 20
