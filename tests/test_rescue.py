"""counts of k-mers are shuffled packed, once for reads of the same loci, and a locus's graph is sorted codes."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandframe.operators import graphs as G
from strandframe.operators import packed
from strandframe.operators.recruitment import code_sieve

from .test_brute import other

K = 7


def test_packed_counts_come_back_summed_and_small():
    rng = np.random.default_rng(5)
    for k in (3, 21, 31):
        want, tables = Counter(), []
        for _ in range(3):
            code, group = rng.integers(0, min(4**k, 5000), 9000) * (4**k // 5001 or 1) % 4**k, rng.choice([0, 7, 1 << 40], 9000)
            n = rng.integers(1, 300, 9000)
            for c, g, x in zip(code.tolist(), group.tolist(), n.tolist(), strict=True):
                want[c, g] += x
            tables.append(pa.Table.from_batches([packed.packed_counts(code, group, n, k)]))
        code, group, n = packed.unpacked(pa.concat_tables(tables), k)
        assert dict(zip(zip(code.tolist(), group.tolist(), strict=True), n.tolist(), strict=True)) == want
    none = np.zeros(0, np.int64)
    assert packed.packed_counts(none, none, none, 21).num_rows == 0 and len(packed.unpacked(pa.Table.from_batches([packed.packed_counts(none, none, none, 21)]), 21)[0]) == 0
    dense = np.sort(rng.choice(1 << 26, 1 << 20, replace=False)).astype(np.int64)
    assert packed.packed_counts(dense, np.zeros_like(dense), np.ones_like(dense), 13).nbytes < 5 * len(dense)


def drawn():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    passages = [text(40) for _ in range(4)]
    seqs = [text(20) + passages[i % 4] + text(20) for i in range(24)] + ["", None, "ACGTN", "N" * 20]
    found = [(i, loc) for i in range(len(seqs)) for loc in range(5) if (i % 4 + loc) % 3 == 0 or i == loc]
    return list(enumerate(seqs)), found


def test_repeated_depths_add_up_to_those_of_every_locus(spark):
    seqs, found = drawn()
    reads, pairs = spark.createDataFrame(seqs, "read_id long, seq string"), spark.createDataFrame(found, "read_id long, locus long")
    kept = packed.own_codes(reads.where("read_id < 3"), K, ["read_id"], "own").select("code").distinct()
    want, text = defaultdict(Counter), dict(seqs)
    for i, locus in found:
        want[locus].update({s for j in range(len(text[i] or "") - K + 1) if "N" not in (s := text[i][j : j + K])})
    flags = {packed.decoded(np.array([r["code"]]), K)[0] for r in kept.collect()}
    got = defaultdict(Counter)
    rows = G.repeated_depths(reads, pairs, K, kept).collect()
    for r in rows:
        got[r["locus"]][packed.decoded(np.array([r["code"]]), K)[0]] += r["n"]
    for locus, depth in want.items():
        assert all(got[locus][x] == d for x, d in depth.items() if d >= 2 or x in flags)
        assert all(depth[x] == d for x, d in got[locus].items() if d)
    assert len(rows) < sum(map(len, want.values()))


def test_coded_contigs_are_those_of_texts(spark):
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(300))
    texts = [(1, i, seq[i : i + 90]) for i in range(0, 210, 15)] + [(2, i, other(seq[i : i + 90])) for i in range(0, 210, 30)] + [(2, 90, seq[:90])]
    depth = defaultdict(Counter)
    for locus, _, s in texts:
        depth[locus].update(s[i : i + 21] for i in range(len(s) - 20))
    ref = spark.createDataFrame([(locus, i, seq[100 + i : 121 + i]) for locus in (1, 2, 3) for i in range(40)], "locus long, pos int, kmer string")
    near = {x.kmer for x in ref.collect()}
    kmers = spark.createDataFrame([(locus, x, d) for locus, own in depth.items() for x, d in own.items() if d >= 2 or x in near], "locus long, kmer string, depth long")
    codes = spark.createDataFrame([(locus, packed.encoded(x), 1) for locus, own in depth.items() for x, d in own.items() for _ in range(d)], "locus long, code long, n long")
    want = {tuple(r) for r in G.contigs(kmers, ref, "locus").collect()}
    assert want and {tuple(r) for r in G.coded_contigs(codes, ref, "locus", 21).collect()} == want


def test_sorted_codes_as_a_mapping():
    depth = {"ACGTA": 3, "TACGT": 5, "GGGCA": 2}
    own = G.CodedDepths(np.array([packed.encoded(x) for x in depth]), np.array(list(depth.values())), 5)
    both = dict(depth)
    for x, d in depth.items():
        both.setdefault(other(x), d)
    assert dict(own.items()) == both and len(own) == len(both) and "AAAAA" not in own and own.get("AAAAA", 0) == 0
    with pytest.raises(KeyError):
        own["AAAAA"]


def test_rescue_shuffles_no_kmer_by_locus_before_it_is_shared(spark):
    """Before, every k-mer of every read of a locus was a row of the shuffle."""
    seqs, found = drawn()
    reads, pairs = spark.createDataFrame(seqs, "read_id long, seq string"), spark.createDataFrame(found, "read_id long, locus long")
    kept = spark.createDataFrame([(1,)], "code long")
    plan = G.repeated_depths(reads, pairs, K, kept)._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "HashAggregate" not in plan
    flags = code_sieve(kept, 1)
    own = reads.selectExpr("read_id % 3 AS `group`", "seq")
    assert packed.shared_codes(own, K, 99, flags).count() <= 2
