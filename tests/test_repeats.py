"""reads meet families by classes of k-mers, and no table of k-mers is sent whole."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import packed
from strandframe.operators import repeats as R

from .test_brute import other

K = 7


def drawn(repeated=False):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    passages = [text(60) for _ in range(3)]
    seqs = [text(rng.randrange(30)) + (p if i % 2 else other(p)) + text(rng.randrange(30)) for i in range(10) for p in passages] + ["", None, "ACGTN", "N" * 20]
    return [("s", i // 2 if repeated else i, s) for i, s in enumerate(seqs)]


def canonical(s):
    return {min(w, other(w)) for i in range(len(s or "") - K + 1) if "N" not in (w := s[i : i + K])}


@pytest.mark.parametrize("repeated", [False, True])
def test_depths_of_families_are_those_of_all_their_reads(spark, repeated):
    rows = drawn(repeated)
    reads = spark.createDataFrame(rows, "sample string, read long, seq string")
    pairs = [("s", r, f) for r in {r for _, r, _ in rows} for f in ("x", "y", "z") if (r + len(f) * ord(f)) % 3]
    counted = packed.occurrences(reads, K).where("n >= 3")
    got = R.family_depths(reads, spark.createDataFrame(pairs, "sample string, read long, family string"), counted, K, 3, 0.2)
    texts, depth, many = defaultdict(list), Counter(), Counter(f for _, _, f in pairs)
    for _, r, s in rows:
        texts[r].append(s)
    for _, r, f in pairs:
        for s in texts[r]:
            depth.update((f, x) for x in canonical(s))
    want = {(f, x): (n, many[f]) for (f, x), n in depth.items() if n >= 3 and n >= 0.2 * many[f]}
    assert want and {(r["family"], packed.decoded(np.array([r["code"]]), K)[0]): (r["depth"], r["reads"]) for r in got.collect()} == want


def test_codes_of_places_and_sieves(spark):
    from strandframe.operators.recruitment import code_sieve

    reads = spark.createDataFrame(drawn(), "sample string, read long, seq string")
    want = {(r, i, s[i : i + K]) for _, r, s in drawn() for i in range(len(s or "") - K + 1) if "N" not in s[i : i + K]}
    name = lambda rows: {(r["read"], r["pos"], packed.decoded(np.array([r["code"]]), K)[0]) for r in rows}
    every = packed.placed_codes(reads, K, ["read"])
    assert name(every.collect()) == want
    known = every.where("code % 5 = 0").select("code").distinct()
    passed = packed.placed_codes(reads, K, ["read"], code_sieve(known, known.count()))
    assert name(passed.where("code % 5 = 0").collect()) == name(every.where("code % 5 = 0").collect())
    assert passed.count() < every.count()


def test_reads_are_aligned_without_sending_kmers_whole(spark):
    """Before, every place of every consensus was sent to all executors, as its size was taken for that of the library's file."""
    reads = spark.createDataFrame(drawn(), "sample string, read long, seq string")
    seqs = [s for _, _, s in drawn()[:4]]
    ways = [("a", 0, seqs[0]), ("a", 1, seqs[3]), ("b", 0, seqs[1]), ("c", 0, seqs[0][:50])]
    got = R.aligned_back(reads, spark.createDataFrame(ways, "family string, path int, seq string"), K)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert sum("SortMergeJoin" in line for line in plan.splitlines()) >= 3
    assert not any("Broadcast" in line and ("code" in line or "class" in line) for line in plan.splitlines())
    want = {}
    for _, read, s in drawn():
        for family in "abc":
            lines = Counter()
            for f, path, text in ways:
                for strand, t in enumerate((text, other(text))):
                    if f == family:
                        lines.update((path, strand, j - i) for i in range(len(s or "") - K + 1) for j in range(len(t) - K + 1) if "N" not in s[i : i + K] and s[i : i + K] == t[j : j + K])
            if lines:
                path, strand, shift = min(lines, key=lambda x: (-lines[x], x))
                text = next(t for f, p, t in ways if (f, p) == (family, path))
                text = other(text) if strand else text
                pairs = [(s[i], text[i + shift]) for i in range(len(s)) if 0 <= i + shift < len(text)]
                same, cover = sum(a == b for a, b in pairs) / len(pairs), len(pairs) / min(len(s), len(text))
                if same >= 0.8 and cover >= 0.6:
                    want[read, family] = (round(same, 9), round(cover, 9))
    assert len(want) > 10 and {(r["read"], r["family"]): (round(r["identity"], 9), round(r["coverage"], 9)) for r in got.select("*", F.lit(1)).collect()} == want


def test_few_edges_are_joined_in_one_task(spark, monkeypatch):
    """before, chains of k-mers took rounds of many small jobs, however few they were."""
    from strandframe.operators import graphs as G

    rng = random.Random(6)
    names = [rng.randrange(1 << 50) for _ in range(400)]
    edges = list(zip(names[:300], names[1:301], strict=True)) + [(names[i], names[i + 7]) for i in range(320, 390)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = sorted(map(tuple, G.components(df, rounds=0).collect()))
    assert G.components(spark.createDataFrame([], "a long, b long"), rounds=0).isEmpty()
    monkeypatch.setattr(G, "ONE_TASK_EDGES", -1)
    assert got and got == sorted(map(tuple, G.components(df).collect()))


def test_periods_and_counts_of_batches_are_those_of_expressions(spark):
    """before, a period was worked out by an expression of k * k / 2 steps for each k-mer, and each count was a row of its own."""
    from strandframe.functions import sequence as S

    rng = random.Random(9)
    kmers = {"".join(rng.choice("ACGT") for _ in range(n)) * 25 for n in (1, 2, 3, 5, 8, 12, 13, 30)}
    kmers = {x[:25] for x in kmers} | {x[:11] + "A" + x[12:25] for x in kmers}
    df = spark.createDataFrame([(x, 1) for x in kmers], "kmer string, n long")
    assert {(r.kmer, r.period) for r in R.with_periods(df).collect()} == {(r.kmer, r.p) for r in df.selectExpr("kmer", f"{S.period('kmer')} AS p").collect()}
    assert R.with_periods(df.where("n > 1")).isEmpty()
    reads = spark.createDataFrame(drawn(), "sample string, read long, seq string")
    want = Counter(min(w, other(w)) for _, _, s in drawn() for i in range(len(s or "") - K + 1) if "N" not in (w := s[i : i + K]))
    for least in (1, 3):
        got = {packed.decoded(np.array([r["code"]]), K)[0]: r["n"] for r in packed.occurrences(reads, K, least).collect()}
        assert got == {x: n for x, n in want.items() if n >= least}
