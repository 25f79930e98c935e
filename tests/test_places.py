"""Counts of aligned places against a plain walk along every CIGAR."""

import random
import re
from collections import Counter

import pytest

from strandframe.operators import places as P
from strandframe.operators import variants as V

SCHEMA = "qname string, flag int, ref string, pos int, cigar string, seq string"


def plain(rows, most=150):
    out = Counter()
    for _, flag, ref, pos, cigar, seq in rows:
        if flag is None or flag & 2308 or cigar in (None, "*") or pos is None:
            continue
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHPX=])", cigar)]
        gapped, q, r = any(o == "D" and n > most for n, o in ops), 0, pos
        for n, o in ops:
            for i in range(n):
                if o in "M=X" and seq is not None:
                    out[ref, r + i, seq[q + i : q + i + 1].upper()] += 1
                elif o == "D" and not gapped:
                    out[ref, r + i, "-"] += 1
            q += n if o in "MIS=X" else 0
            r += n if o in "MDN=X" else 0
    return out


def reads(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ops = [(rng.randrange(1, 30), rng.choice("MMMM=XIDNSHP")) for _ in range(rng.randrange(1, 7))]
        if rng.random() < 0.1:
            ops.append((200, "D"))
        length = sum(k for k, o in ops if o in "MIS=X")
        seq = "".join(rng.choice("ACGTNacgt") for _ in range(length))
        rows.append((f"q{i}", rng.choice([0, 0, 16, 4, 256, 2048, None]), rng.choice(["a", "b", "b", None]), rng.choice([1, 5, 40, 10_000_000, None]), "".join(f"{k}{o}" for k, o in ops), seq))
    return rows + [("x", 0, "a", 3, "*", "ACGT"), ("y", 0, "a", 3, None, "ACGT"), ("z", 0, "a", 3, "2M1D2M", None), ("w", 0, "a", 3, "9M", "ACGT"), ("v", 0, "a", 3, "0M3M", "acg"), ("u", 0, "c", 1, "3M", "")]


@pytest.mark.parametrize("at_once", [4_000_000, 7])
def test_counts_equal_a_plain_walk(spark, monkeypatch, at_once):
    rows = reads(at_once)
    if at_once == 7:
        rows = rows[:60] + rows[-6:]
    monkeypatch.setattr(P, "PLACES_AT_ONCE", at_once)
    got = P.base_counts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {(r["ref"], r["pos"], r["base"]): r["n"] for r in got} == dict(plain(rows)) and len(got) == len(plain(rows))


def test_a_table_without_rows_gives_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert V.pileup(P.base_counts(none)).isEmpty() and V.insertion_columns(V.inserted_motifs(none)).isEmpty()


def test_insertions_stand_before_their_place(spark):
    rows = [("a", 0, "r", 10, "2S3M2I4M1I2M", "TTACGGGTTTTCAA"), ("b", 4, "r", 10, "3M2I3M", "ACGGGTTT"), ("c", 0, "r", 10, "8M", "ACGGGTTT")]
    got = V.inserted_motifs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["pos"], r["motif"]) for r in got) == [(13, "GG"), (17, "C")]
