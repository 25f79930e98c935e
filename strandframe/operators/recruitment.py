"""Recruitment of reads to loci by shared k-mers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import canonical, kmers, reverse_complement


def reference_index(loci: DataFrame, k: int) -> DataFrame:
    """Rows (kmer, canonical, locus, orient): every k-mer of a locus on both strands, so that read k-mers join as they stand; orient has bit 1 for the forward and bit 2 for the other strand."""
    own = kmers(loci.select("locus", "seq"), k)
    both = own.select("locus", F.expr(canonical("kmer")).alias("canonical"), F.explode(F.expr(f"array(struct(kmer AS k, 1 AS o), struct({reverse_complement('kmer')} AS k, 2 AS o))")).alias("x"))
    return both.groupBy(F.col("x.k").alias("kmer"), "canonical", "locus").agg(F.bit_or("x.o").alias("orient"))


#: K-mers of an index that are sent to every executor; beyond, the join is left to the planner.
BROADCAST_KMERS = 1_000_000


def sized(index: DataFrame, loci: DataFrame, most: int = BROADCAST_KMERS) -> DataFrame:
    """index, to be broadcast if the k-mers of both strands of loci are few enough; a sum of lengths tells before anything is built."""
    bases = loci.agg(F.sum(F.length("seq"))).first()[0] or 0
    return F.broadcast(index) if 2 * bases <= most else index


#: Codes of the bases, and 4 for any other character.
_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
#: Bits of the hashed map that is asked before the sorted codes.
_PROBE_BITS = 24


def window_codes(text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """F5 for every window of a byte array: its code of two bits a base, and whether it has bases only. k is 31 at most."""
    base = _CODES[text]
    n = len(text) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    code, width = (base & 3).astype(np.int64), 1
    out, done = np.zeros(n, np.int64), 0
    rest = k
    while rest:  # windows of 1, 2, 4 ... bases, put together by the bits of k
        if rest & 1:
            out = out << (2 * width) | code[done : done + n]
            done += width
        rest >>= 1
        if rest:
            code, width = code[:-width] << (2 * width) | code[width:], 2 * width
    wrong = np.concatenate([[0], np.cumsum(base == 4)])
    return out, wrong[k:] == wrong[:-k]


#: Bases that are encoded at once; each takes some 70 bytes of a worker's memory, however many rows a batch has.
PIECE_BASES = 1 << 20


def window_pieces(text: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(begin, piece) of pieces of a byte array that overlap by k - 1 bytes: every window of k lies in one of them."""
    for begin in range(0, max(1, len(text) - k + 1), PIECE_BASES):
        yield begin, text[begin : begin + PIECE_BASES + k - 1]


def _hashed(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PROBE_BITS)


#: Bits of a sieve: sixteen for each k-mer of the index, but never more than this, which is 128 MB in a worker.
SIEVE_BITS = 30
#: Bits of one block of a sieve, which a single row holds.
_BLOCK_BITS = 20
#: Bases whose code fits a number.
_CODED = 31


def _window_hashes(text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every window of k bases by the codes of its first and its last bases, 31 at most, and whether it has bases only."""
    part = min(k, _CODED)
    code, _ = window_codes(text, part)
    n = max(0, len(text) - k + 1)
    wrong = np.concatenate([[0], np.cumsum(_CODES[text] == 4)])
    clean = wrong[k:] == wrong[:-k] if n else np.zeros(0, bool)
    mixed = code[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if k > part:
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ code[k - part : k - part + n].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32)), clean


def sieve(index: DataFrame, k: int, kmers_at_most: int) -> np.ndarray:
    """A bit for every hash of the k-mers of index. Executors fill its blocks; the driver gets these, of a size that SIEVE_BITS bounds whatever the index holds."""

    def hashes(column: pa.Array) -> np.ndarray:
        return _window_hashes(np.frombuffer("".join(column.to_pylist()).encode(), np.uint8), k)[0][::k]

    return _filled(index.select("kmer").where("kmer IS NOT NULL"), hashes, kmers_at_most)


def code_sieve(codes: DataFrame, codes_at_most: int) -> np.ndarray:
    """The same of codes (code)."""
    return _filled(codes.select("code"), lambda column: _mixed(column.to_numpy()), codes_at_most)


def sieved_codes(code: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which codes a code_sieve lets pass: all that it was made of, and a few more."""
    place = _mixed(code) >> np.uint64(65 - (8 * len(flags)).bit_length())
    return (flags[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1


def _mixed(code: np.ndarray) -> np.ndarray:
    mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(32))


def _filled(rows: DataFrame, hashes: Callable[[pa.Array], np.ndarray], at_most: int) -> np.ndarray:
    """The bits of the hashes of the first column of rows."""
    bits = min(SIEVE_BITS, max(_BLOCK_BITS, int(16 * max(1, at_most)).bit_length()))

    def places(batches):
        for batch in batches:
            at = np.unique(hashes(batch.column(0)) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> _BLOCK_BITS), pa.array(at & ((1 << _BLOCK_BITS) - 1))], names=["block", "bit"])

    def blocks(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(block).tolist():
                own.setdefault(b, np.zeros(1 << _BLOCK_BITS, bool))[bit[block == b]] = True
        for b, flags in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["block", "flags"])

    filled = rows.mapInArrow(places, "block long, bit long").repartition("block").mapInArrow(blocks, "block long, flags binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in filled.toLocalIterator():
        at = row["block"] << (_BLOCK_BITS - 3)
        out[at : at + (1 << (_BLOCK_BITS - 3))] |= np.frombuffer(row["flags"], np.uint8)
    return out


def _passing(reads: DataFrame, keys: tuple[str, ...], k: int, test) -> DataFrame:
    """Rows (keys, pos, kmer) of the windows of reads (keys, seq) that test(text) leaves; it gives the places in a piece of a batch's bytes."""

    def kernel(batches):
        leaves = test()
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(len(keys))
            if column.null_count:
                column = column.fill_null("")
            ends = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.string() else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            text = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            for begin, piece in window_pieces(text, k):
                at = leaves(piece) + begin
                row = np.searchsorted(ends, at, "right") - 1
                within = at + k <= ends[row + 1]
                at, row = at[within], row[within]
                if not len(at):
                    continue
                found = np.lib.stride_tricks.sliding_window_view(text, k)[at].tobytes()
                windows = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(found)])
                out = [c.take(pa.array(row)) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*out, pa.array(at - ends[row], pa.int32()), windows], names=[*keys, "pos", "kmer"])

    schema = T.StructType([*[reads.schema[c] for c in keys], T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.StringType())])
    return reads.select(*keys, "seq").mapInArrow(kernel, schema)


def _sieved(reads: DataFrame, index: DataFrame, bases: int, k: int, keys: tuple[str, ...]) -> DataFrame:
    """Rows (keys, pos, kmer) of the windows of reads that a sieve of index lets pass: all that stand in it, and a few more."""
    flags = reads.sparkSession.sparkContext.broadcast(sieve(index, k, 2 * bases))
    shift = np.uint64(65 - (8 * len(flags.value)).bit_length())

    def sieved():
        bits = flags.value

        def leaves(text):
            hashes, clean = _window_hashes(text, k)
            at = np.flatnonzero(clean)
            place = hashes[at] >> shift
            return at[(bits[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1]

        return leaves

    return _passing(reads, keys, k, sieved)


def indexed_kmers(reads: DataFrame, index: DataFrame, loci: DataFrame, k: int, keys: tuple[str, ...], most: int = BROADCAST_KMERS) -> DataFrame:
    """matching_kmers joined with index (kmer, more). Where a sieve goes before, one join both decides and gives the index's columns."""
    bases = loci.agg(F.sum(F.length("seq"))).first()[0] or 0
    if 2 * bases > most or k > _CODED:
        return _sieved(reads, index, bases, k, keys).hint("merge").join(index, "kmer")
    return matching_kmers(reads, index, loci, k, keys, most).join(F.broadcast(index), "kmer")


def matching_kmers(reads: DataFrame, index: DataFrame, loci: DataFrame, k: int, keys: tuple[str, ...], most: int = BROADCAST_KMERS) -> DataFrame:
    """Rows (keys, pos, kmer) of the windows of reads (keys, seq) whose k-mer stands in index (kmer, more).

    Whole batches of reads are encoded at once and only what matches becomes a row. Where the k-mers of both strands of loci
    are few enough, their codes go to every executor: a hashed map is asked first, sorted codes decide. A longer index, or one
    of over 31 bases, sends a sieve of bounded size instead; what passes is joined with the index, which decides.
    """
    bases = loci.agg(F.sum(F.length("seq"))).first()[0] or 0
    if 2 * bases > most or k > _CODED:
        return _sieved(reads, index, bases, k, keys).hint("merge").join(index.select("kmer").distinct().hint("merge"), "kmer", "left_semi").select(*keys, "pos", "kmer")
    listed = [r["kmer"].encode() for r in index.select("kmer").distinct().collect()]
    codes = np.unique(window_codes(np.frombuffer(b"".join(listed), np.uint8), k)[0][::k]) if listed else np.zeros(0, np.int64)
    shared = reads.sparkSession.sparkContext.broadcast(codes)

    def exact():
        known = shared.value
        probe = np.zeros(1 << _PROBE_BITS, bool)
        probe[_hashed(known)] = True

        def leaves(text):
            code, clean = window_codes(text, k)
            if not len(known):
                return np.zeros(0, np.int64)
            at = np.flatnonzero(clean & probe[_hashed(code)])
            place = np.minimum(np.searchsorted(known, code[at]), len(known) - 1)
            return at[known[place] == code[at]]

        return leaves

    return _passing(reads, keys, k, exact)


def hits(reads: DataFrame, loci: DataFrame, k: int, step: int = 1, keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """Rows (keys, locus, shared): how many distinct canonical k-mers each read shares with each locus.

    With a step, every step-th window is looked up and always the last.
    """
    index = reference_index(loci, k)
    own = matching_kmers(reads.withColumn("_n", F.length("seq")), index, loci, k, (*keys, "_n"))
    if step > 1:
        own = own.where(f"pos % {step} = 0 OR pos = _n - {k}")
    return own.join(sized(index, loci), "kmer").groupBy(*keys, "locus").agg(F.countDistinct("canonical").alias("shared"))


def read_counts(found: DataFrame, weight: int = 1) -> DataFrame:
    """A1: reads by locus; loci without any are left out."""
    return found.groupBy("locus").agg((F.count("*") * weight).alias("reads"), F.sum("shared").alias("shared"))


def tiered(reads: DataFrame, loci: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Each tier's shorter k-mers are for reads without a hit in the tiers before."""
    out, left = None, reads
    for k in ks:
        found = hits(left, loci, k).withColumn("k", F.lit(k))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("read_id").distinct(), "read_id", "left_anti")
    return out


def sibling_hits(direct: DataFrame, cap: int) -> DataFrame:
    """Of the direct hits of each arm the first cap, in order of reads, also count for the other arm of their locus.

    direct: rows (read_id, locus, arm) with arms 1 and 2.
    """
    first = direct.withColumn("_r", F.row_number().over(Window.partitionBy("locus", "arm").orderBy("read_id"))).where(F.col("_r") <= cap).drop("_r")
    return first.unionByName(first.withColumn("arm", 3 - F.col("arm"))).distinct()


def orientation(mates: DataFrame, loci: DataFrame, k: int) -> DataFrame:
    """Rows (fragment, locus, o1, o2): the strands on which each mate has a k-mer of the locus, 0 to 3."""
    index = reference_index(loci, k)
    found = matching_kmers(mates, index, loci, k, ("fragment", "mate")).join(sized(index, loci), "kmer")
    by_mate = lambda m: F.coalesce(F.bit_or(F.when(F.col("mate") == m, F.col("orient"))), F.lit(0))
    return found.groupBy("fragment", "locus").agg(by_mate(1).alias("o1"), by_mate(2).alias("o2"))


def linked_pairs(oriented: DataFrame) -> DataFrame:
    """A fragment goes where neither mate matches or both lie on one and the same strand."""
    return oriented.where("NOT (o1 = o2 AND o1 IN (0, 1, 2))")


def match_spans(reads: DataFrame, loci: DataFrame, k: int) -> DataFrame:
    """Rows (read_id, locus, strand, diagonal, start, length): maximal exact matches of at least k bases.

    Windows that match on one diagonal and follow one another are one match; both strands of the locus are searched.
    """
    strands = loci.selectExpr("locus", "1 AS strand", "seq").unionByName(loci.selectExpr("locus", "2 AS strand", f"{reverse_complement('seq')} AS seq"))
    there = kmers(strands, k).withColumnRenamed("pos", "ref_pos")
    here = matching_kmers(reads, there, loci, k, ("read_id",))
    seeds = here.join(sized(there, loci), "kmer").select("read_id", "locus", "strand", (F.col("pos") - F.col("ref_pos")).alias("diagonal"), "pos")
    w = Window.partitionBy("read_id", "locus", "strand", "diagonal").orderBy("pos")
    islands = seeds.withColumn("island", F.col("pos") - F.row_number().over(w))
    return islands.groupBy("read_id", "locus", "strand", "diagonal", "island").agg(F.min("pos").alias("start"), (F.count("*") + k - 1).alias("length")).drop("island")


def longest_match(spans: DataFrame) -> DataFrame:
    """The longest match of each read in each locus; ties by strand, then by start in the locus, then in the read."""
    best = F.max_by(F.struct("strand", "start", "length", "diagonal"), F.struct(F.col("length"), -F.col("strand"), -(F.col("start") - F.col("diagonal")), -F.col("start")))
    return spans.groupBy("read_id", "locus").agg(best.alias("b")).select("read_id", "locus", "b.strand", F.col("b.start").alias("read_start"), (F.col("b.start") - F.col("b.diagonal")).alias("ref_start"), "b.length")


def unique_votes(reads: DataFrame, loci: DataFrame, k: int) -> DataFrame:
    """Votes for the forward and the other strand by k-mers that occur once in a locus, both its strands together."""
    strands = loci.selectExpr("locus", "1 AS strand", "seq").unionByName(loci.selectExpr("locus", "2 AS strand", f"{reverse_complement('seq')} AS seq"))
    once = kmers(strands, k).groupBy("locus", "kmer").agg(F.count("*").alias("n"), F.min("strand").alias("strand")).where("n = 1")
    found = matching_kmers(reads, once, loci, k, ("read_id",)).join(sized(once, loci), "kmer")
    return found.groupBy("read_id", "locus").agg(F.count_if(F.expr("strand = 1")).alias("forward"), F.count_if(F.expr("strand = 2")).alias("reverse"))
