"""K-mers of up to 31 bases as numbers, worked out for whole batches of reads, so that only counts become rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .recruitment import _CODED as CODED
from .recruitment import PIECE_BASES, sieved_codes, window_codes, window_pieces


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts, one after the other, and where each begins and the last ends; nulls are empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def other_codes(code: np.ndarray, k: int) -> np.ndarray:
    """The codes of the other strand."""
    x = ~code.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = (x >> np.uint64(shift)) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(shift)
    return (x.byteswap() >> np.uint64(64 - 2 * k)).astype(np.int64)


def _codes(text: np.ndarray, ends: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of all unambiguous windows and the row of each, piece by piece."""
    for begin, piece in window_pieces(text, k):
        code, clean = window_codes(piece, k)
        at = np.flatnonzero(clean)
        row = np.searchsorted(ends, at + begin, "right") - 1
        inside = at + begin + k <= ends[row + 1]
        yield code[at[inside]], row[inside]


def _row_pieces(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of so many bases at most; a longer row is a range of its own."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE_BASES, "right")) - 1)
        yield at, to
        at = to


def decoded(code: np.ndarray, k: int) -> list[str]:
    letters = np.frombuffer(b"ACGT", np.uint8)[(code[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]
    flat = letters.astype(np.uint8).tobytes().decode()
    return [flat[i : i + k] for i in range(0, len(flat), k)]


def encoded(kmer: str) -> int:
    """The code of one k-mer of bases."""
    return int(kmer.translate(_DIGITS), 4)


_DIGITS = str.maketrans("ACGT", "0123")


def stored(values: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes: their width, then the first byte of all, the second of all and so on, so that a shuffle's compression finds what is alike."""
    values = np.ascontiguousarray(values, np.int64)
    wide = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + values.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def restored(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.int64).ravel()


#: An odd number, so that to multiply by it deals codes evenly and can be undone.
_DEAL = 0x9E3779B97F4A7C15


def _dealt(code: np.ndarray, k: int, factor: int = _DEAL) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(factor)) & np.uint64((1 << 2 * k) - 1)).astype(np.int64)


#: Parts that counted codes are dealt to, as bits; a part of all k-mers is one group.
PART_BITS = 8


def packed_counts(code: np.ndarray, group: np.ndarray, n: np.ndarray, k: int, bits: int = PART_BITS) -> pa.RecordBatch:
    """Rows (part, groups, sizes, codes, counts), one for each part: codes with the number that each has in a group, by group, as steps from one to the next.

    A code then takes some four bytes of a shuffle, where a row of its own takes nine or more and is sorted one by one.
    """
    bits = min(bits, 2 * k)
    mixed = _dealt(code, k)
    part = mixed >> (2 * k - bits)
    order = np.argsort(mixed) if len(group) and group.min() == group.max() else np.lexsort((mixed, group, part))
    mixed, group, part, n = mixed[order], group[order], part[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (mixed[1:] != mixed[:-1]) | (group[1:] != group[:-1])])[: len(mixed)])
    n = np.add.reduceat(n, new) if len(new) else n
    mixed, group, part = mixed[new], group[new], part[new]
    ends = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]), len(part)).tolist()
    rows: list[list] = [[], [], [], [], []]
    for a, b in zip(ends, ends[1:], strict=False):
        runs = np.flatnonzero(np.concatenate([[True], group[a + 1 : b] != group[a : b - 1]]))
        steps = np.diff(mixed[a:b], prepend=0)
        steps[runs] = mixed[a:b][runs]
        for column, value in zip(rows, (int(part[a]), stored(group[a:b][runs]), stored(np.diff(np.append(runs, b - a))), stored(steps), stored(n[a:b])), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["part", "groups", "sizes", "codes", "counts"])


PACKED = "part int, groups binary, sizes binary, codes binary, counts binary"


def unpacked(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, group, n) of rows of packed_counts, sorted by code, then by group; what several rows have of both is summed."""
    found = []
    for groups, sizes, codes, counts in zip(*(table.column(c).to_pylist() for c in ("groups", "sizes", "codes", "counts")), strict=True):
        size, step = restored(sizes), restored(codes)
        total = np.cumsum(step)
        begins = np.cumsum(size) - size
        base = total[begins] - step[begins]
        found.append((total - np.repeat(base, size), np.repeat(restored(groups), size), restored(counts)))
    mixed, group, n = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    del found
    order = np.argsort(mixed, kind="stable") if len(group) and group.min() == group.max() else np.lexsort((group, mixed))
    mixed, group, n = mixed[order], group[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (mixed[1:] != mixed[:-1]) | (group[1:] != group[:-1])])[: len(mixed)])
    n = np.add.reduceat(n, new) if len(new) else n
    return _dealt(mixed[new], k, pow(_DEAL, -1, 1 << 64)), group[new], n


def shared_codes(reads: DataFrame, k: int, least: int, flags: np.ndarray, strands: str = "own") -> DataFrame:
    """Rows (group, code, n): in how many rows of reads (group, seq), group a number, each k-mer is, where all groups have it in at least so many or the flags of a code_sieve let it pass.

    What too few reads have is dropped where its counts meet, before it becomes a row.
    """
    shared = reads.sparkSession.sparkContext.broadcast(flags)

    def kernel(batches):
        for batch in batches:
            group = batch.column(0).to_numpy()
            for code, row, _ in distinct_codes(batch, 1, k, strands):
                yield packed_counts(code, group[row], np.ones(len(code), np.int64), k)

    def meet(table: pa.Table) -> pa.Table:
        code, group, n = unpacked(table, k)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
        each = np.diff(np.append(first, len(code)))
        total = np.repeat(np.add.reduceat(n, first), each) if len(first) else n
        at = np.flatnonzero((total >= least) | sieved_codes(code, shared.value))
        return pa.table({"group": group[at], "code": code[at], "n": n[at]})

    return reads.select("group", "seq").mapInArrow(kernel, PACKED).groupBy("part").applyInArrow(meet, "group long, code long, n long")


#: The same where all k-mers of all reads are counted.
COUNT_BITS = 10


def occurrences(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """Rows (code, n): how often each canonical k-mer stands in reads (seq, ...), of those that do at least so often. Every piece of a batch is counted before anything is shuffled, packed, and what is too seldom never becomes a row."""

    def kernel(batches):
        for batch in batches:
            for own, _ in _codes(*texts(batch.column(0)), k):
                code, n = np.unique(np.minimum(own, other_codes(own, k)), return_counts=True)
                yield packed_counts(code, np.zeros_like(code), n.astype(np.int64), k, COUNT_BITS)

    def meet(table: pa.Table) -> pa.Table:
        code, _, n = unpacked(table, k)
        at = np.flatnonzero(n >= least)
        return pa.table({"code": code[at], "n": n[at]})

    return reads.select("seq").mapInArrow(kernel, PACKED).groupBy("part").applyInArrow(meet, "code long, n long")


def distinct_codes(batch: pa.RecordBatch, column: int, k: int, strands: str = "canonical") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, rows, n) of a batch's texts, some rows at a time: each code of a row once, with how often it stands there.

    strands: "canonical" codes, "own" as they stand, or "both" strands.
    """
    text, ends = texts(batch.column(column))
    for at, to in _row_pieces(ends):
        found = list(_codes(text[ends[at] : ends[to]], ends[at : to + 1] - ends[at], k))
        code, row = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        if strands == "canonical":
            code = np.minimum(code, other_codes(code, k))
        elif strands == "both":
            code, row = np.concatenate([code, other_codes(code, k)]), np.concatenate([row, row])
        order = np.lexsort((code, row))
        code, row = code[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])[: len(code)])
        yield code[first], row[first] + at, np.diff(np.append(first, len(code)))


def own_codes(reads: DataFrame, k: int, keys: list[str], strands: str = "canonical", flags: np.ndarray | None = None) -> DataFrame:
    """Rows (keys, code, n): how often each k-mer stands in each row of reads (keys, seq); with the flags of a code_sieve only those that it lets pass."""
    shared = None if flags is None else reads.sparkSession.sparkContext.broadcast(flags)

    def kernel(batches):
        for batch in batches:
            for code, row, n in distinct_codes(batch, len(keys), k, strands):
                if shared is not None:
                    at = np.flatnonzero(sieved_codes(code, shared.value))
                    code, row, n = code[at], row[at], n[at]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in batch.columns[: len(keys)]], pa.array(code), pa.array(n.astype(np.int64))], names=[*keys, "code", "n"])

    schema = T.StructType([*[reads.schema[c] for c in keys], T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    return reads.select(*keys, "seq").mapInArrow(kernel, schema)


def placed_codes(reads: DataFrame, k: int, keys: list[str], flags: np.ndarray | None = None) -> DataFrame:
    """Rows (keys, pos, code) of every k-mer of reads (keys, seq) as it stands; with the flags of a code_sieve only those that it lets pass."""
    shared = None if flags is None else reads.sparkSession.sparkContext.broadcast(flags)

    def kernel(batches):
        for batch in batches:
            text, ends = texts(batch.column(len(keys)))
            for begin, piece in window_pieces(text, k):
                code, clean = window_codes(piece, k)
                at = np.flatnonzero(clean)
                if shared is not None:
                    at = at[sieved_codes(code[at], shared.value)]
                code, at = code[at], at + begin
                row = np.searchsorted(ends, at, "right") - 1
                inside = at + k <= ends[row + 1]
                code, at, row = code[inside], at[inside], row[inside]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in batch.columns[: len(keys)]], pa.array(at - ends[row]), pa.array(code)], names=[*keys, "pos", "code"])

    schema = T.StructType([*[reads.schema[c] for c in keys], T.StructField("pos", T.LongType()), T.StructField("code", T.LongType())])
    return reads.select(*keys, "seq").mapInArrow(kernel, schema)


def distinct_counts(reads: DataFrame, k: int, key: str) -> DataFrame:
    """Rows (key, n): how many different canonical k-mers each row of reads (key, seq) has; rows without any are left out."""

    def kernel(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for _, row, _ in distinct_codes(batch, 1, k):
                n += np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=[key, "n"])

    return reads.select(key, "seq").mapInArrow(kernel, T.StructType([reads.schema[key], T.StructField("n", T.LongType())])).where("n > 0")


def read_depths(reads: DataFrame, k: int, keys: list[str], strands: str = "canonical") -> DataFrame:
    """A2: rows (keys, code, depth): in how many rows of reads (keys, seq) each k-mer is. Reads of the same keys are counted together before anything is shuffled."""

    def kernel(batches):
        for batch in batches:
            group = np.zeros(batch.num_rows, np.int64)
            for column in batch.columns[: len(keys)]:
                own = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
                group = np.unique(np.stack([group, own]), axis=1, return_inverse=True)[1].ravel() if len(keys) > 1 else own
            for code, row, _ in distinct_codes(batch, len(keys), k, strands):
                order = np.lexsort((code, group[row]))
                code, row = code[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (group[row[1:]] != group[row[:-1]])])[: len(code)])
                out = [c.take(pa.array(row[first])) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*out, pa.array(code[first]), pa.array(np.diff(np.append(first, len(code))).astype(np.int64))], names=[*keys, "code", "n"])

    schema = T.StructType([*[reads.schema[c] for c in keys], T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    return reads.select(*keys, "seq").mapInArrow(kernel, schema).groupBy(*keys, "code").agg(F.sum("n").alias("depth"))
