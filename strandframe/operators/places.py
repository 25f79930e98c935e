"""Aligned places of SAM rows, added up by whole batches before anything becomes a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import texts

#: Places that are laid out at a time, so that long reads take no more memory than short ones.
PLACES_AT_ONCE = 4_000_000
#: Operations by whether they go along the read, along the reference, and give places.
_READ, _REFERENCE, _BASES = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"MIS=X", b"MDN=X", b"M=X"))
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


def operations(cigars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """F20 for a whole column: the row, the length and the letter of every operation."""
    text, ends = texts(cigars)
    digit = (text >= 48) & (text <= 57)
    at = np.flatnonzero(~digit)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    begin = np.concatenate([[0], at[:-1] + 1])
    length, value, power = at - begin, np.zeros(len(at), np.int64), 1
    for d in range(int(length.max(initial=0))):  # the d-th digit from the right of every number at once
        has = length > d
        value[has] += (text[at[has] - 1 - d].astype(np.int64) - 48) * power
        power *= 10
    return np.searchsorted(ends, at, "right") - 1, value, text[at]


def _starts(row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the operations of the same row add up to before each."""
    before = np.cumsum(n) - n
    first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    return before - np.maximum.accumulate(np.where(first, before, 0)) if len(row) else before


def base_counts(alignments: DataFrame, max_deletion: int = 150) -> DataFrame:
    """Rows (ref, pos, base, n) of every aligned base and every deleted place (base -) of alignments (flag, ref, pos, cigar, seq).

    Unmapped, secondary and supplementary records go, and those without place or operations. A read with a deletion longer
    than allowed has no deleted places, one without a sequence no bases; a place beyond its end has the empty base. The places
    of a batch are added up by numpy, so a deep place sends one row for each batch and base.
    """

    def kernel(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ref = batch.column(0).dictionary_encode(null_encoding="encode")
            code, pos = ref.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            text, ends = texts(batch.column(3))
            silent = batch.column(3).is_null().to_numpy(zero_copy_only=False)
            row, n, op = operations(batch.column(2))
            q, r = _starts(row, n * _READ[op]), _starts(row, n * _REFERENCE[op]) + pos[row]
            gapped = np.zeros(batch.num_rows, bool)
            gapped[row[(op == 68) & (n > max_deletion)]] = True
            taken = np.flatnonzero((_BASES[op] & ~silent[row] | (op == 68) & ~gapped[row]) & (n > 0))
            # one long operation is laid out in parts
            parts = (n[taken] + PLACES_AT_ONCE - 1) // PLACES_AT_ONCE
            piece = np.repeat(taken, parts)
            offset = _starts(piece, np.ones(len(piece), np.int64)) * PLACES_AT_ONCE
            size = np.minimum(n[piece] - offset, PLACES_AT_ONCE)
            turn = np.cumsum(size) // PLACES_AT_ONCE
            for t in np.unique(turn):
                own = turn == t
                p, s, o = piece[own], size[own], offset[own]
                within = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(o, s)
                p = np.repeat(p, s)
                at = ends[row[p]] + q[p] + within
                base = np.where(op[p] == 68, 45, np.where(at < ends[row[p] + 1], _UPPER[text[np.minimum(at, len(text) - 1)]] if len(text) else 0, 0)).astype(np.int64)
                place = r[p] + within
                low, span = place.min(), int(place.max() - place.min() + 1)
                if (int(code.max()) + 1) * span < 1 << 54:
                    key, count = np.unique((code[row[p]] * span + place - low) << 8 | base, return_counts=True)
                    where, place, base = key >> 8, (key >> 8) % span + low, key & 255
                    which = where // span
                else:
                    key, count = np.unique(np.stack([code[row[p]], place, base]), axis=1, return_counts=True)
                    which, place, base = key
                letters = pa.array([chr(b) if b else "" for b in range(256)]).take(pa.array(base))
                yield pa.RecordBatch.from_arrays([ref.dictionary.take(pa.array(which)), pa.array(place), letters, pa.array(count.astype(np.int64))], names=["ref", "pos", "base", "n"])

    kept = alignments.where("(flag & 2308) = 0 AND cigar <> '*' AND pos IS NOT NULL").select("ref", "pos", "cigar", "seq")
    schema = T.StructType([kept.schema["ref"], T.StructField("pos", T.LongType()), T.StructField("base", T.StringType()), T.StructField("n", T.LongType())])
    return kept.mapInArrow(kernel, schema).groupBy("ref", F.col("pos").cast("int").alias("pos"), "base").agg(F.sum("n").alias("n"))
