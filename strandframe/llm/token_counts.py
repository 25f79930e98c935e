"""Token counts of the sections of a document, from one encoding of the whole document.

The tokens of a byte-level vocabulary stand for consecutive bytes, so their lengths give every token's span of characters.
Spans meet sections in an interval join over sorted ends. A token that crosses the edge of a section counts by a rule:
"start" gives it to the section of its first character; "share" divides it among sections by its characters in each, and is
given beside the rule in any case, as its sums add up to the tokens of a document whose sections cover it.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .support import read

#: A public tokenizer's ranks, and the pattern that splits a text before the merges; both are parameters.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "share")


class Encoder:
    """A byte-level vocabulary, and the number of bytes of each of its tokens."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.sizes = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.sizes[rank] = len(token)

    def spans(self, text: str, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters [start, end) that hold the bytes of each token."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.sizes[ids])
        chars = np.cumsum((data & 0xC0) != 0x80)
        return chars[ends - self.sizes[ids]] - 1, chars[ends - 1]


def lines_of(data: np.ndarray) -> np.ndarray:
    """The sections of a text by default: its lines, each with its line break. An empty text is one empty section."""
    if not len(data):
        return np.zeros((1, 2), np.int64)
    chars = np.cumsum((data & 0xC0) != 0x80)
    ends = chars[np.flatnonzero(data == 10)]
    if not len(ends) or ends[-1] < chars[-1]:
        ends = np.append(ends, chars[-1])
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)


def attributed(sections: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """For each section [a, b) the tokens it gets by each rule, and how many tokens that touch it cross one of its edges."""
    a, b = sections[:, 0], sections[:, 1]

    def inside(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token that x parts, and whether there is one."""
        t = np.minimum(np.searchsorted(ends, x, "right"), max(0, len(ends) - 1))
        return t, (starts[t] < x) & (x < ends[t]) if len(ends) else np.zeros(len(x), bool)

    left, parted_left = inside(a)
    right, parted_right = inside(b)
    some = b > a
    crossing = np.where(some, parted_left.astype(np.int64) + parted_right - (parted_left & parted_right & (left == right)), 0)

    def up_to(x: np.ndarray, t: np.ndarray, parted: np.ndarray) -> np.ndarray:
        whole = np.searchsorted(ends, x, "right").astype(float)
        return whole + (np.where(parted, (x - starts[t]) / (ends[t] - starts[t]), 0) if len(ends) else 0)

    return {
        "start": np.where(some, np.searchsorted(starts, b) - np.searchsorted(starts, a), 0).astype(float),
        "share": np.where(some, up_to(b, right, parted_right) - up_to(a, left, parted_left), 0.0),
        "crossing": crossing,
    }


def _listed(entries) -> tuple[np.ndarray, np.ndarray]:
    """The sections of an array of structs, and which of them have both bounds; the others stand as empty ones."""
    bounds = [(s["start"], s["end"]) if s is not None else (None, None) for s in entries or []]
    known = np.array([a is not None and b is not None for a, b in bounds], bool)
    return np.array([(a, b) if k else (0, 0) for (a, b), k in zip(bounds, known, strict=True)], np.int64).reshape(-1, 2), known


SECTION = T.StructType([T.StructField(n, k) for n, k in (("section", T.IntegerType()), ("char_start", T.LongType()), ("char_end", T.LongType()), ("n_tokens", T.DoubleType()), ("n_shared", T.DoubleType()), ("n_crossing", T.LongType()))])


def section_counts(docs: DataFrame, ranks: str | bytes = RANKS, id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "start", pattern: str = PATTERN) -> DataFrame:
    """Rows (id, section, char_start, char_end, n_tokens, n_shared, n_crossing): one for each section of each row of docs; n_tokens by the rule, n_shared by shares.

    sections names a column of arrays of structs (start, end) in characters, which may overlap, leave gaps or lie beyond
    the text; without it the sections are the lines. Null and empty texts have no tokens: by lines they are one empty
    section. A null array of sections has no rows; a null entry, or one with a null bound, keeps its number and has null
    bounds and no tokens. Repeated rows stay repeated. Only the columns named are read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}, not {rule}")
    data = ranks if isinstance(ranks, bytes) else Path(ranks).read_bytes()
    shared = docs.sparkSession.sparkContext.broadcast(data)  # a vocabulary: its size does not depend on the documents

    def kernel(batches):
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            rows, numbers, made = [], [], []
            for i, value in enumerate(batch.column(1)):
                string = value.as_py() or ""
                raw = np.frombuffer(string.encode("utf-8", "surrogatepass"), np.uint8)
                if sections is None:
                    own = lines_of(raw)
                    known = np.ones(len(own), bool)
                else:
                    own, known = _listed(batch.column(2)[i].as_py())
                starts, ends = encoder.spans(string, raw) if len(raw) else (np.zeros(0, np.int64),) * 2
                got = attributed(own, starts, ends)
                rows.append(np.full(len(own), i))
                numbers.append(np.arange(len(own)))
                made.append((own[:, 0], own[:, 1], got[rule], got["share"], got["crossing"], known))
                if len(made) == 4096 or i == batch.num_rows - 1:
                    *columns, known = [np.concatenate(c) for c in zip(*made, strict=True)]
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                    masks = [~known, ~known, None, None, None]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(numbers), pa.int32()), *[pa.array(c, k, mask=m) for c, k, m in zip(columns, kinds, masks, strict=True)]], names=[id, *SECTION.names]
                    )
                    rows, numbers, made = [], [], []

    wanted = docs.select(id, text, *([sections] if sections else []))
    return wanted.mapInArrow(kernel, T.StructType([docs.schema[id], *SECTION.fields]))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_counts(read(spark, sf_dir, "documents"))
