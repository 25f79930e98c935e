"""Benchmark passages in training documents, found with an FM-index over each shard of documents.

A shard is a part of one Arrow batch of documents; its index holds all words of their texts, so it answers for any phrase.
The windows of the benchmark are searched backwards, all of them at once, through the ranks of a wavelet matrix; rows of the
suffix array are taken to text positions by stepping to the nearest sampled suffix; and the positions that occurrences cover
merge into spans.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import read, unused, written

WINDOW = 10
#: Words of benchmark text in one block of windows; a larger benchmark is searched block by block, each in a pass of its own.
BLOCK_WORDS = 250_000
#: Words in one index; more text of a batch goes to further indexes, and a longer text is cut into parts that overlap by a window.
INDEX_WORDS = 1 << 20
SAMPLE = 16
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_upper = re.compile("[A-Z]")

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The distinct windows of some items: their words by number, and flat arrays of the items that own each."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = WINDOW):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        rows, owners, named = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for item, text in items:
            code = np.fromiter(map(numbers.__getitem__, words_of(text)), np.int32)
            if len(code):
                whole = np.pad(code, (0, max(0, width - len(code))), constant_values=-1)
                rows.append(np.lib.stride_tricks.sliding_window_view(whole, width))
                owners.append(np.full(len(rows[-1]), item or 0, np.int64))
                named.append(np.full(len(rows[-1]), item is not None))  # an item with a null id owns nothing
        self.words = list(numbers)
        self.codes, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.codes >= 0).sum(axis=1)
        pairs = np.unique(np.stack([of.ravel(), np.concatenate(owners)], axis=1)[np.concatenate(named)], axis=0)
        self.items, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.codes) + 1))


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, from the highest, packed bits with counts before every 64."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.packed, self.before, self.zeros = [], [], []
        n = len(text)
        for level in reversed(range(self.levels)):
            bit = (text >> level & 1).astype(bool)
            packed = np.packbits(np.pad(bit, (0, -n % 64 + 64)), bitorder="little").view(np.uint64)
            self.packed.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            text = np.concatenate([text[~bit], text[bit]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level][block] + np.bitwise_count(self.packed[level][block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first at symbols are the given ones."""
        begin, end = np.zeros_like(at), at
        for level in range(self.levels):
            bit = (symbols >> (self.levels - 1 - level) & 1).astype(bool)
            for_begin, for_end = self.ones(level, begin), self.ones(level, end)
            begin = np.where(bit, self.zeros[level] + for_begin, begin - for_begin)
            end = np.where(bit, self.zeros[level] + for_end, end - for_end)
        return end - begin

    def symbol(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros_like(at)
        for level in range(self.levels):
            bit = (self.packed[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self.ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            found = found << 1 | bit
        return found


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """The order of the suffixes of a text of numbers below sigma whose last symbol is its only 0.

    The first pass sorts by three symbols, each later one by twice as many as the pass before, and only what is not yet
    apart: a suffix's rank is the place of the first one that is still like it.
    """
    n, bits = len(text), int(sigma - 1).bit_length()
    key = text.astype(np.int64)
    step = 1
    for more in (1, 2):
        if (more + 1) * bits <= 62:
            key = key << bits
            key[: n - more] |= text[more:]
            step = more + 1
    order = np.argsort(key)
    rank = np.empty(n, np.int64)

    def apart(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Sets the ranks of the suffixes in these places by their sorted keys; gives the places that are still alike."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        head = np.maximum.accumulate(np.where(new, places, 0))
        rank[order[places]] = head
        alone = new & np.concatenate([new[1:], [True]])
        return places[~alone]

    left = apart(np.arange(n), key[order])
    while len(left):
        suffix = order[left]
        keys = rank[suffix] * (n + 1) + np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
        by = np.argsort(keys)
        order[left] = suffix[by]
        left = apart(left, keys[by])
        step *= 2
    return order


class FMIndex:
    """An FM-index of an integer text whose last symbol is the only 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_array(text, sigma)
        self.wavelet = Wavelet(text[order - 1].astype(np.int32), sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)]).astype(np.int32)
        self.samples = order[self.sampled]
        self.n = len(text)

    def search(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the rows [low, high) of the suffixes that begin with it, all stepped back together."""
        low, high = np.zeros(len(codes), np.int64), np.full(len(codes), self.n, np.int64)
        for back in range(codes.shape[1]):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                break
            c = codes[live, lengths[live] - 1 - back]
            low[live], high[live] = self.first[c] + self.wavelet.rank(c, low[live]), self.first[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows."""
        found, row, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[row[live]]
            at = live[done]
            found[at] = self.samples[self.sample_rank[row[at]]] + steps
            live = live[~done]
            c = self.wavelet.symbol(row[live])
            row[live] = self.first[c] + self.wavelet.rank(c, row[live])
            steps += 1
        return found


class Shard:
    """All words of some documents with an FM-index over them. Each document ends with a symbol of its own."""

    def __init__(self, documents: list[list[bytes]]):
        ends = len(documents) + 1  # 0 ends the text, then one number for each document's end, then the words
        numbers: dict[bytes, int] = defaultdict(count(ends).__next__)
        sizes = [len(d) + 1 for d in documents]
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        text = np.zeros(int(self.begins[-1]) + 1, np.int32)
        for i, d in enumerate(documents):
            at = int(self.begins[i])
            text[at : at + len(d)] = np.fromiter(map(numbers.__getitem__, d), np.int32, len(d))
            text[at + len(d)] = i + 1
        self.numbers = dict(numbers)
        self.index = FMIndex(text, ends + len(numbers))

    def occurrences(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Which window stands where: numbers of windows and their places in the shard's text. Windows with a word that the shard lacks are not searched."""
        known = np.array([self.numbers.get(w, -1) for w in windows.words] + [0], np.int64)  # -1, the filling, looks up the last
        codes = known[windows.codes]
        some = np.flatnonzero((codes >= 0).all(axis=1))
        low, high = self.index.search(codes[some], windows.lengths[some])
        many = high - low
        which = np.repeat(np.arange(len(some)), many)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        return some[which], self.index.locate(low[which] + offset)

    def hits(self, windows: Windows) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        """By document the spans that windows cover and the items that own a window in it."""
        which, at = self.occurrences(windows)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        if not len(which):
            return spans, items
        cover = np.zeros(int(self.begins[-1]) + 2, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + windows.lengths[which], -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8))).reshape(-1, 2)
        of = np.searchsorted(self.begins, edge[:, 0], "right") - 1
        for doc, start, end in zip(of.tolist(), (edge[:, 0] - self.begins[of]).tolist(), (edge[:, 1] - self.begins[of]).tolist(), strict=True):
            spans.setdefault(doc, []).append((start, end))
        for doc, x in np.unique(np.stack([np.searchsorted(self.begins, at, "right") - 1, which], axis=1), axis=0).tolist():
            items.setdefault(doc, set()).update(windows.items[windows.first[x] : windows.first[x + 1]].tolist())
        return spans, items


def searched(texts: list[str | None], windows: Windows, index_words: int | None = None) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
    """For each text its number of words, the merged spans that windows cover, and the items with a window in it."""
    most, overlap = index_words or INDEX_WORDS, windows.codes.shape[1] - 1
    n_words = [0] * len(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    pending: list[tuple[int, int, list[bytes]]] = []
    held = 0

    def search() -> None:
        nonlocal held
        if pending and len(windows.codes):
            found, owned = Shard([p for _, _, p in pending]).hits(windows)
            for k, some in found.items():
                doc, first, _ = pending[k]
                spans[doc] += [(first + a, first + b) for a, b in some]
                items[doc] |= owned[k]
        pending.clear()
        held = 0

    for doc, text in enumerate(texts):
        words = words_of(text)
        n_words[doc] = len(words)
        for at in range(0, max(1, len(words) - overlap), most):
            part = words[at : at + most + overlap]
            if held + len(part) > most:
                search()
            pending.append((doc, at, part))
            held += len(part)
    search()
    return n_words, [merged(s) for s in spans], items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id: str, text: str, words: int, width: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of a bounded number of words; a longer item is cut into parts that overlap, so that each window stands in one."""
    held: list[tuple[int | None, str | None]] = []
    n = 0
    for row in benchmark.select(F.col(id).cast("long"), F.col(text)).toLocalIterator():
        code = words_of(row[1])
        for at in range(0, max(1, len(code) - width + 1), words):
            part = code[at : at + words + width - 1]
            if held and n + len(part) > words:
                yield held
                held, n = [], 0
            held.append((row[0], b" ".join(part).decode("utf-8", "surrogatepass")))
            n += len(part)
    if held:
        yield held


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, width: int, block_words: int) -> tuple[DataFrame, tuple[str, str, str]]:
    """docs with three columns, and their names: number of words, merged spans, ids of items.

    Each block of the benchmark is broadcast and searched in a pass of its own. Where there are several, what a pass has
    found is written before the next one, and its broadcast is given up, so neither the driver nor an executor ever holds
    more than one block.
    """
    context = docs.sparkSession.sparkContext
    names = docs.columns
    own = tuple(unused(docs, n) for n in ("_n_words", "_spans", "_items"))
    fields = [T.StructField(own[0], T.LongType()), T.StructField(own[1], SPANS), T.StructField(own[2], T.ArrayType(T.LongType()))]
    schema = T.StructType([*docs.schema.fields, *fields])

    def kernel(block, first: bool) -> Callable:
        def run(batches):
            windows = Windows(block.value, width)
            for batch in batches:
                n_words, spans, items = searched(batch.column(names.index(text)).to_pylist(), windows)
                if not first:
                    before = [batch.column(len(names) + i).to_pylist() for i in (1, 2)]
                    spans = [merged([*s, *[(x["start"], x["end"]) for x in b]]) for s, b in zip(spans, before[0], strict=True)]
                    items = [i | set(b) for i, b in zip(items, before[1], strict=True)]
                out = [pa.array(n_words, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _ARROW_SPANS), pa.array([sorted(i) for i in items], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *out], names=[*names, *own])

        return run

    out, last = docs, None
    for block in _blocks(benchmark, item_id, item_text, block_words, width):
        if last is not None:
            out = written(out, "searched")
            last.destroy()
        before, last = last, context.broadcast(block)
        out = out.mapInArrow(kernel(last, before is None), schema)
    if last is None:
        out = docs.mapInArrow(kernel(context.broadcast([]), True), schema)
    return out, own


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with _n_words, _spans (merged word spans [start, end) that windows cover) and _items (ids of items with windows in the text, sorted).

    Where docs has columns of these names, more underscores go before the new ones; they are the last three.
    """
    return _passes(docs, benchmark, text, item_id, item_text, width, block_words)[0]


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Null and empty texts have no words and no hits. An item without words has no window; items with a null id hit words
    but are not listed; repeated items count once by id. Repeated documents stay repeated. Empty tables are fine on
    either side. Only id and text are read, so other columns may have any name.
    """
    found = with_hits(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), benchmark, width=width)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("id").alias(id), F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"), F.col("_spans").alias("spans")
    )


def without(text: str, spans: list[dict[str, int]]) -> str:
    """A text without the words of some spans, and without what stands between words of one span."""
    at = [m.span() for m in WORD.finditer(_upper.sub(lambda m: m.group().lower(), text))]
    kept, done = [], 0
    for s in spans:
        kept.append(text[done : at[s["start"]][0]])
        done = at[s["end"] - 1][1]
    return "".join([*kept, text[done:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", policy: str = "drop", width: int = WINDOW) -> DataFrame:
    """docs without the benchmark's windows: policy "drop" leaves hit documents out, "cut" takes their merged spans out.

    Both keep the columns of docs, whatever their names; "cut" sets n_chars anew where docs has it. Documents without a
    hit stay as they are.
    """
    if policy not in ("drop", "cut"):
        raise ValueError(f"policy is drop or cut, not {policy}")
    found, (_, spans, _) = _passes(docs, benchmark, text, "item_id", "text", width, BLOCK_WORDS)
    names = docs.columns
    if policy == "drop":
        return found.where(F.size(spans) == 0).select(*names)

    def kernel(batches):
        for batch in batches:
            texts, hits = batch.column(names.index(text)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            out = [without(t, s) if s else t for t, s in zip(texts, hits, strict=True)]
            columns = dict(zip(names, batch.columns, strict=False)) | {text: pa.array(out, batch.schema.field(text).type)}
            if "n_chars" in columns:
                counts = [len(t) if s else n for t, s, n in zip(out, hits, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return found.mapInArrow(kernel, docs.schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


OP8_SQL = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
asked AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT item_id, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS phrase, {WINDOW} AS n FROM (SELECT item_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM asked WHERE len(words) >= {WINDOW})
  UNION SELECT item_id, array_to_string(words, ' '), len(words) FROM asked WHERE len(words) BETWEEN 1 AND {WINDOW - 1}),
sizes AS (SELECT DISTINCT n FROM windows),
here AS (
  SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM split JOIN sizes ON len(words) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM here JOIN windows USING (phrase, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
