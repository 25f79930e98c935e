"""SentencePiece models run by the tokenizers library.

The model's protobuf is read field by field; from it come the normaliser with its table of characters, the metaspace marker,
the pieces with their scores, and the byte fallback. Where no piece holds the marker after another character, a text splits
before every marker that follows another character without changing any encoding, so texts are encoded chunk by chunk, and
every distinct chunk of a task is encoded once, in multithreaded batches. Parity is checked on whole texts.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .support import read

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks whose ids a task keeps; when there are more, it begins anew.
CACHE_CHUNKS = 300_000
#: Chunks that are encoded in one text.
JOINT = 1000
#: Threads of the tokenizers library in each worker.
THREADS = 2
#: Characters of text in one batch of documents.
BATCH_CHARS = 1 << 20


def _fields(data: bytes) -> Iterable[tuple[int, int | bytes]]:
    """The fields of a protobuf message: numbers with varints, or with the bytes of 32 bits, 64 bits or any length."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
            yield tag >> 3, value
            continue
        size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        """Fields that come again, as in joined files, add to those before."""
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                m.pieces.append((got[1].decode(), float(np.frombuffer(got.get(2, bytes(4)), "<f4")[0]), got.get(3, NORMAL)))
            elif number == 2:
                got = dict(_fields(value))
                m.kind, m.suffix_marker, m.byte_fallback = got.get(3, m.kind), bool(got.get(24, m.suffix_marker)), bool(got.get(35, m.byte_fallback))
            elif number == 3:
                got = dict(_fields(value))
                m.charsmap = got.get(2, m.charsmap)
                m.dummy_prefix, m.squeeze, m.escape = (bool(got.get(n, was)) for n, was in ((3, m.dummy_prefix), (4, m.squeeze), (5, m.escape)))
        return m


def charsmap_entries(blob: bytes) -> dict[str, str]:
    """The replacements that a normaliser's table holds: a double-array trie of UTF-8 keys, and the strings that its values point to."""
    if not blob:
        return {}
    size = int(np.frombuffer(blob[:4], "<u4")[0])
    units, strings = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    below = lambda at: at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))
    out: dict[str, str] = {}
    places, keys = np.zeros(1, np.int64), [b""]
    labels = np.arange(1, 256)
    while len(places):
        to = below(places)[:, None] ^ labels
        held = to < len(units)
        held &= (units[np.where(held, to, 0)] & 0x800000FF) == labels
        which, label = np.nonzero(held)
        places, keys = to[which, label], [keys[w] + bytes([c + 1]) for w, c in zip(which.tolist(), label.tolist(), strict=True)]
        for i in np.flatnonzero(units[places] >> 8 & 1).tolist() if len(places) else ():
            begin = int(units[below(places[i : i + 1])[0]] & 0x7FFFFFFF)
            out[keys[i].decode("utf-8", "surrogatepass")] = strings[begin : strings.index(b"\0", begin)].decode("utf-8", "surrogatepass")
    return out


class Normaliser:
    """Replaces the longest keys of a table from left to right, but for the user-defined pieces, which stay as they are."""

    def __init__(self, table: dict[str, str], user: list[str]):
        self.single = str.maketrans({k: v for k, v in table.items() if len(k) == 1})
        self.several = {k: v for k, v in table.items() if len(k) > 1}
        self.longest = max(map(len, self.several), default=0)
        some = lambda at: "[" + "".join(re.escape(c) for c in sorted({k[at] for k in self.several})) + "]"
        self.begins = re.compile(f"{some(0)}(?={some(1)})") if self.several else None
        self.user = re.compile("(" + "|".join(map(re.escape, sorted(user, key=len, reverse=True))) + ")") if user and table else None

    def _replaced(self, text: str) -> str:
        if self.begins is None:
            return text.translate(self.single)
        out, done = [], 0
        for m in self.begins.finditer(text):
            at = m.start()
            key = next((k for n in range(self.longest, 1, -1) if (k := text[at : at + n]) in self.several), None) if at >= done else None
            if key is not None:
                out += [text[done:at].translate(self.single), self.several[key]]
                done = at + len(key)
        return "".join([*out, text[done:].translate(self.single)])

    def __call__(self, text: str) -> str:
        if not self.single and not self.several:
            return text
        if self.user is None:
            return self._replaced(text)
        return "".join(t if i % 2 else self._replaced(t) for i, t in enumerate(self.user.split(text)))


def backend(model: Model):
    """The tokenizers-library tokenizer of a model; it takes texts that are normalised, with the dummy prefix."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the library's threads begin
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        # texts never have pieces of the other kinds: they get names that no text has, and no score that counts
        least = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0)
        listed = [(p if k in (NORMAL, USER, BYTE) else f"\0{i}\0", s if k in (NORMAL, USER) else least) for i, (p, s, k) in enumerate(model.pieces)]
        inner = models.Unigram(listed, unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        usable = {p: i for i, (p, _, k) in enumerate(model.pieces) if k == NORMAL}
        rank = sorted(usable, key=lambda p: (-model.pieces[usable[p]][1], usable[p]))
        merges = [(p[:i], p[i:]) for p in rank for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        inner = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges, unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)  # every chunk comes once
    else:
        raise ValueError(f"model type {model.kind} is not unigram or BPE")
    made = Tokenizer(inner)
    made.normalizer = normalizers.Sequence([normalizers.Replace(" ", MARK)] if model.escape else [])
    made.add_tokens([AddedToken(p, normalized=True, special=False) for p, _, k in model.pieces if k == USER])
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return made


_codecs: dict[tuple[bytes, bool], Codec] = {}


def codec_of(data: bytes, verify: bool) -> Codec:
    """The one codec of a model in this process: a worker that takes another task keeps its tokenizer and its chunks."""
    key = (hashlib.sha256(data).digest(), verify)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, verify)
    return _codecs[key]


def give_back() -> None:
    """Hands freed memory back to the system, where the C library can: workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Codec:
    """Encodes and decodes whole texts with one model."""

    def __init__(self, data: bytes, verify: bool = True):
        self.model = Model.parse(data)
        self.tokenizer = backend(self.model)
        self.user = [p for p, _, k in self.model.pieces if k == USER]
        self.normalised = Normaliser(charsmap_entries(self.model.charsmap), [p.replace(MARK, " ") for p in self.user])
        self.splits = not any(MARK in p.lstrip(MARK) for p, _, k in self.model.pieces if k in (NORMAL, USER)) and not self.model.suffix_marker and self.model.escape
        if self.splits:
            from tokenizers import Regex, pre_tokenizers

            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        self.chunk = re.compile(" *[^ ]+| +" if self.splits else r"(?s).+")
        self.ids: dict[str, bytes] = {}  # of each chunk, as 32-bit integers
        self.words: dict[str, bytes] = {}  # the same of chunks that are a blank and a word, by the word
        self.lossy: set[str] = set()  # chunks that don't come back
        # of how many bytes each piece stands for
        self.size = np.array([1 if k == BYTE else len(p.replace(MARK, " ").encode("utf-8", "surrogatepass")) for p, _, k in self.model.pieces])
        self.is_byte = np.array([k == BYTE for _, _, k in self.model.pieces])
        self.peer = None
        if verify:
            import sentencepiece

            self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)

    def prepared(self, text: str) -> str:
        """The text as it is encoded: normalised, blanks squeezed if the model says so, and the dummy prefix before it, or after it where the marker is a suffix.

        The characters of the marker and the blank are one to a SentencePiece model, but only blanks are squeezed.
        """
        text = self.normalised(text)
        if self.model.squeeze:
            text = re.sub("  +", " ", text.strip(" "))
        if self.model.escape:
            text = text.replace(MARK, " ")
        if text and self.model.dummy_prefix and not self.model.suffix_marker:
            text = f" {text}"
        if self.model.squeeze:
            text = text.rstrip(" ")
        return f"{text} " if text and self.model.dummy_prefix and self.model.suffix_marker else text

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """For each text its ids, whether they are those that the SentencePiece library gives the whole text, and whether they decode to the text."""
        cuts = [self._cut(self.prepared(t)) for t in texts]
        if len(self.ids) + len(self.words) > CACHE_CHUNKS:
            self.ids, self.words, self.lossy = {}, {}, set()
        words: set[str] = set().union(*[c for c, plain in cuts if plain])
        chunks: set[str] = set().union(*[c for c, plain in cuts if not plain])
        new = [w for w in words if w not in self.words]
        self._learn([f" {w}" for w in new] + [c for c in chunks if c not in self.ids])
        for w in new:
            self.words[w] = self.ids[f" {w}"] if f" {w}" in chunks else self.ids.pop(f" {w}")
        word, chunk, lossy = self.words.__getitem__, self.ids.__getitem__, self.lossy
        ids = [np.frombuffer(b"".join(map(word if plain else chunk, c)), np.int32) for c, plain in cuts]
        like = [a.tobytes() == array("i", b).tobytes() for a, b in zip(ids, self.peer.encode(texts, num_threads=1), strict=True)] if self.peer else [True] * len(ids)
        return ids, like, [not lossy or lossy.isdisjoint([f" {x}" for x in c] if plain else c) for c, plain in cuts]

    def _cut(self, text: str) -> tuple[list[str], bool]:
        """The chunks of a text; of one whose blanks all stand alone before a word, just the words, and true."""
        if self.splits and text[:1] == " " and text[-1] != " " and "  " not in text:
            return text[1:].split(" "), True
        return self.chunk.findall(text), False

    def _learn(self, chunks: list[str]) -> None:
        """Encodes new chunks, many in one text where they part again before their blanks."""
        joins = self.splits and not self.user  # a user-defined piece could reach over where chunks meet
        alone = [c for c in chunks if not joins or c[0] != " " or c[-1] == " "]
        joint = [c for c in chunks if joins and c[0] == " " and c[-1] != " "]
        groups = [joint[i : i + JOINT] for i in range(0, len(joint), JOINT)] + [[c] for c in alone]
        for at in range(0, len(groups), 2048):
            part = groups[at : at + 2048]
            texts = ["".join(g) for g in part]
            parted: list[str] = []  # chunks of texts that don't come back whole
            made = self._encoded(texts)
            for group, text, got, back in zip(part, texts, made, self._text(made), strict=True):
                ids = array("i", got)
                if len(group) == 1:
                    self.ids[text] = ids.tobytes()
                    if back != text:
                        self.lossy.add(text)
                    continue
                # pieces and chunks are parts of the same bytes, so sizes tell where a chunk's ids end
                ends = np.cumsum(self.size[np.frombuffer(ids, np.int32)])
                chunk_ends = np.cumsum([len(c) if c.isascii() else len(c.encode("utf-8", "surrogatepass")) for c in group])
                if back != text or not len(ends) or ends[-1] != chunk_ends[-1]:
                    parted += group
                    continue
                flat, begin = ids.tobytes(), 0
                for chunk, end in zip(group, (4 * (np.searchsorted(ends, chunk_ends) + 1)).tolist(), strict=True):
                    self.ids[chunk] = flat[begin:end]
                    begin = end
            if parted:
                self._learn_alone(parted)

    def _learn_alone(self, chunks: list[str]) -> None:
        made = self._encoded(chunks)
        for chunk, got, back in zip(chunks, made, self._text(made), strict=True):
            self.ids[chunk] = array("i", got).tobytes()
            if back != chunk:
                self.lossy.add(chunk)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _text(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts of ids, without the blank that the dummy prefix, or the suffix, has left."""
        if self.model.dummy_prefix and self.model.suffix_marker:
            return [t.removesuffix(" ") for t in self._text(ids)]
        return [t.removeprefix(" ") if self.model.dummy_prefix else t for t in self._text(ids)]


ENCODED = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("n_byte_tokens", T.LongType()), T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType())])


def encoded(df: DataFrame, model: str | bytes, text: str = "text", verify: bool = True) -> DataFrame:
    """df with token_ids, n_tokens, n_byte_tokens (pieces of the byte fallback), parity and round_trip for each whole text.

    parity: the ids are those that the SentencePiece library gives the whole text (null without verify); with a unigram
    model that fails where two splits of a long text are closer than its single-precision sums can tell. round_trip: the
    tokenizers library decodes each of its chunks, once a worker, to the text as the model normalises it. A null text has null ids and zero tokens; an empty one has no ids. Columns of df that
    have one of these names are replaced. The model is a path on the driver, or the file's bytes; it travels by broadcast,
    as its size does not depend on the data.
    """
    data = model if isinstance(model, bytes) else Path(model).read_bytes()
    shared = df.sparkSession.sparkContext.broadcast(data)
    kept = [c for c in df.columns if c not in ENCODED.names]
    df = df.select(*kept)

    def kernel(batches):
        codec = codec_of(shared.value, verify)
        for batch in batches:
            column, at = batch.column(kept.index(text)), 0
            while at < batch.num_rows:
                texts: list[str | None] = []
                size = 0
                while at + len(texts) < batch.num_rows and (not texts or size < BATCH_CHARS):
                    texts.append(column[at + len(texts)].as_py())
                    size += len(texts[-1] or "")
                ids, like, whole = codec.encode([t or "" for t in texts])
                lengths = np.array([len(i) for i in ids])
                flat = np.concatenate(ids)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                n_byte = np.concatenate([[0], np.cumsum(codec.is_byte[flat])])
                absent = [t is None for t in texts]
                out = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(absent)),
                    pa.array(lengths, pa.int64()),
                    pa.array(n_byte[ends[1:]] - n_byte[ends[:-1]], pa.int64()),
                    pa.array([p if verify and not a else None for p, a in zip(like, absent, strict=True)], pa.bool_()),
                    pa.array([None if a else w for w, a in zip(whole, absent, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, *out], names=[*kept, *ENCODED.names])
                at += len(texts)
            give_back()

    return df.mapInArrow(kernel, T.StructType([*df.schema.fields, *ENCODED.fields]))


def decoded(df: DataFrame, model: str | bytes, ids: str = "token_ids", name: str = "text") -> DataFrame:
    """df with the column name: the texts that the ids stand for; null for null ids, empty for none."""
    data = model if isinstance(model, bytes) else Path(model).read_bytes()
    shared = df.sparkSession.sparkContext.broadcast(data)
    kept = [c for c in df.columns if c != name]
    df = df.select(*kept)

    def kernel(batches):
        codec = codec_of(shared.value, False)
        for batch in batches:
            column = batch.column(kept.index(ids)).to_pylist()
            back = codec.decode([i or [] for i in column])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if i is None else b for i, b in zip(column, back, strict=True)], pa.string())], names=[*kept, name])

    return df.mapInArrow(kernel, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


#: A public tokenizer's model; a parameter of everything here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
