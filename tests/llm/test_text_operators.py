"""Fixtures small enough for brute force, with the odd rows that every operator must take."""

import re

import numpy as np
import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "the quick brown fox jumps over a lazy dog while rain falls on the old stone bridge near town " * 3
TEXTS = [
    (1, LONG + "alpha"),
    (2, LONG + "alpha"),
    (3, LONG + "beta"),
    (4, ""),
    (5, None),
    (6, "   \t\n"),
    (7, "ÀÉ unique Words HERE with accents Straße ﬁ"),
    (8, "one two"),
    (9, " ".join(f"w{i * 7919 % 1000}" for i in range(60_000))),
    (9, " ".join(f"w{i * 7919 % 1000}" for i in range(60_000))),
    (None, "no id here but text"),
    (11, "x" * 20_000),
]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names that operators use inside."""
    rows = [(i, t, "en", f"src{k % 3}", len(t) if t else None, 0, "x", k, "y") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, id string, key int, component_id string").repartition(3)


def empty(df):
    return df.where("false")


def test_simhash_equals_brute_force(docs):
    import xxhash

    from strandframe.llm.simhash import near_duplicates

    prints = []
    for _, t in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i in range(len(TEXTS)):
            for j in range(len(TEXTS)):
                if bin(prints[i] ^ prints[j]).count("1") <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    expected = sorted(((i, f"{p:016x}", min((TEXTS[k][0] for k in range(len(TEXTS)) if root[k] == root[n] and TEXTS[k][0] is not None), default=None)) for n, ((i, _), p) in enumerate(zip(TEXTS, prints, strict=True))), key=str)
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == expected
    assert near_duplicates(empty(docs)).count() == 0


def test_masks_cover_and_crowded_buckets_are_exact(spark):
    from strandframe.llm.simhash import deeper, linked_classes, masks
    from strandframe.llm.support import connected_components

    rng = np.random.default_rng(1)
    levels = [masks(3)]
    levels += [deeper(levels[0], 3)]
    levels += [deeper(levels[1], 3)]
    for level, family in enumerate(levels, 1):
        assert len(family) == 15**level and max(64 - m.bit_count() for m in family) <= 64 >> level
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not m & flips for m in family)
    centre = int(rng.integers(-(2**62), 2**62))
    prints = sorted({centre ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))) for _ in range(300)} | {int(x) for x in rng.integers(-(2**62), 2**62, 50)})
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    for bucket_rows in (4, 2048):
        found = {r["node"]: r["root"] for r in connected_components(linked_classes(table, 3, bucket_rows)).collect()}
        root = {p: p for p in prints}
        changed = True
        while changed:
            changed = False
            for a in prints:
                for b in prints:
                    if bin((a ^ b) & (2**64 - 1)).count("1") <= 3 and root[a] != root[b]:
                        root[a] = root[b] = min(root[a], root[b])
                        changed = True
        assert {p: found.get(p, p) for p in prints} == root


def test_representatives_keep_one_of_each_group(docs):
    from strandframe.llm.simhash import representatives

    kept = representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "7", "8", "9", "None", "11"])


def test_representatives_lose_no_text_that_has_no_copy(spark):
    from strandframe.llm.simhash import representatives

    own = ["a text of its own that nobody else has written anywhere", "seven says one thing and nothing but this thing here", "yet another text with the number seven and other words"]
    rows = [(1, LONG), (5, LONG), (5, own[0]), (7, own[1]), (7, own[2]), (8, LONG), (9, own[2]), (3, "twice the very same row of five"), (3, "twice the very same row of five")]
    for n in (1, 3):
        kept = representatives(spark.createDataFrame([(*r, k, {"m": k}) for k, r in enumerate(rows)], "doc_id long, text string, _fp int, meta map<string,int>").repartition(n))
        assert kept.columns == ["doc_id", "text", "_fp", "meta"]
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, LONG), (5, own[0]), (7, own[1]), (7, own[2]), (3, rows[7][1])])


def test_components_of_a_star_and_a_chain(spark):
    from strandframe.llm.support import connected_components

    edges = [(500, i) for i in range(100, 400)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in [*range(100, 400), 500]} | {i: 1000 for i in range(1000, 1041)}


def brute_hits(texts, items, width=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(lowered(t))
        for j in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[j : j + width]), set()).add(i)
    out = []
    for _, t in texts:
        w, hit, found = WORD.findall(lowered(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (o := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= o
        out.append((len(w), len(hit), len(found - {None})))
    return out


ITEMS = [(1, "Brown fox jumps over a lazy dog while rain falls on the"), (2, "one two"), (3, ""), (4, None), (10, "one two"), (None, "unique words"), (6, " ".join(f"w{i * 7919 % 1000}" for i in range(40, 80)))]


@pytest.mark.parametrize("symbols", [64, 1 << 20])
def test_decontamination_equals_brute_force(spark, docs, symbols):
    import hashlib

    from strandframe.llm import decontamination as D

    n_words, spans, owned = D.searched([t for _, t in TEXTS], D.Windows(ITEMS), symbols)
    local = [(n, sum(b - a for a, b in s), len(o)) for n, s, o in zip(n_words, spans, owned, strict=True)]
    assert local == brute_hits(TEXTS, ITEMS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(docs, items).collect()
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in got) == sorted(local)
    eighth = next(r for r in got if r["doc_id"] == 8)
    assert eighth["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and eighth["contaminated"]
    assert all(not r["contaminated"] for r in D.contamination(docs, empty(items)).collect())
    assert D.contamination(empty(docs), items).count() == 0
    assert sorted(str(r["doc_id"]) for r in D.decontaminated(docs, items).collect()) == sorted(["4", "5", "6", "None", "11"])


def test_decontamination_in_blocks_and_cuts(spark, docs):
    from strandframe.llm import decontamination as D

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    small = D.with_hits(docs, items, block_words=5).select("_n_words", "_spans", "_items").collect()
    whole = D.with_hits(docs, items).select("_n_words", "_spans", "_items").collect()
    assert sorted(map(str, small)) == sorted(map(str, whole))
    cut = {r["doc_id"]: r for r in D.decontaminated(docs, items, policy="cut").collect()}
    assert cut[8]["text"] == "" and cut[8]["n_chars"] == 0
    assert "lazy dog" not in cut[1]["text"] and cut[1]["text"].endswith("alpha")
    assert cut[11]["text"] == "x" * 20_000


def test_decontamination_takes_clashing_columns(spark):
    from strandframe.llm import decontamination as D

    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    df = spark.createDataFrame([(1, "say One, two: three", 5, "x", 7, 9)], "doc_id long, text string, _spans int, _items string, _n_words long, n_chars int")
    assert D.with_hits(df, items).columns == [*df.columns, "__n_words", "__spans", "__items"]
    assert D.decontaminated(df, items).columns == df.columns and D.decontaminated(df, items).count() == 0
    assert D.decontaminated(df, items, policy="cut").collect() == [(1, "say : three", 5, "x", 7, 11)]


def test_shard_index_holds_every_word_and_serves_any_phrase():
    from strandframe.llm import decontamination as D

    rng = np.random.default_rng(8)
    documents = [[f"w{x}".encode() for x in rng.integers(0, 30, n)] for n in (0, 1, 400, 3, 250)] + [[b"a"] * 90]
    documents += [list(documents[2])]
    shard = D.Shard(documents)
    assert shard.index.n == sum(len(d) + 1 for d in documents) + 1
    for phrase in (["w3"], ["w3", "w4"], ["a"] * 5, [w.decode() for w in documents[2][100:110]], ["none"]):
        which, at = shard.occurrences(D.Windows([(1, " ".join(phrase))]))
        part = [p.encode() for p in phrase]
        assert sorted(at.tolist()) == [int(shard.begins[k]) + i for k, d in enumerate(documents) for i in range(len(d)) if d[i : i + len(part)] == part]


def test_fm_index_finds_every_place():
    from strandframe.llm.decontamination import FMIndex

    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(1, 5, 700), np.tile([2, 3], 60), [0]])
    index = FMIndex(text, 5)
    patterns = [text[i : i + n] for i in range(0, 600, 23) for n in (1, 2, 4, 7)] + [np.array([4, 4, 4, 4, 4, 4, 4, 4])]
    codes, sizes = np.zeros((len(patterns), 8), np.int64), np.array([len(p) for p in patterns])
    for i, p in enumerate(patterns):
        codes[i, : len(p)] = p
    low, high = index.search(codes, sizes)
    for p, a, b in zip(patterns, low, high, strict=True):
        places = [i for i in range(len(text) - len(p) + 1) if np.array_equal(text[i : i + len(p)], p)]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def test_licences_equal_brute_force(spark, docs):
    from strandframe.llm.licenses import scanned

    texts = ["Released under the MIT License. mit  license!", "GNU GENERAL public-license, mit\nlicense", "Licensed under the Apache License, Version 2.0.", "Kelvin Mit License", None, "", "This work is licensed under the GNU General Public License, version 3.", "license mit " * 5000, "Licensed under CC BY-NC 4.0.", "version 2 0 apache license far away"]
    rows = scanned(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, hits int")).orderBy("doc_id").collect()
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r, t in zip(rows, texts, strict=True):
        words = WORD.findall(lowered(t))
        places = sorted(i for p in base for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        labels = sorted({label for p, label in base.items() if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert rows[6]["labels"] == "gpl,gpl-3.0" and rows[8]["labels"] == "cc-by-nc-4.0" and "apache-2.0" in rows[2]["labels"]
    assert "apache-2.0" not in rows[9]["labels"]
    assert scanned(empty(docs)).count() == 0


def test_licences_with_several_notices_and_stray_words_equal_brute_force(spark):
    from collections import Counter

    from strandframe.llm.licenses import RAREST, TEMPLATES, scanned

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    apache = "Licensed under the Apache License, Version 2.0."
    stray = " ".join(dict.fromkeys(w for _, t, _ in TEMPLATES for w in t.split()))
    texts = [f"{mit}. {apache}", f"{apache} {mit}", f"{stray} filler {apache}", "\n".join(t for _, t, _ in TEMPLATES), f"{stray} {'stray words ' * 500}{TEMPLATES[-1][1]} {stray}", stray, f"{mit} " * 3 + apache, "the free use of a public file is in no event a matter of version 3"]
    texts += [f"{a} x y {b} {stray}" for _, a, _ in TEMPLATES[::2] for _, b, _ in TEMPLATES[1::3]]
    rows = scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    split = [WORD.findall(lowered(t)) for t in texts]
    seen = Counter(w for words in split for w in set(words))

    def starts(words, phrase):
        part = phrase.split()
        return {i for i in range(len(words)) if words[i : i + len(part)] == part}

    for r, words in zip(rows, split, strict=True):
        want, score = {label for p, label in base.items() if starts(words, p)}, 0.0
        for label, text, keys in TEMPLATES:
            here = text.split()
            rare = sorted(set(here), key=lambda w: (seen[w], w))[:RAREST]
            postings = [q for q, w in enumerate(here) if w in rare]
            for at in set.intersection(*({i - min(starts(here, k)) for i in starts(words, k)} for k in keys)):
                n = sum(0 <= at + q < len(words) and words[at + q] == here[q] for q in postings)
                if n >= 2:
                    want.add(label)
                    score = max(score, n / len(postings))
        assert r["labels"] == ",".join(sorted(want)) and r["score"] == pytest.approx(score or float(bool(want)))
    assert {t[0] for t in TEMPLATES} <= set(rows[3]["labels"].split(",")) and {"apache-2.0", "mit-text"} <= set(rows[0]["labels"].split(",")) and rows[0]["score"] == 1.0


def test_token_counts_equal_offsets_of_another_library(spark, docs):
    from tokenizers import Tokenizer

    from strandframe.llm.token_counts import section_counts

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = ["First line.\n\nThird ünïcödé 日本語 line\n  indented", "one", "", None, "a\n", "\n\n", "emoji 😀😀\n😀 end"]
    got = section_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        own = sorted((r["section"], r["char_start"], r["char_end"], r["n_tokens"]) for r in got if r["doc_id"] == i)
        edges, at = [], 0
        for line in (t or "").splitlines(keepends=True) or [""]:
            edges.append((at, at + len(line)))
            at += len(line)
        starts = [s for s, _ in other.encode(t or "", add_special_tokens=False).offsets]
        assert own == [(n, a, b, float(sum(a <= s < b for s in starts))) for n, (a, b) in enumerate(edges)]
    assert section_counts(empty(docs)).count() == 0
    n = len(other.encode(TEXTS[8][1], add_special_tokens=False).ids)
    assert {r["n_tokens"] for r in section_counts(docs).where("doc_id = 9").collect()} == {float(n)}


def test_token_shares_add_up(spark):
    from strandframe.llm.token_counts import section_counts

    df = spark.createDataFrame([(1, "hello wonderful world", [(0, 8), (8, 21)]), (2, "abc", [(5, 9), (1, 1)]), (3, "x", None), (4, "one two", [None, (0, 3), (None, 2), (3, None), (3, 7)])], "doc_id long, text string, parts array<struct<start: int, end: int>>")
    shares = {(r["doc_id"], r["section"]): r for r in section_counts(df, sections="parts", rule="share").collect()}
    whole = section_counts(df.select("doc_id", "text")).where("doc_id = 1").first()["n_tokens"]
    assert shares[1, 0]["n_tokens"] + shares[1, 1]["n_tokens"] == pytest.approx(whole)
    assert shares[1, 0]["n_crossing"] == shares[1, 1]["n_crossing"] == 1
    assert shares[2, 0]["n_tokens"] == shares[2, 1]["n_tokens"] == 0 and (3, 0) not in shares
    assert [(shares[4, n]["char_start"], shares[4, n]["char_end"], shares[4, n]["n_tokens"]) for n in range(5)] == [(None, None, 0.0), (0, 3, 1.0), (None, None, 0.0), (None, None, 0.0), (3, 7, 1.0)]
    lines = section_counts(spark.createDataFrame([(1, "a b\n\n\n c d\n")], "doc_id long, text string")).collect()
    assert sum(r["n_shared"] for r in lines) == pytest.approx(sum(r["n_tokens"] for r in lines))


def test_sentencepiece_parity_and_round_trip(spark, docs):
    import sentencepiece

    from strandframe.llm.sentencepiece_tokens import MODEL, decoded, encoded

    peer = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd = [" lead", "trail  ", "a   b", "😀 tail", "tab\tnew\nline", "▁ mark", "日本語", "<s> </s> <0x41>", *[" " * n + "q" for n in range(1, 40)]]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rows = encoded(df, MODEL).collect()
    for r in rows:
        if r["text"] is None:
            assert r["token_ids"] is None and r["n_tokens"] == 0 and r["parity"] is None
            continue
        assert r["token_ids"] == peer.encode(r["text"]) and r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["token_ids"])
    back = decoded(encoded(df, MODEL).withColumnRenamed("text", "was"), MODEL).collect()
    assert all(b["text"] == (b["was"] if b["was"] is None else b["was"].replace("▁", " ")) for b in back)
    assert encoded(empty(docs), MODEL).count() == 0


def _message(*fields):
    """A protobuf message of (number, value): bytes, strings and lists of fields are sized, floats have 32 bits."""
    out = b""
    for number, value in fields:
        kind = 5 if isinstance(value, float) else 0 if isinstance(value, int) else 2
        out += _varint(number << 3 | kind)
        if kind == 0:
            out += _varint(value)
        elif kind == 5:
            out += np.float32(value).tobytes()
        else:
            value = value.encode() if isinstance(value, str) else _message(*value) if isinstance(value, list) else value
            out += _varint(len(value)) + value
    return out


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _models():
    """Models that nobody has trained: the public one with user-defined pieces or another normaliser, and its pieces with scores for unigrams.

    These scores are sixteenths, so that the library's single-precision sums over a long text are exact.
    """
    import sentencepiece

    from strandframe.llm.sentencepiece_tokens import MODEL, NORMAL, Model, _fields

    with open(MODEL, "rb") as f:
        public = f.read()
    nfkc = next(v for n, v in _fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if n == 3)
    user = _message(*[(1, [(1, p), (2, 0.0), (3, 4)]) for p in ("<u>", "ing the", "<u><u>x", "qqq")])
    rng = np.random.default_rng(4)
    pieces = [(1, [(1, p), (2, -5 - round(len(p) ** -0.5 * 16 * (8 + rng.random())) / 16) if k == NORMAL else (2, 0.0), (3, k)]) for p, _, k in Model.parse(public).pieces]
    unigram = _message(*pieces, (2, [(3, 1), (35, 1)]))
    squeezing = _message((3, [(3, 1), (4, 1), (5, 1)]))
    return {"user": public + user, "nfkc": public + _message((3, nfkc)), "unigram": unigram + _message((3, [(4, 0)])), "unigram nfkc": unigram + _message((3, nfkc)), "squeezing": public + squeezing}


ODD = [" lead", "trail  ", "a   b", "tab\tnew\nline\n", "\u3000wide　space", "ﬁ ligature ①½ ＡＢＣ e\u0301 A\u030a", "a<u>b<u><u>x ing the qqqq", "日本語 テスト", "x\u200by\u00adz", "", " ", "\n", "▁ mark ▁", "ends in mark▁", "한국어 가"]


@pytest.mark.parametrize("kind", ["user", "nfkc", "unigram", "unigram nfkc", "squeezing"])
def test_models_agree_with_the_library_on_whole_texts(spark, kind):
    import sentencepiece

    from strandframe.llm.sentencepiece_tokens import Codec

    data = _models()[kind]
    peer, codec = sentencepiece.SentencePieceProcessor(model_proto=data), Codec(data)
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids, like, _ = codec.encode(texts)
    theirs = peer.encode(texts)
    assert [i.tolist() == t for i, t in zip(ids, theirs, strict=True)] == like
    unlike = [t[:80] for t, ok in zip(texts, like, strict=True) if not ok]
    assert not unlike, (len(unlike), unlike[:5])


def test_parity_is_of_the_whole_text():
    from strandframe.llm.sentencepiece_tokens import MODEL, Codec

    with open(MODEL, "rb") as f:
        codec = Codec(f.read())
    texts = ["some words here", "other words"]
    assert codec.encode(texts)[1] == [True, True]
    codec.words["here"] = codec.words["words"]  # a planted difference
    assert codec.encode(texts)[1] == [False, True]


def test_unigram_models_are_rebuilt():
    from strandframe.llm.sentencepiece_tokens import Codec

    def field(number, kind, payload):
        return bytes([number << 3 | kind]) + payload if number < 16 else bytes([number << 3 & 127 | kind | 128, number >> 4]) + payload

    def sized(data):
        return bytes([len(data)]) + data

    def piece(text, score, kind=1):
        return field(1, 2, sized(field(1, 2, sized(text.encode())) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))))

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{b:02X}>", -20, 6) for b in range(256)], ("▁", -3, 1), ("a", -4, 1), ("b", -4, 1), ("ab", -5, 1), ("▁ab", -5.5, 1), ("▁a", -6, 1)]
    data = b"".join(piece(*p) for p in pieces) + field(2, 2, sized(field(3, 0, b"\x01") + field(35, 0, b"\x01")))
    import sentencepiece

    peer = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = Codec(data)
    texts = ["ab a b", "abba  ab", "cab 日", "", "a"]
    ids, like, whole = codec.encode(texts)
    assert [i.tolist() for i in ids] == [peer.encode(t) for t in texts] and all(like) and all(whole)


def test_a_decoder_that_loses_a_letter_is_told():
    from pathlib import Path

    from strandframe.llm.sentencepiece_tokens import MODEL, Codec

    codec = Codec(Path(MODEL).read_bytes(), verify=False)
    plain = codec._text
    codec._text = lambda ids: [t.replace("q", "") for t in plain(ids)]
    ids, _, whole = codec.encode(["the quay is near", "nothing of it here", "q", "a  q b", "  "])
    assert whole == [False, True, False, False, True]
    codec._text = plain
    assert codec.decode([i.tolist() for i in ids]) == ["the quay is near", "nothing of it here", "q", "a  q b", "  "]
