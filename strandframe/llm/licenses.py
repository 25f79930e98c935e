"""License scan with a positional index of rare licence words.

One pass over the texts keeps, for every document, which words of licence templates it has, and where they stand if any
phrase can be complete. Document frequencies over all documents then choose each template's index words: those of its words
with the highest IDF. In a file these are looked up in the postings of the templates; every pair of a place and a posting
votes for the relative position of a template. A template is reported where two votes or more agree and all words of its
key phrases stand at their places. The rarest words are chosen by template, so no document's notices compete for votes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import read, written

# The phrases that the scan always counts, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Statements of public licences, each with its label and the phrases that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted", "associated documentation files")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this program is free software under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ("source code form", "mozilla public license")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license", "free software foundation")),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("gpl-later", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published", "any later version")),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0", "in compliance with the license")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("and or distribute this software", "hereby granted")),
    ("mpl-2.0-notice", "if a copy of the mpl was not distributed with this file you can obtain one at", ("copy of the mpl",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("provided as is", "authors be held liable")),
    ("boost", "boost software license version 1 0", ("boost software license",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0-long", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa-4.0-long", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international",)),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("binary forms", "modification are permitted")),
)
#: Each template's words of the highest IDF that are looked up, with all their places in it; ties by the alphabet.
RAREST = 8
VOTES = 2
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What one template's votes lie apart from the next one's, and what is added to relative positions so that none is negative.
SPAN, LIFT = 1 << 40, 1 << 20


@dataclass(frozen=True)
class Catalogue:
    """The templates and base phrases as numbered words. A phrase is a template without index words, all of it one key phrase."""

    labels: tuple[str, ...]
    texts: tuple[tuple[str, ...], ...]
    keys: tuple[tuple[int, ...], ...]  # for each template the places of its key phrases' words
    n_templates: int  # the base phrases come after the templates

    @classmethod
    def of(cls, templates=TEMPLATES, base=BASE) -> Catalogue:
        labels, texts, keys = [], [], []
        for label, text, phrases in templates:
            here, places = text.split(), set()
            for k in phrases:
                part = k.split()
                at = next(i for i in range(len(here)) if here[i : i + len(part)] == part)
                places |= set(range(at, at + len(part)))
            labels.append(label)
            texts.append(tuple(here))
            keys.append(tuple(sorted(places)))
        for phrase, label in base.items():
            labels.append(label)
            texts.append(tuple(phrase.split()))
            keys.append(tuple(range(len(phrase.split()))))
        return cls(tuple(labels), tuple(texts), tuple(keys), len(templates))

    @property
    def words(self) -> list[str]:
        return sorted({w for t in self.texts for w in t})

    def anchors(self) -> list[str]:
        """Words of which every text with a reported template has one: the longest of each template's key words."""
        return sorted({max((t[i] for i in k), key=lambda w: (len(w), w)) for t, k in zip(self.texts, self.keys, strict=True)})

    def index_words(self, frequency: dict[str, int]) -> list[list[str]]:
        """For each template its words of the highest IDF, that is of the least document frequency."""
        return [sorted(set(t), key=lambda w: (frequency.get(w, 0), w))[:RAREST] if i < self.n_templates else [] for i, t in enumerate(self.texts)]


def _array(values, kind: str) -> str:
    return f"cast(array({', '.join(values)}) AS array<{kind}>)"


def _quoted(words) -> list[str]:
    return [f"'{w}'" for w in words]


def licence_words(docs: DataFrame, catalogue: Catalogue, id: str, text: str) -> DataFrame:
    """Rows (id, n_words, present, hits): the distinct licence words of a text, and where any anchor is among them the places of all, as structs (c: code, p: number of the word), in order.

    Only A to Z are put in lower case: of all other letters only the Kelvin sign would become one of these.
    """
    lowered = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u212a"), F.lit("é")))
    words, listed = catalogue.words, ", ".join(_quoted(catalogue.words))
    rows = docs.select(F.col(id).alias("id"), F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0)).alias("words"))
    rows = rows.select("id", "words", F.size("words").cast("long").alias("n_words"), F.expr(f"array_intersect(words, array({listed}))").alias("present"))
    code = "map(" + ", ".join(f"'{w}', {i}" for i, w in enumerate(words)) + ")"
    hits = f"transform(filter(transform(words, (w, i) -> struct(w, i)), s -> s.w IN ({listed})), s -> struct({code}[s.w] AS c, s.i AS p))"
    return rows.select("id", "n_words", "present", F.expr(f"CASE WHEN arrays_overlap(present, array({', '.join(_quoted(catalogue.anchors()))})) THEN {hits} ELSE {_array([], 'struct<c:int,p:int>')} END").alias("hits"))


def document_frequencies(found: DataFrame) -> dict[str, int]:
    """In how many of all documents each licence word stands; as many rows as the catalogue has words reach the driver."""
    return {r["w"]: r["n"] for r in found.select(F.explode("present").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, empty labels and score 0. score is the largest share of a reported template's
    index words that agree on one relative position, 1 where only base phrases stand, else 0. Repeated rows stay repeated
    and count in document frequencies; an empty table gives an empty result; only id and text are read, so other columns
    may have any name.
    """
    catalogue = Catalogue.of(templates, base)
    found = written(licence_words(docs, catalogue, id, text), "licence_words")
    chosen = catalogue.index_words(document_frequencies(found))
    code = {w: i for i, w in enumerate(catalogue.words)}
    # a vote is a number: the template, the relative position, and last whether it is an index word's or a key phrase's
    postings: list[list[str]] = [[] for _ in code]
    for t, (here, keys) in enumerate(zip(catalogue.texts, catalogue.keys, strict=True)):
        for i, w in enumerate(here):
            vote = 2 * (t * SPAN + LIFT - i)
            postings[code[w]] += [f"{vote}L"] * (i in keys) + [f"{vote + 1}L"] * (w in chosen[t])
    looked_up = f"array({', '.join(_array(p, 'bigint') for p in postings)})"
    rows = found.withColumn("votes", F.expr(f"array_sort(flatten(transform(hits, h -> transform(get({looked_up}, h.c), v -> v + 2 * cast(h.p AS bigint)))))"))
    # the votes for one template and position stand together, those of its key phrases first: it is verified where there is one for each of their words
    n_keys = _array([str(len(k)) for k in catalogue.keys], "int")
    n_index = _array([str(sum(w in c for w in t)) for t, c in zip(catalogue.texts, chosen, strict=True)], "int")
    of = f"cast(get(votes, i) div {2 * SPAN} AS int)"
    verified = f"filter(sequence(0, size(votes) - 1), i -> get(votes, i) % 2 = 0 AND get(votes, i + get({n_keys}, {of}) - 1) = get(votes, i))"
    agreed = f"size(filter(sequence(0, get({n_index}, {of}) - 1), j -> get(votes, i + get({n_keys}, {of}) + j) = get(votes, i) + 1))"
    placed = f"transform({verified}, i -> struct({of} AS t, get(votes, i) div 2 % {SPAN} - {LIFT} AS at, CASE WHEN get({n_index}, {of}) > 0 THEN {agreed} ELSE 0 END AS n, get({n_index}, {of}) AS size))"
    rows = rows.withColumn("placed", F.expr(f"CASE WHEN size(votes) > 0 THEN {placed} ELSE {_array([], 'struct<t:int,at:bigint,n:int,size:int>')} END"))
    rows = rows.withColumn("bases", F.expr(f"filter(placed, x -> x.t >= {catalogue.n_templates})")).withColumn("notices", F.expr(f"filter(placed, x -> x.t < {catalogue.n_templates} AND x.n >= least({VOTES}, x.size))"))
    labels = _array(_quoted(catalogue.labels), "string")
    joined: Column = lambda which: F.expr(f"array_join(array_sort(array_distinct(transform({which}, x -> get({labels}, x.t)))), ',')")
    best = F.expr("array_max(transform(notices, x -> x.n / x.size))")
    return rows.select(
        F.col("id").alias(id), "n_words", F.size("bases").cast("long").alias("n_base"), F.array_min("bases.at").alias("first_word"), F.array_max("bases.at").alias("last_word"), joined("bases").alias("base_labels"), joined("concat(bases, notices)").alias("labels"),
        F.when(F.size("notices") > 0, best).when(F.size("bases") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("score"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"))


def oracle(templates=TEMPLATES, base=BASE) -> str:
    """The same in DuckDB's SQL, by joins of word places with the words of templates and phrases."""
    values = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    words = [(label, w, q) for label, text, _ in templates for q, w in enumerate(text.split())]
    phrases = sorted({k for _, _, ks in templates for k in ks} | set(base))
    return rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS p FROM split),
template(label, w, q) AS (VALUES {values(words)}),
phrase_words(k, i, w) AS (VALUES {values([(k, i, w) for k in phrases for i, w in enumerate(k.split())])}),
phrase_sizes AS (SELECT k, count(*) AS n FROM phrase_words GROUP BY k),
phrases AS (SELECT doc_id, k, start FROM (SELECT doc_id, k, p - i AS start, count(*) AS n FROM placed JOIN phrase_words USING (w) GROUP BY ALL) JOIN phrase_sizes USING (k, n)),
base(k, label) AS (VALUES {values(list(base.items()))}),
based AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM phrases JOIN base USING (k) GROUP BY doc_id),
df AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, w FROM placed WHERE w IN (SELECT w FROM template)) GROUP BY w),
rare AS (SELECT label, w FROM (SELECT DISTINCT label, w, coalesce(n, 0) AS n FROM template LEFT JOIN df USING (w)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY n, w) <= {RAREST}),
postings AS (SELECT * FROM template JOIN rare USING (label, w)),
sizes AS (SELECT label, count(*) AS size FROM postings GROUP BY label),
votes AS (SELECT doc_id, label, p - q AS pos, count(*) AS n FROM placed JOIN postings USING (w) GROUP BY ALL),
keys(label, k, q) AS (VALUES {values([(label, k, next(i for i in range(len(text.split())) if text.split()[i : i + len(k.split())] == k.split())) for label, text, ks in templates for k in ks])}),
n_keys AS (SELECT label, count(*) AS m FROM keys GROUP BY label),
verified AS (SELECT doc_id, label, pos FROM (SELECT doc_id, label, start - q AS pos, count(*) AS m FROM phrases JOIN keys USING (k) GROUP BY ALL) JOIN n_keys USING (label, m)),
scores AS (SELECT doc_id, label, max(n / size) AS score FROM verified JOIN votes USING (doc_id, label, pos) JOIN sizes USING (label) WHERE n >= least({VOTES}, size) GROUP BY ALL),
listed AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM scores UNION SELECT doc_id, label FROM phrases JOIN base USING (k)) GROUP BY doc_id),
best AS (SELECT doc_id, max(score) AS score FROM scores GROUP BY doc_id)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(best.score, CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS score
FROM split s LEFT JOIN based USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id)
"""
