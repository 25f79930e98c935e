"""The pipeline on planted documents against a plain reading of its stages, and what the driver finds registered."""

import re

import numpy as np

from .test_text_operators import brute_hits, lowered


def fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from strandframe.llm.sentencepiece_tokens import MODEL

    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    texts = [prose(int(n)) for n in rng.integers(5, 90, 30)]
    item = prose(14)
    texts += [texts[3], texts[3] + " end", f"{prose(20)} {item} {prose(9)}", f"{prose(8)} {item[: item.rindex(' w')]}", "", None, "   ", texts[7]]
    docs = [(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, df in {
        "documents": spark.createDataFrame(docs, schema).repartition(3),
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),  # no labels: the first stage keeps all
        "benchmark": spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    prints = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    kept = [i for i in range(len(texts)) if root[i] == i]
    hits = brute_hits([(i, texts[i]) for i in kept], [(1, item)])
    kept = [i for i, (_, n, _) in zip(kept, hits, strict=True) if not n]
    assert sorted(got) == kept and 30 not in got and 32 not in got
    peer = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i in kept:
        if texts[i] is not None:
            assert got[i]["token_ids"] == peer.encode(texts[i]) and got[i]["parity"] and got[i]["round_trip"]


def test_the_driver_finds_all_operators():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert {"op4_url_lists", "op5_licenses", "op6_chat", "op8_decontamination"} <= set(entry.oracle_sql())
