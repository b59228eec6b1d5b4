"""The pipeline against a plain version on a small fixture, and its contract."""

import random

import pytest

pytest.importorskip("sievework.llm")
pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sievework.llm import quality_mcd, secret_scan, simhash_covering, winnowing  # noqa: E402

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(1)
    syl = ["the", "an", "on", "re", "ti", "ou", "ing", "wh", "ed"]
    text = lambda n: " ".join("".join(rng.choice(syl) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(rng.randrange(30, 120)), "en", "s", 0) for i in range(150)]
    bench = [(i, text(15)) for i in range(5)]
    rows += [(200 + i, rows[i][1], "en", "s", 0) for i in range(10)]
    rows += [(300 + i, text(20) + " " + bench[i][1] + " " + text(20), "en", "s", 0) for i in range(5)]
    rows += [(400 + i, text(40) + " token=abcdef123456789 " + text(20), "en", "s", 0) for i in range(5)]
    long = [r[1].split() for r in rows[20:150] if len(r[1].split()) >= 80][:20]
    rows += [(700 + i, " ".join([*w[:50], "changed", *w[51:]]), "en", "s", 0) for i, w in enumerate(long)]
    rows += [(500 + i, "a b a b " * 20, "en", "s", 0) for i in range(3)] + [(600, None, None, None, None), (601, "", "en", "s", 0)]
    return [(i, t, a, b, None if t is None else len(t)) for i, t, a, b, _ in rows], bench


def test_pipeline(spark, tmp_path):
    rows, bench = fixture()
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.createDataFrame(rows, DDL)
    kept = {r.doc_id for r in quality_mcd.quality(docs).where("kept").collect()}
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    # Near copies by all pairs of five-word shingle sets, independent of fingerprints: of each component the smallest id stays.
    alive = sorted((r[:2] for r in rows if r[0] in kept), key=lambda r: r[0])
    sets, root = [shingles(t) for _, t in alive], list(range(len(alive)))
    for k in range(len(alive)):
        for j in range(k):
            if len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k]) and root[j] != root[k]:
                old, new = max(root[j], root[k]), min(root[j], root[k])
                root = [new if r == old else r for r in root]
    left = {i: t for k, (i, t) in enumerate(alive) if root[k] == k}
    copies = {i: t for k, (i, t) in enumerate(alive) if root[k] != k}
    grams = {tuple(w[k : k + 10]) for _, t in bench for w in [winnowing.words_of(t)] for k in range(len(w) - 9)}
    clean = {i: t for i, t in (left | copies).items() if not any(tuple(w[k : k + 10]) in grams for w in [winnowing.words_of(t)] for k in range(len(w) - 9))}
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {i: lib.encode(secret_scan.redact(t, "[secret]"), add_special_tokens=False).ids for i, t in clean.items()}
    # No document without a copy goes; of the copies at least nine in ten do, and all equal texts.
    assert {i for i in left if i in want} <= set(got) and all(want[i] == ids for i, ids in got.items())
    assert sum(i in got for i in copies) <= 0.1 * len(copies)
    assert not any(200 <= i < 210 or 300 <= i < 305 or 500 <= i < 700 for i in got) and sum(400 <= i < 405 for i in got) == 5


def test_near_dedup_recall_on_the_tables(spark):
    """Against all pairs of different texts at sf0.01 that share 0.8 of their five-word shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    first = {r.text: r.doc_id for r in docs.groupBy("text").agg({"doc_id": "min"}).toDF("text", "doc_id").collect()}
    sets = {}
    for t, i in first.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r.doc_id for r in simhash_covering.keep_one(docs).select("doc_id").collect()}
    assert len(pairs) >= 5 and sum(a in kept and b in kept for a, b in pairs) <= 0.1 * len(pairs)
    assert {i for i in ids if not any(i in p for p in pairs)} <= kept


def test_stages_keep_columns(spark, tmp_path):
    rows, bench = fixture()
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, DDL)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
