"""The corpus pipeline: every stage on odd rows, and its decisions against brute force."""

import random

import pytest

import corpus_pipeline
from quadrille.llm import queries

from .conftest import prose, substituted, table
from .test_operators import brute_repeats, groups, linked


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(31)
    base = [prose(rng, 120) for _ in range(40)]
    items = [prose(rng, 30) for _ in range(4)]
    passage = prose(rng, 90)
    texts = base + [base[0], substituted(rng, base[1], 1), base[2] + " " + passage, base[3] + " " + passage, base[4] + "\n" + items[0], None, ""]
    texts += [f"{prose(rng, 50)} idiot moron pathetic {prose(rng, 20)}" for _ in range(90)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, 1, int("idiot" in (t or ""))) for k, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("corpus")
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts


def test_stages(spark, corpus):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "mix":
            assert out.columns == docs.columns
        seen[name] = out.collect()
        docs = spark.createDataFrame(seen[name], out.schema)
    clean = {r["doc_id"]: r["text"] for r in seen["toxicity"]}
    assert set(clean) == {k for k, t in enumerate(texts) if "idiot" not in (t or "")}
    ids = sorted(clean)
    parts = groups(linked([clean[k] for k in ids]))
    left = sorted(ids[min(p)] for p in parts)
    assert sorted(r["doc_id"] for r in seen["near copies"]) == left
    cut = {r["doc_id"]: r for r in seen["repeated strings"]}
    for k, (n, gone, _, _) in zip(left, brute_repeats([(clean[k] or "").encode() for k in left])):
        assert len(cut[k]["text"].encode()) == n - gone and cut[k]["n_chars"] == len(cut[k]["text"])
    assert any(len(cut[k]["text"]) < len(clean[k] or "") for k in left)
    assert {r["doc_id"] for r in seen["benchmark"]} == {k for k in left if k != 44}
    assert len(seen["mix"]) == len(seen["benchmark"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, seen["mix"]))


def test_empty_corpus(spark, corpus, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus[0])
        assert docs.count() == 0


def test_every_operator_has_a_query():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(names)
