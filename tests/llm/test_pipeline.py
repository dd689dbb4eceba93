import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.conftest import WORDS
from tests.llm.test_exact import brute as exact_brute
from tests.llm.test_jaccard import brute as near_brute

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_each_stage_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids and (before is None or ids <= before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = out
        before = ids
    assert "ids" in out.columns and out.where("NOT lossless").count() == 0


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    """Toxic rows are told by two words; all others are those of the other rows."""
    r = random.Random(6)
    rows = [(1000 + i, " ".join(r.choice(WORDS) + str(r.randrange(23)) for _ in range(60)) + (" grubworm scoundrel" if i % 4 == 0 else "")) for i in range(400)]
    return rows, [(i, int(t.endswith("scoundrel"))) for i, t in rows]


def tables(spark, edge, labels, path):
    rows, marks = labels
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = edge.unionByName(more, allowMissingColumns=True)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


def test_stages_against_brute_force(spark, edge, labels, tmp_path):
    """Nulls in any column, repeated rows, ties, long texts and clashing names through all stages."""
    folder = tables(spark, edge, labels, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first, second, third, fourth, fifth = (stage for _, stage in corpus_pipeline.STAGES)
    clean = first(spark, docs, folder).cache()
    assert clean.columns == docs.columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()}
    toxic = {i for i, t in labels[1] if t}
    assert len(gone - toxic) <= 1 and len(toxic - gone) <= 0.1 * len(toxic)
    one = second(spark, clean, folder).cache()
    want = {(keep, digest) for _, keep, _, digest in exact_brute(clean.collect())}
    assert one.columns == docs.columns and one.count() == len(want) and Counter(r["doc_id"] for r in one.collect()) == Counter(k for k, _ in want)
    near = third(spark, one, folder).cache()
    rows = one.collect()
    kept = {least for i, n, least in near_brute(rows) if n} | {i for i, n, _ in near_brute(rows) if not n}
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == kept
    mixed = fourth(spark, near, folder).cache()
    texts = {r["doc_id"]: r["text"] or "" for r in near.collect()}
    assert mixed.columns == docs.columns and all(texts[r["doc_id"]].startswith(r["text"] or "") for r in mixed.collect())
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    total = words(near.collect())
    assert 0.8 * total - 60 < words(mixed.collect()) <= 0.8 * total
    last = fifth(spark, mixed, folder).collect()
    assert len(last) == mixed.count() and all(r["lossless"] for r in last)
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in last) == sorted((r["doc_id"] or 0, len((r["text"] or "").encode())) for r in mixed.collect())


def test_run_on_an_empty_table(spark, nothing, labels, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels[1], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_run_is_its_stages(spark, edge, labels, tmp_path):
    folder = tables(spark, edge, labels, tmp_path)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "epoch", "n_bytes", "n_tokens", "ids", "lossless"] and out.count() > 100
