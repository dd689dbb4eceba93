from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.llm.mixing import mix, mixed_documents, op4_mixing, plan


def docs_of(spark):
    rows = [(i, "w " * (5 + i % 9), ("en", "de", "fr")[i % 3], f"s{i % 7}") for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_budgets_go_to_siblings_first(spark):
    docs = docs_of(spark)
    ends = plan(docs, share=0.9, epochs=1).collect()
    total = sum(r["tokens"] for r in ends)
    budget = sum(r["budget"] for r in ends)
    assert total * 90 // 100 - 2 * len(ends) <= budget <= total * 90 // 100
    assert all(r["budget"] <= r["tokens"] for r in ends)
    # a leaf below its capacity has no sibling that got more per weight while it was not full itself
    by = defaultdict(list)
    for r in ends:
        by[r["domain"], r["lang"]].append(r)
    for family in by.values():
        open_ = [r["budget"] for r in family if r["budget"] < r["tokens"]]
        assert not open_ or max(open_) - min(open_) <= 1
        assert all(r["budget"] <= max(open_) + 1 for r in family if r["budget"] == r["tokens"]) if open_ else True


def test_prefix_of_each_leaf(spark):
    docs = docs_of(spark)
    ends = {(r["domain"], r["lang"], r["source"]): r for r in plan(docs, share=1.3, epochs=3).collect()}
    rows = mix(docs, share=1.3, epochs=3).collect()
    taken = Counter()
    for r in rows:
        m = r["mix"]
        taken[m["domain"], m["lang"], m["source"]] += m["take"]
        assert m["epoch"] < 3
    for leaf, r in ends.items():
        assert taken[leaf] == r["budget"]
    assert max(Counter((r["doc_id"], r["mix"]["epoch"]) for r in rows).values()) == 1
    assert [r["doc_id"] for r in sorted(mix(docs, seed=8).collect(), key=repr)] != [r["doc_id"] for r in sorted(mix(docs, seed=9).collect(), key=repr)]


def test_edges(edge, nothing):
    rows = mix(edge, name="chosen", share=1.0, epochs=1).collect()
    assert len(rows) >= edge.count() - 4  # documents without words need a whole pass
    assert mix(nothing, name="chosen").count() == 0
    assert mix(edge, name="chosen").columns == [*edge.columns, "chosen"]
    with pytest.raises(ValueError):
        mix(edge)


def test_query_with_a_column_of_that_name(spark, edge, tmp_path):
    edge.write.parquet(f"file://{tmp_path}/documents.parquet")
    out = op4_mixing(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "domain", "lang", "source", "tokens", "epoch", "take"] and out.count() > 0


def test_domains_may_be_named(spark):
    ends = plan(docs_of(spark), domains={f"s{i}": "news" for i in range(3)}).collect()
    assert {r["source"] for r in ends if r["domain"] == "news"} == {"s0", "s1", "s2"}


def test_documents_are_cut_where_the_prefix_ends(spark, edge, nothing):
    docs = docs_of(spark).withColumn("text", F.concat(F.lit(" \t"), "text")).withColumn("n_chars", F.length("text"))
    out = mixed_documents(docs, share=1.3, epochs=3)
    assert out.columns == docs.columns
    words = lambda t: len((t or "").split())
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows, ends = out.collect(), plan(docs, share=1.3, epochs=3).collect()
    assert sum(words(r["text"]) for r in rows) == sum(r["budget"] for r in ends)
    assert all(whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in rows)
    assert any(whole[r["doc_id"]] != r["text"] for r in rows)
    assert mixed_documents(edge, share=1.0).columns == edge.columns and mixed_documents(nothing).count() == 0
