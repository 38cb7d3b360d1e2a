"""A stored knowledge base after changes against one that is built anew."""

import os

import pytest
from pyspark.sql import functions as F

from heartwood.operators import tree, vectors
from heartwood.plans.incremental import TABLES, StoredBase
from heartwood.plans.knowledge_base import KnowledgeBase

DOCS = "doc_name string, content string"


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-") and "/manifest/" not in d}


def text(k, extra=""):
    return f"# Doc {k}\n" + "\n".join(f"## Part {i}\nwords of part {i}. " + "more words " * 30 for i in range(k % 4)) + extra


def test_syncs_equal_a_full_build_and_leave_other_files(spark, tmp_path):
    path = str(tmp_path / "kb")
    docs = {f"d{k}": text(k) for k in range(40)}
    frame = lambda d: spark.createDataFrame(list(d.items()), DOCS)
    store = StoredBase(spark, path, buckets=32)
    assert store.sync(frame(docs)) == {"added": 40, "changed": 0, "deleted": 0, "rewritten": len(store.manifest)}
    before = files(path)
    assert store.sync(frame(docs)) == {"added": 0, "changed": 0, "deleted": 0, "rewritten": 0}
    assert files(path) == before
    changed = docs | {"d3": text(3, "\n## New\nend"), "new": text(2), "none": None}
    del changed["d7"]
    told = store.sync(frame(changed))
    assert (told["added"], told["changed"], told["deleted"]) == (2, 1, 1) and told["rewritten"] <= 4
    assert before <= files(path)
    again = StoredBase(spark, path)
    assert again.buckets == 32 and again.manifest == store.manifest
    full = KnowledgeBase.of(frame({k: v or "" for k, v in changed.items()}))
    got = again.base()
    for name in TABLES:
        a, b = getattr(got, name), getattr(full, name)
        assert set(a.columns) == set(b.columns) and rows_of(a) == rows_of(b)
    assert rows_of(again.statistics()) == rows_of(tree.statistics(full.nodes))
    assert rows_of(again.vector_statistics()) == rows_of(vectors.vector_statistics(full.node_vectors, full.chunk_vectors))
    assert rows_of(again.summary_coverage()) == rows_of(tree.summary_coverage(full.nodes))
    assert rows_of(again.listing()) == rows_of(tree.listing(full.nodes, full.docs))
    assert [r["doc_name"] for r in again.tombstones().collect()] == ["d7"]
    assert again.vacuum() > 0
    assert rows_of(StoredBase(spark, path).base().nodes) == rows_of(full.nodes)
    assert got.search("words of part 2", "vector").count() > 0


def test_partial_syncs_delete_nothing_and_halves_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "kb")
    store = StoredBase(spark, path, buckets=4)
    with pytest.raises(ValueError):
        store.base()
    store.sync(spark.createDataFrame([("a", "# A"), ("b", "# B"), (None, "x"), ("a", "")], DOCS))
    assert store.sync(spark.createDataFrame([("c", "# C")], DOCS), complete=False)["deleted"] == 0
    assert sorted(r[0] for r in store.base().docs.select("doc_name").collect()) == ["a", "b", "c"]
    # A version without its manifest is one that died halfway.
    spark.range(1).select(F.lit("a").alias("doc_name"), F.lit("lost").alias("content"), F.lit(0).alias("bucket")).write.partitionBy("bucket").parquet(f"{path}/docs/version=3")
    assert sorted(r[0] for r in StoredBase(spark, path).base().docs.select("content").collect()) == ["# A", "# B", "# C"]
    told = store.sync(spark.createDataFrame([], DOCS))
    assert (told["added"], told["changed"], told["deleted"]) == (0, 0, 3)
    assert store.base().nodes.count() == 0 and store.totals()["nodes"] == 0


def test_documents_saved_and_read_as_files(spark, tmp_path):
    from heartwood.sources import tables

    docs = spark.createDataFrame([("a b%20c", "# T \"q\"\n## S\nline\n\nend"), ("é", "text")], DOCS)
    kb = KnowledgeBase.of(docs)
    kb.save_documents(str(tmp_path / "x"))
    found, nodes = tables.index_files(spark, str(tmp_path / "x" / "index"))
    assert sorted(r[0] for r in found.select("doc_name").collect()) == ["a b%20c", "é"]
    want = kb.nodes.select("doc_name", "node_id", "title", "content")
    assert rows_of(nodes.select("doc_name", "node_id", "title", "content")) == rows_of(want)
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "one_index.json").write_text(tables.nested_json(kb.docs, kb.nodes, True).where("doc_name = 'é'").first()["json"], encoding="utf-8")
    assert [r["doc_name"] for r in tables.index_files(spark, str(tmp_path / "y"))[0].collect()] == ["one"]
