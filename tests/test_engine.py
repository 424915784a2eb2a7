"""The library object: builds, pins, no-ops, deltas, compaction, guards."""

from __future__ import annotations

import random

import pytest

from strataquery.engine import Library
from strataquery.operators import index as ix
from strataquery.operators import retrieval as rt
from tests.test_operators import CHUNK, chunk


def frame(spark, docs):
    return spark.createDataFrame([chunk(k, i, f"Title {k}", t) for k, v in docs.items() for i, t in enumerate(v)], CHUNK)


def test_library(spark, tmp_path):
    lib = Library(spark, (tmp_path / "lib").as_uri())
    assert lib.snapshot is None and lib.search("alpha").count() == 0 and lib.snapshot_info() is None
    docs = {"a": ["alpha beta", "gamma"], "b": ["alpha [[note:a]]"], "c": ["delta"]}
    assert lib.build(frame(spark, docs)) == "base" and lib.build(frame(spark, docs)) == "no_op"
    pinned = lib.snapshot
    docs = {"a": ["alpha alpha"], "b": docs["b"], "d": ["epsilon"]}
    assert lib.build(frame(spark, docs), compact=False) == "delta" and lib.snapshot != pinned
    q = spark.createDataFrame([("q1", "alpha title"), ("q2", "delta"), ("q3", "epsilon")], "query_id string, query string")
    got = [tuple(r) for r in lib.search(q).collect()]
    clean = rt.multi_path(q, ix.build(frame(spark, docs)), 20).orderBy("query_id", "rank").collect()
    assert [(g[0], g[1], g[3], g[7]) for g in got] == [(c["query_id"], c["rank"], c["chunk_id"], c["score"]) for c in clean]
    assert not any(g[0] == "q2" for g in got)
    assert lib.compact() == "base" and [tuple(r) for r in lib.search(q).collect()] == got
    with pytest.raises(ValueError):
        lib.compact()
    assert [r["doc_key"] for r in lib.list_documents("note").collect()] == ["note:a", "note:b", "note:d"]
    assert lib.read_document("note:a").count() == 1 and lib.read_section("a-0") == "alpha alpha" and lib.read_section("zz") is None
    cat = spark.createDataFrame([("note:a", "note", "A", [], None), ("note:b", "note", "B", [], None)], "doc_id string, doc_type string, title string, aliases array<string>, status string")
    links = lib.links(cat)
    assert links.backlinks("note:a").first()["source_id"] == "note:b" and links.neighborhood("note:a").count() == 1
    old = Library(spark, (tmp_path / "lib").as_uri())
    old.snapshot = pinned
    assert old.search("delta").count() == 1
    for bad in (0, 101, True, "x"):
        with pytest.raises(ValueError):
            lib.search("a", bad)
    with pytest.raises(TypeError):
        lib.search(5)
    with pytest.raises(ValueError):
        lib.build(frame(spark, docs), "other")


def test_a_delta_costs_what_changed(spark, tmp_path):
    """Of 400 documents one changes: what is written and read is in proportion to it; a build without changes writes nothing."""
    rng = random.Random(6)
    docs = {f"d{i}": ["alpha " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))] for i in range(400)}
    root = tmp_path / "lib"
    on_disk = lambda: sum(f.stat().st_size for f in root.rglob("*") if f.is_file() and not f.name.startswith("."))
    lib = Library(spark, root.as_uri())
    assert lib.build(frame(spark, docs)) == "base"
    base, files = on_disk(), len(list(root.rglob("*")))
    assert lib.build(frame(spark, docs)) == "no_op" and on_disk() == base and len(list(root.rglob("*"))) == files
    docs["d7"] = ["alpha changed"]
    assert lib.build(frame(spark, docs)) == "delta" and not lib.compaction_due()
    assert on_disk() - base < base / 5
    view = lib.view()
    touched = spark.createDataFrame([("note:d7",)], "doc_key string")
    plan = view.owned(touched)[1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    clean = ix.build(frame(spark, docs))
    assert lib.snapshot_info().asDict() == clean.totals.asDict()
    assert {tuple(r) for r in lib.index().stats.collect()} == {tuple(r) for r in clean.stats.collect()}
    del docs["d8"]
    assert lib.build(frame(spark, docs)) == "delta" and lib.snapshot_info().documents == 399 and lib.read_document("note:d8").count() == 0
    assert lib.build(frame(spark, {k: ["new text"] for k in docs})) == "compacted" and lib.view().layers == 1


def test_truncation(spark):
    from pyspark.sql import functions as F

    cases = [("short", 10, "short"), ("aa\n\nbb\ncc", 6, "aa\nbb"), ("One two. 好的。再见。", 12, "One two. 好的。"[:12]), ("x" * 50, 7, "x" * 7), (None, 5, "")]
    for text, most, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(rt.truncated(F.col("t"), most).alias("x")).first()["x"] == want
