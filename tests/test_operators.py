"""Joins under skew, table differences, incremental processing, layers, links, sources, snapshots and streams."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataquery.operators import chunking as ck
from strataquery.operators import incremental as inc
from strataquery.operators import index as ix
from strataquery.operators import layers as ly
from strataquery.operators import links as lk
from strataquery.operators.quantiles import exact_rank
from strataquery.operators.skew import hot_keys, skew_join
from strataquery.operators.table_diff import diff, unequal_buckets
from strataquery.session import scratch
from strataquery.sources import files as fs
from strataquery.sources.snapshots import SnapshotStore, conflicts
from strataquery.streaming import incremental as si
from tests.test_retrieval import CHUNK


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_the_plain_join(spark, how):
    rng = random.Random(1)
    many = spark.createDataFrame([(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}" if i % 7 else None) for i in range(1000)], "id int, k string")
    one = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), ("zz", 4)], "k string, v int")
    assert "hot" in hot_keys(many, "k")
    cols = sorted(many.join(one, "k", how).columns)
    assert rows_of(skew_join(many, one, "k", "id", how).select(*cols)) == rows_of(many.join(one, "k", how).select(*cols))


def test_hot_and_null_keys_are_spread(spark):
    """A key of 60 %, one of 1 % and nulls: each gets its share of the partitions, and nothing is lost."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        many = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 100 == 7, "one").when(F.col("id") % 10 == 8, None).otherwise(F.concat(F.lit("k"), "id")).alias("k"))
        hot = hot_keys(many, "k")
        assert set(hot) == {"big", "one"} and 0.6 < hot["big"] < 0.8
        one = spark.createDataFrame([("big", 1), ("one", 2), ("k19", 3)], "k string, v int")
        for how in ("inner", "left", "left_semi", "left_anti"):
            got = skew_join(many, one, "k", "id", how)
            assert got.count() == many.join(one, "k", how).count()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r["n"] for r in skew_join(many, one, "k", "id", "left").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 20_000 / 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_exact_rank(spark):
    rng = random.Random(2)
    vals = [("a" if i % 3 else "b", rng.choice([rng.gauss(0, 1), 0.5])) for i in range(6000)] + [("c", 1.0), ("c", None), ("d", None)]
    got = {r["k"]: r["v"] for r in exact_rank(spark.createDataFrame(vals, "k string, x double"), "k", "x", 0.95, lambda n: F.ceil(n * 0.95) - 1, "v").collect()}
    for k in "abc":
        own = sorted(x for kk, x in vals if kk == k and x is not None)
        assert got[k] == own[-(-95 * len(own) // 100) - 1]
    assert "d" not in got


SIDE = "k1 string, k2 int, a string, b array<string>, extra string"


def brute_diff(left, right):
    pick = lambda rows: {(r[0], r[1]): (r[2], r[3]) for r in sorted(rows, key=repr)}
    a, b = pick(left), pick(right)
    out = [(*k, "missing_in_right", "") for k in a if k not in b] + [(*k, "missing_in_left", "") for k in b if k not in a]
    for k in a:
        if k in b:
            out += [(*k, "changed", f) for f, x, y in zip(("a", "b"), a[k], b[k]) if x != y]
    return sorted(map(repr, out))


def test_diff(spark):
    rng = random.Random(3)
    left = [(f"d{i % 50}", i, rng.choice(["x", "", None]), rng.choice([["p"], [], None]), "z") for i in range(300)] + [(None, None, "n", None, "z")]
    right = [r if rng.random() < 0.9 else (r[0], r[1], rng.choice(["x", "", None]), rng.choice([["p"], [], None]), "y") for r in left if rng.random() < 0.95] + [("new", 1, None, None, "q")]
    right += right[:20]
    rng.shuffle(right)
    a, b = spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE)
    got = sorted(map(repr, map(tuple, diff(a, b, ["k1", "k2"], ["a", "b"], buckets=16).collect())))
    assert got == brute_diff(left, right)
    levels = diff(a, b, ["k1", "k2"], ["a", "b"], buckets=300, split=8)  # three levels
    assert sorted(map(repr, map(tuple, levels.collect()))) == brute_diff(left, right)
    same = diff(a, a.union(a.limit(0)), ["k1", "k2"], ["a", "b"])
    assert same.count() == 0
    empty = spark.createDataFrame([], SIDE)
    assert diff(empty, empty, ["k1", "k2"], ["a", "b"]).count() == 0
    assert diff(a, empty, ["k1", "k2"], ["a", "b"]).count() == len(left)


def test_unequal_buckets_name_the_column(spark):
    a = spark.createDataFrame([("x", i, "v", None, "") for i in range(100)], SIDE)
    b = a.withColumn("a", F.when(F.col("k2") == 7, "w").otherwise(F.col("a")))
    found = unequal_buckets(a, b, ["k1", "k2"], ["a", "b"], 32).collect()
    assert len(found) == 1 and found[0]["fields"] == ["a"] and not found[0]["key_differs"]


T0 = dt.datetime(2025, 1, 1)
CAP = "doc_key string, content_hash string, segment_recipe_hash string, deleted boolean, captured_at timestamp, arrived_at timestamp, slug string"
SEG = "doc_key string, content_hash string, segment_recipe_hash string, run_id int, stored_at timestamp"


def at(n):
    return T0 + dt.timedelta(days=n)


def test_pending(spark):
    caps = [
        ("note:a", "AA", "r", False, at(5), at(5), ""),
        ("note:a", "old", "r", False, at(1), at(9), ""),  # late
        ("note:é".replace("é", "é"), "h1", "r", False, at(2), at(2), ""),
        ("note:gone", None, "r", True, at(8), at(8), ""),
        ("note:gone", "x", "r", False, at(1), at(1), ""),
        ("note:unread", None, "r", False, at(9), at(9), ""),
        ("note:unread", "u1", "r", None, at(1), at(1), ""),
        ("note:new", "n", "r", False, at(1), at(1), ""),
        ("note:new", "n", "r", False, at(1), at(2), ""),
        (None, "z", "r", False, at(1), at(1), ""),
    ]
    segs = [("note:a", "aa", "R", 1, at(1)), ("note:a", "bb", "r", 2, at(9)), ("note:é", "h0", "r", 1, at(1)), ("note:unread", "U1", "r", 1, at(1)), ("note:new", "n", "r", 2, at(1))]
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed")], "run_id int, status string")
    got = {(r["doc_key"], r["change"]) for r in inc.pending(inc.listing(spark.createDataFrame(caps, CAP)), inc.manifest_of_runs(spark.createDataFrame(segs, SEG), runs), scratch(spark)).collect()}
    assert got == {("note:é", "changed"), ("note:new", "added")}
    none = inc.pending(inc.listing(spark.createDataFrame([], CAP)), inc.manifest_of_runs(spark.createDataFrame([], SEG), runs), scratch(spark))
    assert none.count() == 0


def test_file_manifest_survives_failures(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("two")
    m = inc.FileManifest(spark, (tmp_path / "out").as_uri())
    read = lambda todo: todo.select("path", "checksum")

    def broken(todo):
        read(todo).write.mode("overwrite").parquet(str(tmp_path / "out/data/batch=half"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        m.run_files(src.as_uri(), broken)
    assert m.committed().count() == 0
    first = m.run_files(src.as_uri(), read)
    assert m.result().count() == 2 and m.run_files(src.as_uri(), read) is None
    (src / "b.txt").write_text("changed")
    (src / "c.txt").write_text("three")
    second = m.run_files(src.as_uri(), read)
    assert first != second and m.result().where(F.col("batch") == second).count() == 2 and m.pending_files(src.as_uri()).count() == 0


def test_manifest_of_a_file_that_returns(spark, tmp_path):
    """A, B and A again are three batches, and only a file's newest rows count."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "other.txt").write_text("other")
    m = inc.FileManifest(spark, (tmp_path / "out").as_uri())
    read = lambda todo: todo.select("path", "checksum")
    batches = []
    for text in ("A", "B", "A"):
        (src / "a.txt").write_text(text)
        batches.append(m.run_files(src.as_uri(), read))
        rows = {r["path"].rpartition("/")[2]: (r["checksum"], r["batch"]) for r in m.result().collect()}
        assert m.result().count() == 2 and rows["a.txt"] == (hashlib.sha256(text.encode()).hexdigest(), batches[-1]) and rows["other.txt"][1] == batches[0]
        assert m.run_files(src.as_uri(), read) is None
    assert len(set(batches)) == 3
    with pytest.raises(ValueError):
        (src / "a.txt").write_text("C")
        m.run_files(src.as_uri(), lambda todo: todo.select("checksum"))


def test_manifest_commits_what_was_processed(spark, tmp_path):
    """Files that come, change or go while the work runs are left for the next run; a kill before any step skips and repeats nothing."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("two")
    m = inc.FileManifest(spark, (tmp_path / "out").as_uri())

    def work(todo):
        (src / "late.txt").write_text("late")
        (src / "a.txt").write_text("one, changed")
        (src / "b.txt").unlink(missing_ok=True)
        return todo.select("path", "checksum")

    names = lambda df: sorted(r["path"].rpartition("/")[2] for r in df.collect())
    first = m.run_files(src.as_uri(), work)
    assert names(m.committed()) == ["a.txt", "b.txt"] and names(m.pending_files(src.as_uri())) == ["a.txt", "late.txt"]
    assert m.run_files(src.as_uri(), lambda todo: todo.select("path", "checksum")) != first and names(m.result()) == ["a.txt", "b.txt", "late.txt"]
    for step in ("_stage", "_commit"):
        (src / "a.txt").write_text(f"before {step}")
        broken = inc.FileManifest(spark, m.root)

        def stop(*_):
            raise RuntimeError("killed")

        setattr(broken, step, stop)
        with pytest.raises(RuntimeError):
            broken.run_files(src.as_uri(), lambda todo: todo.select("path", "checksum"))
        assert names(m.pending_files(src.as_uri())) == ["a.txt"]
        assert m.run_files(src.as_uri(), lambda todo: todo.select("path", "checksum")) and names(m.result()) == ["a.txt", "b.txt", "late.txt"]
    with pytest.raises(ValueError):
        m.adopt(m.committed())


def chunk(doc, i, title, body):
    return (f"{doc}-{i}", f"note:{doc}", f"n{i}", 0, i, title, ["top"], body, None, None, None, f"{i:04d}", None, None)


WORDS = st.lists(st.sampled_from(["alpha", "beta", "gamma", "相变", "delta"]), max_size=6).map(" ".join)
SCRIPT = st.lists(st.tuples(st.sampled_from("abcd"), st.one_of(st.none(), st.lists(WORDS, min_size=1, max_size=2))), min_size=1, max_size=3)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(SCRIPT)
def test_incremental_equals_clean(spark, script):
    """Any edit script: statistics and postings of base and deltas are those of a rebuild."""
    state = {x: [f"{x} alpha beta"] for x in "abc"}
    frame = lambda docs: spark.createDataFrame([chunk(k, i, "Title alpha", t) for k, v in docs.items() for i, t in enumerate(v)], CHUNK).drop("loaded_at", "n")
    view = ly.base_view(frame(state))
    for n, (doc, texts) in enumerate(script, 1):
        if texts is None:
            state.pop(doc, None)
            view = ly.add_delta(view, frame({}), spark.createDataFrame([(f"note:{doc}",)], "doc_key string"), n)
        else:
            state[doc] = texts
            view = ly.add_delta(view, frame({doc: texts}), spark.createDataFrame([], "doc_key string"), n)
    clean = ix.postings(frame(state))
    cols = ["token", "chunk_id", "title_tf", "breadcrumb_tf", "body_tf"]
    assert rows_of(view.active().select(cols)) == rows_of(clean.select(cols))
    assert rows_of(view.token_stats().select("token", "df_any", "df_nonbody", "df_body")) == rows_of(ix.token_stats(clean).select("token", "df_any", "df_nonbody", "df_body"))
    assert rows_of(ly.compact(view).postings.select(cols)) == rows_of(clean.select(cols))


def test_change_set_and_violations(spark):
    b = spark.createDataFrame([("a", "1", "r"), ("b", "1", "r"), ("c", None, "r")], "doc_key string, content_hash string, recipe_hash string")
    n = spark.createDataFrame([("a", "1", "r"), ("b", "1", "s"), ("d", "9", "r")], "doc_key string, content_hash string, recipe_hash string")
    assert {tuple(r) for r in ly.change_set(b, n).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "added")}
    c = spark.createDataFrame([chunk("a", 0, "t t", "x y")], CHUNK)
    p = ix.postings(ix.distinct_chunks(c))
    assert ly.violations(p, c).count() == 0
    assert ly.violations(p.withColumn("title_tf", F.lit(9)), c).count() > 0
    for mode in ("normal", "sampled", "deep"):
        assert ly.validate(p, ix.distinct_chunks(c), ix.token_stats(p), mode, share=1.0).count() == 0
    assert [tuple(r) for r in ly.validate(p.where("title_tf > 0"), ix.distinct_chunks(c), ix.token_stats(p), "sampled", share=1.0).collect()] == [("posting missing", p.count())]
    with pytest.raises(ValueError):
        ly.validate(p, c, p, "other")
    ids = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_key string, segment_hash string")
    assert ly.generation_id(ids).first() == ly.generation_id(ids.orderBy(F.desc("doc_key"))).first() != ly.generation_id(ids.limit(1)).first()


TEXT = """# Head
See [[note:ok|alias]] and [text](../notes/ok.md#heading) but not `[[code]]` or ![i](x.png).
~~~
[[fenced]]
```
[[still fenced]]
~~~
[out](https://x.org) [[Same]] [[Only#part]] [[missing]]"""


def test_links(spark):
    texts = spark.createDataFrame([("note:src", "s.md", TEXT), ("note:src", "t.md", None), ("note:src", "u.md", "")], "source_id string, source_md string, text string")
    parsed = lk.parse_links(texts)
    got = [(r["target"], r["alias"], r["anchor"], r["line"], r["syntax"], r["source_heading"]) for r in parsed.orderBy("line", "column").collect()]
    assert got == [("note:ok", "alias", None, 2, "wikilink", "Head"), ("../notes/ok.md", "text", "heading", 2, "markdown", "Head"), ("Same", None, None, 8, "wikilink", "Head"), ("Only", None, "part", 8, "wikilink", "Head"), ("missing", None, None, 8, "wikilink", "Head")]
    cat = spark.createDataFrame([("note:src", "note", "Source", [], "draft"), ("note:ok", "note", "Ok", ["Fine"], "draft"), ("book:s1", "book", "Same", None, "draft"), ("paper:s2", "paper", "same ", None, "archived"), ("book:only", "book", "ONLY", [], "archived")], "doc_id string, doc_type string, title string, aliases array<string>, status string")
    heads = spark.createDataFrame([("note:ok", "heading", "0007")], "doc_id string, key string, node_id string")
    e = lk.resolve(parsed, cat, heads)
    res = {r["target"]: (r["status"], r["target_id"], r["candidates"], r["target_node_id"]) for r in e.collect()}
    assert res["note:ok"] == ("resolved", "note:ok", 1, None) and res["../notes/ok.md"] == ("resolved", "note:ok", 1, "0007")
    assert res["Same"][:3] == ("ambiguous", None, 2) and res["Only"][:2] == ("resolved", "book:only") and res["missing"][:3] == ("broken", None, 0)
    back = {(r["doc_id"], r["source_id"], r["occurrences"]) for r in lk.backlinks(e, cat).collect()}
    assert back == {("note:ok", "note:src", 2), ("book:only", "note:src", 1)}
    near = lk.neighborhood(e, cat)
    assert {(r["doc_id"], r["neighbor"], r["priority"]) for r in near.collect()} == {("note:src", "note:ok", 1), ("note:ok", "note:src", 2), ("book:only", "note:src", 2)}
    assert lk.shown_edges(e, near).count() >= 2
    out = {r["source_md"]: r["text"] for r in lk.export_text(texts, lk.resolve(lk.wikilinks(texts), cat), cat).collect()}
    assert '[alias](doc://note:ok "note:ok")' in out["s.md"] and "[[missing]]" in out["s.md"] and out["t.md"] == ""
    odd = spark.createDataFrame([("note:src", "o.md", r"`[[note:ok|a\E$1]]` ![[note:ok|a\E$1]] [[note:ok#Part|b]][[note:ok]]")], "source_id string, source_md string, text string")
    text = lk.export_text(odd, lk.resolve(lk.wikilinks(odd), cat), cat).first()["text"]
    assert text == r'`[a\E$1](doc://note:ok "note:ok")` ![[note:ok|a\E$1]] [b](doc://note:ok#Part "note:ok")[Ok](doc://note:ok "note:ok")'
    prov = lk.provenance(spark.createDataFrame([("note:a", ["note:b", "http://x"]), ("note:b", None)], "doc_id string, sources array<string>"))
    assert [tuple(r)[:2] for r in prov.collect()] == [("note:a", "note:b")]
    with pytest.raises(ValueError):
        lk.neighborhood(e, cat, 0)


def test_chunking(spark):
    t = spark.createDataFrame([(1, "x" * 500), (2, "ab" * 475), (3, "  \n "), (4, None)], "id int, t string").select("id", ck.windows(F.col("t")).alias("w"))
    got = {r["id"]: r["w"] for r in t.collect()}
    assert got[1] == ["x" * 500] and got[3] == [] and got[4] == []
    assert [len(w) for w in got[2]] == [500, 500, 150] and got[2][1].startswith(("ab" * 475)[400:410])
    md = "---\ntitle: T\n---\n# A\ntext\n## B\n```\n# no\n```\n1.1 numbered\n## B\nend"
    lines = ck.lines_of(spark.createDataFrame([("d", md), ("e", None)], "k string, t string"), "k", "t")
    h = [(r["level"], r["title"], r["path"]) for r in ck.headings(lines, "k").orderBy("pos").collect()]
    assert h == [(1, "A", ["A"]), (2, "B", ["A", "B"]), (2, "B", ["A", "B"])]
    p = ck.pseudo_headings(lines).collect()
    assert [(r["number"], r["depth"], r["promoted"]) for r in p] == [("1.1", 2, "## 1.1 numbered")]
    n = ck.node_keys(spark.createDataFrame([("d", "p", ["A"], 0), ("d", "p", ["A"], 5)], "doc_key string, path string, breadcrumb array<string>, pos int")).collect()
    assert {r["duplicate_ordinal"] for r in n} == {0, 1} and len({r["node_key"] for r in n}) == 2
    assert spark.createDataFrame([("a\nb\nc",)], "t string").select(ck.section(F.col("t"), F.lit(1), F.lit(None).cast("int")).alias("s")).first()["s"] == "b\nc"


def test_sources(spark, tmp_path):
    for p, t in {"books/b/_index.md": "x", "books/b/ch1.md": "y", "books/_skip/_index.md": "z", "books/alone/_index.md": "q", "papers/p/_index.md": "p", "papers/loose.md": "l", "notes/n.md": "---\ntitle: N\ntags: [a, b]\nsource:\n- note:x\n- http://y\nconfidence: 0.5\n---\nbody", "notes/bad.md": "---\ntitle: N"}.items():
        f = tmp_path / "content" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    tree = fs.read_tree(spark, (tmp_path / "content").as_uri())
    docs = fs.discover(tree)
    assert [r["doc_key"] for r in docs.collect()] == ["book:b", "paper:p", "note:bad", "note:n"]
    rec = fs.file_records(tree)
    assert fs.document_fingerprints(docs, rec).count() == 4
    cache = tree.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
    cached = fs.cached_records(fs.list_tree(spark, (tmp_path / "content").as_uri()), cache.limit(3))
    assert rows_of(cached.select("path", "sha256")) == rows_of(cache.select("path", "sha256")) and cached.where("reused").count() == 3
    front = fs.parse_frontmatter(tree.select("path", F.col("content").cast("string").alias("text")))
    by = {r["path"].rsplit("/", 1)[1]: r for r in front.collect()}
    assert by["n.md"]["meta"]["source"] == "note:x\x1fhttp://y" and by["n.md"]["body"] == "body" and by["bad.md"]["error"]
    gov = {r["path"].rsplit("/", 1)[1]: r for r in fs.governance(front).collect()}
    assert gov["n.md"]["sources"] == ["note:x", "http://y"] and gov["n.md"]["confidence"] == 0.5 and gov["n.md"]["problem"] is None
    assert fs.missing_governance(front).count() > 0
    pages = spark.createDataFrame([("1-3,7", 5), (None, 2), ("2", 9), ("8-20", 10), ("x", 3)], "p string, n int").select(fs.page_list(F.col("p"), F.col("n")).alias("l")).collect()
    assert [r["l"] for r in pages[:4]] == [[0, 1, 2], [0, 1], [1], [7, 8, 9]]
    safe = [r["s"] for r in spark.createDataFrame([("a/b.md",), ("../x",), ("C:/x",), ("/abs",), ("a/../b",), (None,)], "p string").select(fs.is_safe_path(F.col("p")).alias("s")).collect()]
    assert safe == [True, False, False, False, False, False]


def test_snapshot_of_a_changing_tree(spark, tmp_path, monkeypatch):
    """A file that changes between two listings is read again; a tree that never rests is an error."""
    root = tmp_path / "notes"
    root.mkdir()
    (root / "a.md").write_text("one")
    (root / "b.md").write_text("two")
    listing, calls = fs.list_tree, []

    def disturbed(*args):
        calls.append(1)
        if len(calls) == 2 or endless:
            (root / "a.md").write_text("changed" * len(calls))
        return listing(*args)

    endless = False
    monkeypatch.setattr(fs, "list_tree", disturbed)
    got = {r["path"][-4:]: r["sha256"] for r in fs.stable_records(spark, root.as_uri()).collect()}
    assert got == {"a.md": hashlib.sha256(b"changedchanged").hexdigest(), "b.md": hashlib.sha256(b"two").hexdigest()} and len(calls) == 3
    endless = True
    with pytest.raises(RuntimeError):
        fs.stable_records(spark, root.as_uri())


def test_books(spark):
    from strataquery.sources.books import epub_bytes, read_epubs

    good = epub_bytes("T", ["<h1>One &amp; two</h1><p>a <b>b</b></p><script>x()</script>", "<ul><li>c</li></ul>"])
    rows = spark.createDataFrame([("g", bytearray(good)), ("bad", bytearray(b"no zip")), ("cut", bytearray(good[:80])), ("none", bytearray(epub_bytes("T", [])))], "path string, content binary")
    got = sorted((r["path"], r["position"], r["title"], r["text"], r["error"] is None) for r in read_epubs(rows).collect())
    assert got == [("bad", -1, None, None, False), ("cut", -1, None, None, False), ("g", 0, "One & two", "# One & two\n\na b", True), ("g", 1, None, "- c", True)]


def test_citations_and_codes(spark):
    from strataquery.functions.varint import decode_varint, encode_varint

    urls = F.create_map(F.lit(1), F.lit("/a"), F.lit(2), F.lit("b"))
    cases = [("[1] the `[2]` one\n[2](x)[1] [3]\n``[1]``\n```\n[1]\n```", "[1] [the `[2]` one](/r/a)\n[2](/r/b)[1](/r/a) [3]\n``[1](/r/a)``\n```\n[1]\n```"), (None, ""), ("", ""), ("[99999999999] x", "[99999999999] x"), ("plain", "plain")]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(lk.cited(F.col("t"), urls, "/r").alias("x"))
    assert [r["x"] for r in df.collect()] == [w for _, w in cases]
    values = [0, 1, 127, 128, 300, 2**31, 2**62, 2**63 - 1]
    coded = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", encode_varint(F.col("v")).alias("e")).select("v", "e", decode_varint(F.col("e")).alias("d")).collect()
    assert all(r["v"] == r["d"] for r in coded) and bytes(coded[4]["e"]) == b"\xac\x02"
    bad = spark.createDataFrame([(bytearray(b),) for b in (b"", b"\x80", b"\x81\x00", b"\x01\x01", b"\xff" * 10)], "e binary").select(decode_varint(F.col("e")).alias("d"))
    assert all(r["d"] is None for r in bad.collect())
    assert spark.createDataFrame([(-1,), (None,)], "v bigint").select(encode_varint(F.col("v")).alias("e")).where("e is not null").count() == 0


def test_published_documents(spark, tmp_path):
    docs = spark.createDataFrame([("book", "b 1", None, "", [], "x"), ("note", "ü", 'a "q"', "A", ["t", "u"], None), ("paper", "p", "", None, None, "y"), ("other", "o", "O", None, None, "z"), ("note", "../evil", "E", None, None, "z")], "doc_type string, slug string, title string, author string, tags array<string>, text string")
    assert fs.publish_documents(docs, (tmp_path / "c").as_uri()) == 4
    found = {str(f.relative_to(tmp_path / "c")): f.read_text() for f in (tmp_path / "c").rglob("*.md")}
    assert found == {"books/b 1/_index.md": '---\ntitle: "b 1"\n---\nx', "notes/ü.md": '---\ntitle: "a \\"q\\""\nauthor: "A"\ntags: ["t", "u"]\n---\n', "papers/p/_index.md": '---\ntitle: "p"\n---\ny', "notes/o.md": '---\ntitle: "O"\n---\nz'}
    assert fs.read_tree(spark, (tmp_path / "c").as_uri()).count() == 4


def test_migration(spark, tmp_path):
    texts = spark.createDataFrame([("a.md", "---\ntitle: T\n---\nbody\n---"), ("b.md", "plain"), ("c.md", "---\nbroken"), ("d.md", "---\nid: d\ntitle: D\n---\n"), ("e.md", None), ("f.md", "---\nid: d\n---\nx")], "path string, text string")
    got = {r["path"]: (r["text"], r["missing"]) for r in fs.migrated(texts, {"id": F.col("path"), "title": F.lit("new")}).collect()}
    assert got == {"a.md": ("---\ntitle: T\nid: a.md\n---\nbody\n---", ["id"]), "b.md": ("---\nid: b.md\ntitle: new\n---\nplain", ["id", "title"]), "e.md": ("---\nid: e.md\ntitle: new\n---\n", ["id", "title"]), "f.md": ("---\nid: d\ntitle: new\n---\nx", ["title"])}
    assert [tuple(r) for r in fs.conflicting_ids(fs.parse_frontmatter(texts)).collect()] == [("d", 2)]


def test_segment_store(spark, tmp_path):
    from strataquery.sources.snapshots import SegmentStore

    s = SegmentStore(spark, (tmp_path / "s").as_uri())
    rows = lambda *x: spark.createDataFrame(x, "doc_key string, content_hash string, segment_recipe_hash string, payload string")
    told, bad = s.put(rows(("a", "1", None, "x"), ("a", "1", None, "x"), ("b", "1", "r", "y"), ("b", "1", "r", "z")))
    assert [(r["doc_key"], r["reused"]) for r in told.collect()] == [("a", False)] and [r["doc_key"] for r in bad.collect()] == ["b"]
    told, bad = s.put(rows(("a", "1", None, "x"), ("c", "1", "r", "w")))
    assert {(r["doc_key"], r["reused"]) for r in told.collect()} == {("a", True), ("c", False)} and bad.count() == 0
    told, bad = s.put(rows(("a", "1", None, "other")))
    assert told.count() == 0 and bad.count() == 1
    assert {(r["doc_key"], r["payload"]) for r in s.get(rows(("a", "1", None, ""), ("zz", "1", "r", ""))).collect()} == {("a", "x")}


def test_snapshots(spark, tmp_path):
    s = SnapshotStore(spark, (tmp_path / "store").as_uri())
    assert s.current() is None
    one = s.put({"t": spark.range(3)})
    assert s.current() is None
    s.publish(one)
    two = s.put({"t": spark.range(5)})
    assert s.table("t").count() == 3
    s.publish(two)
    assert s.table("t").count() == 5 and s.table("t", one).count() == 3
    with pytest.raises(ValueError):
        s.publish("nothing")
    dup = spark.createDataFrame([("d", "c", "r", "h1"), ("d", "c", "r", "h2"), ("e", "c", "r", "h1")], "doc_key string, content_hash string, segment_recipe_hash string, segment_hash string")
    assert [r["doc_key"] for r in conflicts(dup).collect()] == ["d"]


def test_stream_maintains_statistics(spark, tmp_path):
    schema = spark.createDataFrame([], CHUNK).schema
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    first = spark.createDataFrame([chunk("a", 0, "alpha", "beta beta")], CHUNK)
    second = spark.createDataFrame([chunk("b", 0, "alpha", "gamma")], CHUNK)
    first.coalesce(1).write.mode("append").parquet(src)
    si.maintain(spark, src, schema, out, cp).awaitTermination()
    second.coalesce(1).write.mode("append").parquet(src)
    si.maintain(spark, src, schema, out, cp).awaitTermination()
    want = ix.token_stats(ix.postings(ix.distinct_chunks(first.unionByName(second))))
    assert rows_of(si.view_statistics(spark, out).select("token", "df_any", "df_body")) == rows_of(want.select("token", "df_any", "df_body"))
    assert si.signed_statistics(first, first).count() == 0
    again = spark.createDataFrame([chunk("a", 0, "alpha", "delta")], CHUNK)  # the chunk comes again, changed
    again.coalesce(1).write.mode("append").parquet(src)
    si.maintain(spark, src, schema, out, cp).awaitTermination()
    want = ix.token_stats(ix.postings(ix.distinct_chunks(again.unionByName(second))))
    assert rows_of(si.view_statistics(spark, out).select("token", "df_any", "df_body")) == rows_of(want.select("token", "df_any", "df_body"))


def test_numbered_is_row_number(spark):
    from pyspark.sql import Window as W

    from strataquery.operators.numbering import multiset_hash, numbered

    rng = random.Random(4)
    df = spark.createDataFrame([("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3]), f"id{i}") for i in range(500)], "k string, o int, id string").repartition(7)
    want = df.withColumn("i", F.row_number().over(W.partitionBy("k").orderBy("o", "id")) - 1)
    assert rows_of(numbered(df, ["k"], ["o", "id"], "i").select("id", "i")) == rows_of(want.select("id", "i"))
    assert [r["id"] for r in numbered(df, [], ["id"], "i").orderBy("i").collect()] == sorted(f"id{i}" for i in range(500))
    assert numbered(df.limit(0), ["k"], ["id"], "i").count() == 0
    h = lambda d: d.agg(multiset_hash(F.col("id")).alias("h")).first()["h"]
    assert h(df) == h(df.orderBy("id")) != h(df.union(df.limit(1)))


def test_headings_after_frontmatter(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [chunk("a", 0, "T", "---\ntitle: x\n---\n# Head\n1.2 Part\ntext")]
    spark.createDataFrame(rows, CHUNK).write.parquet(str(tmp_path / "chunks.parquet"))
    assert [r["title"] for r in queries()["idx_01_headings"](spark, str(tmp_path)).collect()] == ["Head"]
    assert [r["number"] for r in queries()["idx_20_pseudo_headings"](spark, str(tmp_path)).collect()] == ["1.2"]
