"""Retrieval operators against plain Python on small literals."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquery.functions import normalize as nz
from strataquery.functions import text as T
from strataquery.functions.synonyms import plain_tokens, table
from strataquery.operators import batch as bt
from strataquery.operators import index as ix
from strataquery.operators import nodes as nds
from strataquery.operators import retrieval as rt

CHUNK = "chunk_id string, doc_key string, node_key string, node_local_ordinal int, local_id int, title string, breadcrumb array<string>, body string, line_num string, line_end int, source_md string, node_id string, loaded_at timestamp, n string"
ROWS = [
    ("c1", "note:a", "n1", 0, 0, "Quantum Search", ["Guide"], "quantum search overview signal", "1", 3, "notes/a.md", "0001", None, "x"),
    ("c2", "note:a", "n2", 0, 1, "Overview", ["Guide"], "rarebody thermal thermal", None, None, "notes/a.md", "0002", None, "x"),
    ("c2", "note:a", "n2", 0, 1, "Overview", ["Guide"], "rarebody thermal thermal", None, None, "notes/a.md", "0002", None, "x"),
    ("c3", "book:b", "n3", 0, 0, "相变理论", ["物理", "凝聚态"], "相变与临界 search Rabi22", "1", 3, "books/b/ch1.md", "0001", None, "x"),
    ("c4", "paper:c", "n4", 0, 0, None, None, None, None, None, None, None, None, None),
    ("c5", "paper:c", "n5", 0, 1, "", [], "", None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def index(spark):
    return ix.build(spark.createDataFrame(ROWS, CHUNK))


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def reference_tokens(t: str) -> list[str]:
    pairs = [r[i : i + 2] for r in re.findall("[一-鿿]+", t or "") for i in range(len(r) - 1)]
    return [w.lower() for w in re.findall("[a-zA-Z][a-zA-Z0-9]+", t or "")] + re.findall(r"\d{2,}", t or "") + pairs


@pytest.mark.parametrize("t", ["Rabi22 and SPT 7 光 2024", "超辐射相变abc临界", "", None, "!!!", "a b cc 1 22 x1", "x" * 5000])
def test_tokens(spark, t):
    row = spark.createDataFrame([(t,)], "t string").select(T.tokenize(F.col("t")).alias("a"), T.tokenize_unique(F.col("t")).alias("u")).first()
    assert row["a"] == reference_tokens(t)
    assert row["u"] == list(dict.fromkeys(reference_tokens(t)))


def test_expansion(spark):
    got = [(r["token"], r["weight"]) for r in rt.query_tokens(queries(spark, "超辐射相变", None, "!!!")).orderBy("query_id", "ord").collect()]
    toks = reference_tokens("超辐射相变")
    want = dict.fromkeys(toks, 1.0)
    for k, syn in table():
        if k in "超辐射相变" or k in toks:
            for s in syn:
                want.setdefault(s, 0.6)
    assert got == list(want.items())
    assert plain_tokens("jaynes-cummings JC") == ["jaynes", "cummings", "jc"]


@pytest.mark.parametrize("raw,want", [("efﬁciency", "efficiency"), ("ﬂow", "flow"), ("L¨u", "Lü"), ("so­ft", "soft"), ("a b", "a b"), ("中文–数学 α", "中文–数学 α"), (None, "")])
def test_normalization(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    got = df.select(nz.normalize_for_search(F.col("t")).alias("t"))
    assert got.first()["t"] == want
    assert got.select(nz.normalize_for_search(F.col("t")).alias("t")).first()["t"] == want


def bm25f(query: str) -> dict[str, float]:
    """The scoring formula on the distinct rows, by hand."""
    rows = {r[0]: r for r in ROWS}
    fields = {c: (reference_tokens(r[5]), reference_tokens(" ".join(r[6] or [])), reference_tokens(r[7])) for c, r in rows.items()}
    n = len(rows)
    avg = [sum(len(f[i]) for f in fields.values()) / n for i in range(3)]
    out = {}
    for c, fs in fields.items():
        total = 0.0
        for t in dict.fromkeys(reference_tokens(query)):
            df = sum(any(t in f for f in g) for g in fields.values())
            for i, boost in enumerate((6, 3, 1)):
                tf = fs[i].count(t)
                if tf:
                    total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(fs[i]) / avg[i])) * boost
        if total > 0:
            out[c] = math.floor(total * 100 + 0.5) / 100
    return out


@pytest.mark.parametrize("q", ["rarebody", "quantum search", "overview", "Quantum Search Guide Overview", "signal signal", "thermal"])
def test_bm25f(spark, index, q):
    met = rt.matches(rt.query_tokens(queries(spark, q)), index)
    assert {r["chunk_id"]: r["score"] for r in rt.bm25f(met, index).collect()} == bm25f(q)


@pytest.fixture(scope="module")
def blocks(spark):
    """Queries, their tokens, an index without postings, and one with. Chunks of 30 documents, one of which has a third of them; words of any frequency, with many equal scores."""
    words = ["quantum", "search", "thermal", "signal", "phase", "mode", "相变", "field", "wave", "rare"]
    pick = lambda i, m: " ".join(w for j, w in enumerate(words) if (i * 7 + j * j * 3) % (j + 2) < m)
    rows = [(f"c{i:03}", f"note:{i % 3 and i % 30:02}", f"n{i}", 0, i // 30, pick(i, 1), [pick(i // 3, 1)], pick(i // 2, 2) if i % 11 else None, None, None, None, None, None, None) for i in range(400)]
    asks = ["quantum search", "相变 wave field", "rare", "thermal signal phase mode", "search search wave", "nothing here", None, "quantum thermal rare mode wave field signal phase"]
    q, i = queries(spark, *asks), ix.build(spark.createDataFrame(rows, CHUNK))
    return q, rt.asked(q, i), i, ix.Index(i.chunks, ix.cut(ix.postings(i.chunks)), i.stats, i.totals)


@pytest.mark.parametrize("block", [10, 60, 100_000])
@pytest.mark.parametrize("k,per_doc", [(1, 3), (7, 3), (60, 3), (20, None)])
def test_ranks_of_a_batch_in_blocks_are_those_of_all_its_rows(blocks, block, k, per_doc):
    q, known, i, by_token = blocks
    got = rt.ranked(known, i, k, per_doc, block)
    cols = ["query_id", "rank", "chunk_id", "doc_key", "node_key", "local_id", "ord", "score"]
    met = rt.matches(rt.query_tokens(q), by_token)
    rows_of = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows_of(got) == rows_of(rt.capped(rt.bm25f(met, by_token), k, per_doc=per_doc))


@pytest.mark.parametrize("block", [10, 100_000])
def test_routes_of_a_batch_in_blocks_are_those_of_all_its_rows(blocks, block):
    q, known, i, by_token = blocks
    got = sorted(map(tuple, rt.routed(known, i, 5, block).collect()))
    assert got == sorted(map(tuple, rt.routed_documents(rt.matches(rt.query_tokens(q), by_token)).collect()))


def test_columns_bound_the_ranks_of_a_query():
    """The first rows by columns of a large block, equal scores and capped documents included, are those of sorting all of it."""
    rng, size = np.random.default_rng(1), 20_000
    rows = [np.sort(rng.choice(size, n, replace=False)) for n in (15_000, 9_000, 40)]
    keys = np.concatenate([i * size + r for i, r in enumerate(rows)])
    values = rng.integers(1, 30, len(keys)) / 7
    docs = np.sort(np.where(rng.random(size) < 0.2, 0, rng.integers(0, 4_000, size)))
    batch = bt.Batch(["a", "b", "c"], ["x", "y", "z"], [0, 2, 3, 6], [0, 1, 2, 0, 1, 2], [1.0, 0.6, 1.0, 0.5, 1.0, 0.6], [0, 1, 0, 0, 1, 2], np.zeros(3, bool))
    shared = np.zeros(4_000, bool)
    shared[0] = True
    got = list(bt._ranked(batch, keys, values, size, 60, 100.0, docs, 3, shared))
    assert [g[0] for g in got] == [0, 1, 2]
    for q, found, scores, _ in got:
        total, first = np.zeros(size), np.full(size, 99)
        for j in range(batch.starts[q + 1] - 1, batch.starts[q] - 1, -1):
            first[rows[batch.code[j]]] = batch.ord[j]
        for j in range(batch.starts[q], batch.starts[q + 1]):
            t = batch.code[j]
            at = slice(*np.searchsorted(keys, [t * size, (t + 1) * size]))
            total[rows[t]] += batch.weight[j] * values[at]
        score, seen, want, own = np.floor(total * 100 + 0.5) / 100, {}, [], 0
        for r in sorted(np.flatnonzero(total > 0), key=lambda r: (-score[r], first[r], r)):
            seen[docs[r]] = seen.get(docs[r], 0) + 1
            if seen[docs[r]] <= 3 and own < 60:
                want.append(r)
                own += not shared[docs[r]]
        assert found.tolist() == want and scores.tolist() == score[want].tolist()


def test_ranks_of_a_large_batch_need_no_postings(spark, blocks):
    q, _, i, by_token = blocks
    many = q.crossJoin(spark.range(20)).select(F.concat_ws("-", "query_id", "id").alias("query_id"), "query")
    assert rt.multi_path(many, i).count() == 20 * rt.multi_path(q, by_token).count() > 0
    assert not i.sorted_by_token


def test_multi_path_is_total_and_ranked(spark, index):
    rows = rt.multi_path(queries(spark, "quantum search", "相变", "!!!", None), index).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in rows} == {"q0", "q1"}
    q0 = [r for r in rows if r["query_id"] == "q0"]
    assert q0[0]["chunk_id"] == "c1" and [r["rank"] for r in q0] == list(range(1, len(q0) + 1))
    assert rt.multi_path(queries(spark, "quantum"), index, 0).count() == 0


def test_pruning_hides_only_bodies(spark):
    rows = [(f"c{i}", f"note:{i}", f"n{i}", 0, 0, "common" if i == 0 else "other", [], "common body", None, None, None, None, None, None) for i in range(300)]
    i = ix.build(spark.createDataFrame(rows, CHUNK))
    q = rt.query_tokens(queries(spark, "common"))
    assert [r["chunk_id"] for r in rt.bm25f(rt.matches(q, i), i).collect()] == ["c0"]
    assert rt.bm25f(rt.matches(q, i, prune=False), i).count() == 300


def test_rrf_sums_over_chunks_of_a_node(spark):
    p = spark.createDataFrame([("q", "c1", "d", "n", 0, 2.0, 1), ("q", "c2", "d", "n", 1, 5.0, 2)], "query_id string, chunk_id string, doc_key string, node_key string, local_id int, score double, rank int")
    r = rt.rrf([p]).first()
    assert r["chunk_id"] == "c2" and r["rrf_score"] == round(1 / 61 + 1 / 62, 12)


def test_mmr_prefers_new_text():
    same, new = {"a b c d"}, {"x y z w"}
    assert rt._mmr_order([same, same, new], [1.0, 0.9, 0.8], 0.6, 3) == [0, 2, 1]
    assert rt._mmr_order([], [], 0.6, 3) == [] and rt._mmr_order([same], [1.0], 0.6, 3) == [0]


def test_packing_skips_what_is_too_large(spark):
    ctx = spark.createDataFrame([("q", 1, "a", 50), ("q", 2, "b", 500), ("q", 3, "c", 40), ("z", 1, "x", 900), ("z", 2, "y", 800), ("z", 3, "w", 700)], "query_id string, ord int, chunk_id string, cost int")
    got = {(r["query_id"], r["chunk_id"]) for r in rt.packed(ctx, F.col("cost"), 100).collect()}
    assert got == {("q", "a"), ("q", "c"), ("z", "x"), ("z", "y")}


@pytest.mark.parametrize("cov,rrf,title,margin,src,want", [(0.4, 0.9, True, 1.0, 9, "low"), (0.7, 0.05, False, 0.0, 2, "high"), (0.7, 0.05, False, 0.0, 1, "medium"), (0.5, 0.0, False, 0.0, 0, "medium")])
def test_confidence(spark, cov, rrf, title, margin, src, want):
    df = spark.createDataFrame([(cov, rrf, title, margin, src)], "coverage double, rrf_score double, title_hit boolean, margin double, source_count int")
    assert df.select(rt.confidence_class().alias("c")).first()["c"] == want


def test_confidence_gathers_only_tokens_of_the_query(spark, index):
    hits = spark.createDataFrame([("q0", 1, "c1", "note:a", 0.5), ("q0", 2, "c3", "book:b", 0.2)], "query_id string, rank int, chunk_id string, doc_key string, rrf_score double")
    out = rt.confidence(queries(spark, "quantum rabi22 zebra search", "nothing", None), hits, index).orderBy("query_id")
    assert [tuple(r)[:6] for r in out.collect()] == [("q0", 0.8, 0.5, True, 0.3, 2), ("q1", 0.0, 0.0, False, 0.0, 0), ("q2", 0.0, 0.0, False, 0.0, 0)]
    assert "array_intersect" in next(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "AS ts#" in x)


def test_shingles_and_jaccard(spark):
    r = spark.createDataFrame([("aa bb cc dd ee", "aa bb"), ("", None)], "x string, y string").select(rt.shingles(F.col("x")).alias("a"), rt.shingles(F.col("y")).alias("b")).select("a", "b", rt.jaccard(F.col("a"), F.col("a")).alias("j"), rt.jaccard(F.col("a"), F.col("b")).alias("k")).collect()
    assert r[0]["a"] == ["aa bb cc dd", "bb cc dd ee"] and r[0]["b"] == ["aa", "bb"] and r[0]["j"] == 1.0 and r[0]["k"] == 0.0 and r[1]["j"] == 0.0


def broadcasts(df) -> int:
    """Sides of a plan's joins that are marked to be sent to the other."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")


def test_positions_take_the_queries_to_the_texts(spark, index):
    hits = spark.createDataFrame([("q0", "c1"), ("q0", "c3")], "query_id string, chunk_id string")
    out = rt.positions(hits, queries(spark, "search quantum"), index)
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("q0", "c1", "quantum", "summary", 0), ("q0", "c1", "quantum", "title", 0), ("q0", "c1", "search", "summary", 1), ("q0", "c1", "search", "title", 1), ("q0", "c3", "search", "summary", 0)]
    assert broadcasts(out) == 2  # hits and tokens: no text is shuffled


def test_reranking_takes_the_queries_to_the_texts(spark, index):
    hits = spark.createDataFrame([("q0", "c1", 2.0), ("q0", "c4", 1.0)], "query_id string, chunk_id string, score double")
    out = rt.reranked(hits, queries(spark, "search quantum"), index)
    assert {r["chunk_id"]: (r["prox"], r["phrase"], r["cov"]) for r in out.collect()} == {"c1": (0.5, 0.0, 1.0), "c4": (0.0, 0.0, 0.0)}
    assert broadcasts(out) == 2


def test_neighbors_in_a_ranking_are_compared_without_shuffling_shingles(spark, index):
    hits = spark.createDataFrame([("q", 1, "c1"), ("q", 2, "c2"), ("q", 3, "c5"), ("z", 1, "c3"), ("z", 2, "c3")], "query_id string, rank int, chunk_id string")
    out = rt.neighbor_similarity(hits, index)
    assert sorted(tuple(r) for r in out.collect()) == [("q", "c1", "c2", 0.0), ("q", "c2", "c5", 0.0), ("z", "c3", "c3", 1.0)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 1 and "Join" in plan and plan.count("Join") == 1  # one join brings the texts, no second one of the hits with themselves


def test_hits_are_scored_as_nodes_without_postings(spark, index):
    n = nds.nodes(index.chunks)
    rows_of = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows_of(nds.node_df_of(n)) == rows_of(nds.node_df(nds.node_postings(n)))
    lengths = nds.node_lengths(n).first()
    tokens = nds.expanded_queries(queries(spark, "quantum overview guide", "相变 search"))
    hits = index.chunks.select(F.explode(F.array(F.lit("q0"), F.lit("q1"))).alias("query_id"), "chunk_id", F.lit(1).alias("rank"))
    got = nds.chunk_scores(hits, tokens.join(nds.node_df_of(n), "token"), index.chunks, lengths)
    # the same by postings: scores of nodes without terms, one of each chunk, times the frequencies of all nodes
    own = index.chunks.select("doc_key", F.col("chunk_id").alias("node_key"), "title", "breadcrumb", F.array().cast("array<string>").alias("terms"), F.coalesce(F.substring("body", 1, 200), F.lit("")).alias("summary"))
    want = {}
    df = {r["token"]: r["df"] for r in nds.node_df_of(n).collect()}
    asks = {(r["query_id"], r["token"]) for r in tokens.collect()}
    for p in nds.node_postings(own).collect():
        for q in ("q0", "q1"):
            if (q, p["token"]) in asks and p["token"] in df:
                idf = math.log(1 + (lengths["n"] - df[p["token"]] + 0.5) / (df[p["token"]] + 0.5))
                part = idf * p["tf"] * 2.5 / (p["tf"] + 1.5 * (0.25 + 0.75 * p["length"] / (lengths[f"avg_{p['field']}"] or 1.0))) * rt.NODE_BOOST[p["field"]]
                want[q, p["node_key"]] = want.get((q, p["node_key"]), 0.0) + part
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in got.collect()} == {k: math.floor(v * 100 + 0.5) / 100 for k, v in want.items()} != {}


def test_node_terms(spark):
    r = spark.createDataFrame([("Weak-field (limit): a b-test",), (None,)], "t string").select(nds.title_terms(F.col("t")).alias("x")).collect()
    assert r[0]["x"] == ["Weak", "field", "limit", "test"] and r[1]["x"] == []


def test_empty_index(spark):
    i = ix.build(spark.createDataFrame([], CHUNK))
    assert i.n == 0 and rt.multi_path(queries(spark, "anything"), i).count() == 0
