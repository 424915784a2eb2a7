"""Text operators against brute force, round trips and hand-made cases; nulls, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import difflib
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataquery.llm import encoding, markup, packing, ranking, scan, terms

CHUNK = "chunk_id string, title string, breadcrumb array<string>, body string, n int, word string, path string, fixed string"


def chunks(spark, rows):
    return spark.createDataFrame([(c, t, b, x, 1, "w", "p", "f") for c, t, b, x in rows], CHUNK)


FILLER = "The stable spectrum determines the surface of the boundary. A transport near the lattice reproduces the low-lying energy. Modern matter is mentioned often here."


@pytest.fixture(scope="module")
def corpus():
    return [(f"f{i}", "Notes on the field", ["Plain layers", "Weak fields"], FILLER) for i in range(30)]


# 1: scanned text ------------------------------------------------------------------------------------------------------


def noise(spark, corpus, *rows):
    return {(r["chunk_id"], r["kind"]) for r in scan.found_noise(chunks(spark, corpus + list(rows))).collect()}


def test_scan_kinds(spark, corpus):
    rows = [
        ("hy", "T", [], "Here the tra‐\nnsport of the lat-\ntice is stable."),
        ("hy2", "T", ["Weak fields"], "the sta-\n12   Weak fields\nble surface"),
        ("compound", "T", [], "It has the low-\nlying energy of the boundary."),
        ("mis", "T", [], "the 5table spectrurn and\nthe lattice"),
        ("lig", "T", [], "the ﬁeld and the ﬂow of it"),
        ("one", "T", [], "only one 5urface here"),
        ("head", "T", ["Plain layers", "Weak fields"], "the boundary\nPLAIN LAYERS   17\nof the surface"),
        ("head2", "T", ["Plain layers"], "the boundary\n\nChap. 1. Plain layers\n\nof the surface"),
        ("page", "T", [], "the boundary\n— 58 —\nof the surface\n[3, 4].\nend"),
        ("tech", "T", [], "Sample T1 and probe H2O were read by the x86 host 24/7.\nIt has 40 lines."),
        ("wrapped", "T", [], "The stable spectrum determines\nthe surface of the boundary."),
        ("nil", None, None, None),
        ("empty", "", [], ""),
        ("hy", "T", [], "Here the tra‐\nnsport of the lat-\ntice is stable."),
        (None, "T", [], "tra-\nnsport"),
    ]
    assert noise(spark, corpus, *rows) == {("hy", "hyphenation"), ("hy2", "hyphenation"), ("hy2", "running_header"), ("hy2", "page_number"), ("mis", "misread"), ("lig", "misread"), ("head", "running_header"), ("head", "page_number"), ("head2", "running_header"), ("page", "page_number")}


def test_scan_repair(spark, corpus):
    rows = [("x", "T", ["Weak fields"], "The 5table spectrurn deter-\n\n12   Weak fields\n\nmines the low-\nlying energy\nof it."), ("zh", "T", [], "我们用矩阵\n来描述\n[55]\n散射。")]
    got = {r["chunk_id"]: r["body"] for r in scan.repaired(chunks(spark, corpus + rows)).where("chunk_id in ('x', 'zh')").collect()}
    assert got["x"] == "The stable spectrum determines the low-lying energy of it."
    assert got["zh"] == "我们用矩阵来描述散射。"


def test_corrections_are_whole_words():
    """Neither parts of words nor code, links, templates and formulas are changed; the case of what stood there is kept."""
    fixes = {"tbe": "the", "spectrurn": "spectrum", "5table": "stable"}
    assert scan.restore("tbe outbeat, Tbe TBE SPECTRURN! `tbe` [[tbe|x]] {{tbe}} $tbe$ [a](tbe)", set(), fixes) == "the outbeat, The THE SPECTRUM! `tbe` [[tbe|x]] {{tbe}} $tbe$ [a](tbe)"
    assert scan.restore("a 5table\n```\n5table tbe\n```\ntbe", set(), fixes) == "a stable\n```\n5table tbe\n```\nthe"
    assert scan.restore("tra-\nnsport extra-\nnsport", {("tra", "-", "nsport")}, {}) == "transport extra-\nnsport"


def test_words_of_any_length_are_counted(spark, corpus):
    word = "abcdefg" * 20
    rows = [(f"l{i}", "T", [], f"the {word} is {word}") for i in range(10)] + [("bad", "T", [], f"the {word}‐\n{word[:9]} and {word[:70]}‐\n{word[70:]}")]
    assert ("bad", "hyphenation") in noise(spark, corpus, *rows)


def test_scan_round_trip(spark, corpus):
    """Noise is put into clean texts; what comes out has nearly all of their words."""
    rng = random.Random(11)
    vocabulary = sorted({w for w in FILLER.replace(".", "").split() if w.islower() and len(w) > 3})
    rows, clean = [], {}
    for n in range(40):
        words = [rng.choice(vocabulary) for _ in range(60)]
        clean[f"n{n}"] = words
        lines, line = [], []
        for w in words:
            bad = w
            if rng.random() < 0.08 and "m" in w:
                bad = w.replace("m", "rn", 1)
            elif rng.random() < 0.08 and "s" in w[1:]:
                bad = w[0] + w[1:].replace("s", "5", 1)
            if rng.random() < 0.08 and len(bad) == len(w) > 6:
                lines.append(" ".join([*line, w[:3] + "-"]))
                line = [w[3:]]
            else:
                line.append(bad)
            if len(line) > 9:
                lines.append(" ".join(line))
                line = []
                if rng.random() < 0.2:
                    lines += ["", f"WEAK FIELDS   {n + 10}", ""]
        rows.append((f"n{n}", "T", ["Weak fields"], "\n".join([*lines, " ".join(line)])))
    got = {r["chunk_id"]: r["body"].split() for r in scan.repaired(chunks(spark, corpus + rows)).where("chunk_id like 'n%'").collect()}
    total = sum(map(len, clean.values()))
    off = [(k, clean[k][a:b], got[k][c:e]) for k in clean for t, a, b, c, e in difflib.SequenceMatcher(None, clean[k], got[k], autojunk=False).get_opcodes() if t != "equal"]
    assert sum(max(len(x), len(y)) for _, x, y in off) < 0.02 * total, off[:20]


def test_scan_empty(spark):
    assert scan.found_noise(chunks(spark, [])).count() == 0 and scan.repaired(chunks(spark, [])).count() == 0


def test_long_text(spark, corpus):
    long = (FILLER + "\n") * 3000
    assert noise(spark, corpus, ("long", "T", [], long + "the tra‐\nnsport")) == {("long", "hyphenation")}


# 2: markup ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("<p>a</p>", {"html"}), ("x &amp; y", {"html"}), ("<!-- c -->", {"html"}), ("a<BR>b", {"html"}), ("**b**", {"markdown"}), ("# head #", {"markdown"}), ("Head\n====\n", {"markdown"}),
        ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("```\ncode\n```", {"markdown"}), ("> quote", {"markdown"}), ("[a](b.md)", {"markdown"}), ("![a](b.png)", {"markdown"}), ("~~x~~", {"markdown"}), ("__x__", {"markdown"}),
        ("[[a|b]]", {"wiki"}), ("'''b'''", {"wiki"}), ("== h ==", {"wiki"}), ("{{cite|x}}", {"wiki"}), ("{| class=x\n|-\n| a || b\n|}", {"wiki"}),
        ("$\\alpha_1$", {"latex"}), ("\\textbf{x}", {"latex"}), ("\\begin{equation}\nx\n\\end{equation}", {"latex"}), ("74\\% of", {"latex"}), ("see Fig.~\\ref{a}", {"latex"}), ("\\( a \\)", {"latex"}),
        ("Compare 2 < 3, 7 >= 6 and i != j.", set()), ("a < b and c\n> d hold", set()), ("R&D item #7", set()), ("from $40 to $60 in", set()), ("C# and 5 * 3 * 2 slots", set()), ("C:\\data\\runs", set()), ("C:\\data\n\\runs is", set()),
        ("max_step_size and [12], see [3, 4]", set()), ("~30 of {0,1}", set()), ("- 18 -", set()), ("k|eine Übergang", set()), ("", set()), ("x_1 * y", set()),
    ],
)
def test_markup_kinds(text, kinds):
    assert {m for _, m, _, _ in markup.pieces(text) if m} == kinds


def test_markup_clean(spark):
    body = "<!-- c --><h2>Head</h2>\n<ul><li>one<li>two</ul><p>Text &amp; <b>bold</b> [[a|link]]{{cite|x}} and $x^2$.</p>\n```py\ncode()\n```"
    rows = [("a", "**T**", [], body), ("b", None, None, None), ("c", "plain", [], "as it is <"), ("a", "**T**", [], body)]
    got = {r["chunk_id"]: r for r in markup.clean(chunks(spark, rows)).collect()}
    assert got["a"]["title"] == "T" and got["b"]["body"] is None and got["c"]["body"] == "as it is <"
    text = got["a"]["body"]
    assert all(x in text for x in ("## Head", "- one", "- two", "Text & bold link", "$x^2$", "```\ncode()\n```")) and not any(x in text for x in ("<", "cite", "[["))
    assert {(r["chunk_id"], r["field"], r["markup"]) for r in markup.found_markup(chunks(spark, rows)).collect()} >= {("a", "title", "markdown"), ("a", "body", "html"), ("a", "body", "wiki"), ("a", "body", "latex")}
    assert markup.found_markup(chunks(spark, [])).count() == 0 and markup.clean(chunks(spark, [])).count() == 0


FORMS = {
    "html": "<h2>{0}</h2>\n<p>{1} <b>{2}</b> &amp; so on.</p>\n<ul><li>{3}</li><li>{4}</li></ul>\n<pre>{5}</pre>",
    "markdown": "## {0}\n\n{1} **{2}** & so on.\n\n- {3}\n- {4}\n\n```\n{5}\n```",
    "wiki": "== {0} ==\n{1} '''{2}''' & so on.\n\n* {3}\n* {4}\n\n<pre>{5}</pre>",
    "latex": "\\section{{{0}}}\n{1} \\textbf{{{2}}} \\& so on.\n\\begin{{itemize}}\n\\item {3}\n\\item {4}\n\\end{{itemize}}",
}


def test_four_markups_give_one_text(spark):
    """The same content in each markup: words and structure come out alike."""
    parts = ["Stable fields", "The first paragraph, which is long enough, holds", "strong words", "first entry", "second entry", "x = 1\ny = 2"]
    rows = [(k, "T", [], f.format(*parts)) for k, f in FORMS.items()]
    got = {r["chunk_id"]: r["body"] for r in markup.clean(chunks(spark, rows)).collect()}
    for k, text in got.items():
        lines = [x for x in (" ".join(y.split()) for y in text.split("\n")) if x]
        want = ["# Stable fields", "The first paragraph, which is long enough, holds strong words & so on.", "- first entry", "- second entry", *([] if k == "latex" else ["```", "x = 1", "y = 2", "```"])]
        assert [x.lstrip("#").strip() if x.startswith("##") else x.removeprefix("# ") if x.startswith("#") else x for x in lines] == [x.removeprefix("# ") for x in want], (k, text)


PAGE = "<div><a href=a>Home</a> <a href=b>About us</a> <a href=c>Contact</a></div><div><p>The first paragraph has commas, several of them, and a <a href=x>linked word</a> in it; it is long enough, surely, to be read as text.</p><p>Another paragraph follows here, with more commas, and ends well.</p></div><div><small>Company {n}</small> <a href=d>Imprint</a> <a href=e>Privacy</a> <a href=f>Terms</a></div>"


def test_ratios_decide(spark):
    """Navigation and footers use the same elements as content; their paths are told by text and punctuation alone."""
    rows = [(f"p{i}", "A title", [], PAGE.replace("{n}", str(i))) for i in range(30)] + [("only", "[[a|linked title]]", [], "plain")]
    df = chunks(spark, rows)
    ratios = markup.path_ratios(markup.measured(df))
    verdict = {r["path"]: r["content"] for r in markup.content_paths(ratios).collect()}
    assert verdict["html:div/html:p"] and not verdict["html:div/html:a"] and not verdict["html:div/html:small"]
    got = {r["chunk_id"]: r for r in markup.clean(df).collect()}
    assert got["only"]["title"] == "linked title"
    for i in range(30):
        text = got[f"p{i}"]["body"]
        assert "linked word in it" in text and "Another paragraph" in text and not any(x in text for x in ("Home", "Contact", "Imprint", "Terms", "Company"))


def test_found_markup_takes_all_paths(spark, monkeypatch):
    """Constructs on paths that are no content are found too, so no stage that judges paths is run; repeats of a chunk count once."""
    rows = [(f"p{i}", "A title", [], PAGE.replace("{n}", str(i))) for i in range(30)]
    rows += [("nav", "**T**", [], "<div><a href=a>Home</a></div>"), ("only", "{{cite|x}}", [], "see ~\\ref{a}"), ("none", "T", [], "a < b_c"), ("null", None, None, None), *rows[:3]]
    ratios = markup.path_ratios(markup.measured(chunks(spark, rows)))
    verdict = {r["path"]: r["content"] for r in markup.content_paths(ratios).collect()}
    assert not verdict["html:div/html:a"] and not verdict["wiki:template"] and not verdict["latex:reference"]
    for stage in ("path_ratios", "content_paths", "threshold"):
        monkeypatch.setattr(markup, stage, lambda *_: pytest.fail("a stage without effect is run"))
    got = [tuple(r) for r in markup.found_markup(chunks(spark, rows)).collect()]
    want = {(c, f, m) for c, title, _, body in rows for f, t in (("title", title), ("body", body)) for _, m, _, _ in markup.pieces(t or "") if m}
    assert sorted(got) == sorted(want) and {("nav", "body", "html"), ("nav", "title", "markdown"), ("only", "title", "wiki"), ("only", "body", "latex")} <= want


def test_residue_at_any_depth(spark):
    deep = "<table><tbody><tr><td>Cell one <!-- secret --></td><td>" + "<div>" * 30 + "<pre>code()\nmore()</pre>" + "</div>" * 30 + "</td></tr></tbody></table>" + ">" * 5000 + " quoted"
    got = markup.clean(chunks(spark, [("d", "T", [], deep), ("n", "T", [], ("> " * 3000) + "inner")])).orderBy("chunk_id").collect()
    assert "secret" not in got[0]["body"] and "Cell one" in got[0]["body"] and "```\ncode()\nmore()\n```" in got[0]["body"] and "inner" in got[1]["body"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>/p&;*_`[]()|{}\\$='#~\n 1.", max_size=60))
def test_markup_never_breaks(text):
    assert all(len(p) == 4 for p in markup.pieces(text))


# 3, 7: terms ---------------------------------------------------------------------------------------------------------------


def test_net_and_marks(spark):
    d = spark.createDataFrame([("b", "x", 5, 1, 5, "1"), ("b", "x", 5, 1, 5, "2"), ("d", "x", -4, 0, -4, "1"), ("b", "y", 9, 0, 9, "1"), ("b", None, 9, 0, 9, "1"), ("b", "z", None, 1, 0, "1")], "layer_id string, token string, df_any bigint, df_nonbody bigint, df_body bigint, arrived_at string")
    net = {r["token"]: r["df_any"] for r in terms.net_frequencies(d).collect()}
    assert net == {"x": 1, "y": 9, "z": 0}
    rec = spark.createDataFrame([(1, 5, 0.5, 2), (2, None, None, None)], "recipe_id int, body_df_min bigint, body_df_ratio double, df_any_min bigint")
    n = spark.createDataFrame([(10,)], "n bigint")
    assert {tuple(r) for r in terms.marks(terms.net_frequencies(d), rec, n).collect()} == {(1, "x", "rare"), (1, "y", "common")}
    assert terms.marks(terms.net_frequencies(d.limit(0)), rec, n).count() == 0


def test_text_frequencies(spark):
    d = spark.createDataFrame([(1, "aa bb aa"), (1, "aa bb aa"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {tuple(r) for r in terms.term_frequencies(d, "doc_id", "text").collect()} == {("aa", 2, 1), ("bb", 1, 1)}


def test_distinctiveness(spark):
    rows = [(f"c{i}", "the", [], "the model of the field") for i in range(20)] + [("k", None, None, "zoru zoru zoru the model"), ("k2", "x", [], "zoru"), ("nil", None, None, None)]
    hits = spark.createDataFrame([(1, "k", ["the", "model", "zoru", "absent", None]), (1, "k", ["the", "model", "zoru", "absent", None]), (2, "missing", ["the"]), (3, "k2", None), (4, None, ["the"])], "hit_id bigint, chunk_id string, tokens array<string>")
    totals = spark.createDataFrame([("b", 22, 20, 0, 110)], "layer_id string, total_chunks bigint, title_length_sum bigint, breadcrumb_length_sum bigint, body_length_sum bigint")
    s = terms.distinctiveness(hits, chunks(spark, rows), totals)
    by = {r["token"]: r for r in s.where("hit_id = 1").collect()}
    mu, pc, pd = 6 * 130 / 22, 4 / 130, (3 + 6 * 130 / 22 * 4 / 130) / (5 + mu if (mu := 6 * 130 / 22) else 0)
    assert math.isclose(by["zoru"]["score"], pd * math.log(pd / pc), rel_tol=1e-9)
    assert by["absent"]["score"] is None and by["zoru"]["tf"] == 3 and by["zoru"]["df"] == 2
    assert [tuple(r) for r in terms.most_characteristic(s).collect()] == [(1, "zoru")]


# 4: one ranking --------------------------------------------------------------------------------------------------------------


def brute_fused(rows):
    med = lambda v: sorted(v)[math.ceil(len(v) / 2) - 1]
    out = {}
    params = []
    for i in range(3):
        v = [r[i] for r in rows if r[i] is not None and math.isfinite(r[i])]
        m = med(v)
        d = med([abs(x - m) for x in v]) * 1.4826 or statistics.fmean(abs(x - m) for x in v) * 1.2533
        params.append((m, d))
    for n, r in enumerate(rows):
        t = 0.0
        for x, (m, d) in zip(r, params):
            t += math.log(ranking.MISSING) if x is None or math.isnan(x) else -math.log1p(math.exp(-max(-12, min(12, (x - m) / d if d else 0))))
        out[n] = math.exp(t / 3)
    return out


def test_fusion(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1) / 100, rng.gauss(50, 900)) for _ in range(60)] + [(1e9, -5.0, -5e4), (1.6, 0.016, 1500.0), (None, 0.09, 9e9), (float("nan"), 0.0, 0.0), (float("inf"), 0.0, None)]
    df = spark.createDataFrame([("q", i, f"c{i}", *r, "u") for i, r in enumerate(rows)] + [("one", 0, "z", None, None, None, "u"), (None, 0, "z", 1.0, 1.0, 1.0, "u")], "query_id string, hit_id bigint, chunk_id string, score double, rrf_score double, rerank_score double, n string")
    fused = ranking.fused_scores(df.union(df.where("hit_id < 9")))
    got = {r["hit_id"]: r["fused"] for r in fused.where("query_id = 'q'").collect()}
    want = brute_fused(rows)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
    best = {r["query_id"]: r["chunk_id"] for r in ranking.first_places(fused).collect()}
    assert best["q"] == f"c{max(want, key=want.get)}" and best["one"] == "z"
    assert got[61] > got[60] and got[61] > got[62]
    assert ranking.fused_scores(df.limit(0)).count() == 0


# 8: containers ----------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 90))
def test_bins_hold_every_item_once(sizes, capacity):
    bins = packing.best_two_fit(np.array(sizes, dtype=np.int64), capacity)
    assert len(bins) == len(sizes) and (not sizes or bins.min() >= 0)
    used = np.bincount(bins, weights=sizes) if sizes else np.array([])
    assert (used <= capacity).all() and (used > 0).all()
    assert len(used) <= max(1, 2 * sum(sizes) / capacity + 1)


def test_pair_fits_best():
    for seed in range(50):
        rng = random.Random(seed)
        have = [rng.randrange(1, 30) for _ in range(8)]
        left, room, more = np.bincount(have, minlength=64), rng.randrange(5, 50), rng.randrange(0, 20)
        sums = [a + b for a, b in itertools.combinations(have, 2) if more < a + b <= room]
        pair = packing._best_pair(left, room, more)
        assert (sum(pair) if pair else None) == (max(sums) if sums else None)


DOC = "doc_id bigint, text string, source string, n_tokens int, size int"


def test_pack(spark):
    docs = [(i, "word " * (i % 37 + 1), "s", 0, 0) for i in range(200)] + [(900, "word " * 1000, "s", 0, 0), (901, None, "s", 0, 0), (902, "", "s", 0, 0), (903, "word", None, 0, 0)]
    boxes = spark.createDataFrame([("c", 64), ("bad", 0)], "container string, capacity_tokens int")
    rows = packing.pack(spark.createDataFrame(docs, DOC), boxes, group_items=60).collect()
    per, ids = {}, {}
    for r in rows:
        per[r["bin"]] = per.get(r["bin"], 0) + r["n_tokens"]
        ids.setdefault(r["doc_id"], []).append(r["n_tokens"])
    assert max(per.values()) <= 64 and set(ids) == {*range(200), 900, 903} and all(len(v) == 1 for k, v in ids.items() if k != 900)
    measured = {r["doc_id"]: r["n_tokens"] for r in packing.with_token_counts(spark.createDataFrame(docs, DOC).drop("n_tokens")).collect()}
    assert all(sum(v) == measured[k] for k, v in ids.items())
    assert packing.pack(spark.createDataFrame([], DOC), boxes).count() == 0


def test_pack_groups_count_what_is_packed(spark):
    """Long texts fill whole bins that take no part in packing; all bins are told apart and nearly full."""
    docs = [(i, "word " * 3000, "s", 0, 0) for i in range(3)] + [(100 + i, "word " * (1 + i % 9), "s", 0, 0) for i in range(3000)]
    boxes = spark.createDataFrame([("one", 1), ("c", 40)], "container string, capacity_tokens int")
    rows = packing.pack(spark.createDataFrame(docs, DOC), boxes, group_items=1000)
    measured = packing.with_token_counts(spark.createDataFrame(docs, DOC).drop("n_tokens")).agg(F.sum("n_tokens")).first()[0]
    bins = rows.groupBy("container", "capacity_tokens", "bin").agg(F.sum("n_tokens").alias("used"))
    assert bins.where("used > capacity_tokens").count() == 0
    got = {r["container"]: (r["t"], r["n"]) for r in bins.groupBy("container").agg(F.sum("used").alias("t"), F.count("*").alias("n")).collect()}
    assert got["one"] == (measured, measured) and got["c"][0] == measured and measured / (40 * got["c"][1]) > 0.98


# 9: mixing --------------------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 100)), min_size=1, max_size=40), st.integers(0, 99))
def test_pivotal_keeps_the_sum(items, seed):
    p, w = np.array([a for a, _ in items]), np.array([float(b) for _, b in items])
    out = packing.pivotal(p, w, np.random.default_rng(seed).random(len(p)))
    assert ((out >= 0) & (out <= 1)).all() and sum(0 < x < 1 for x in out) <= 1
    assert math.isclose((out * w).sum(), (p * w).sum(), abs_tol=1e-5)


def test_pivotal_expectations():
    rng = np.random.default_rng(1)
    p, w = np.array([0.3, 0.6, 0.5, 0.9]), np.array([1.0, 2.0, 5.0, 3.0])
    runs = np.array([packing.pivotal(p, w, rng.random(4)) for _ in range(4000)])
    assert np.allclose(runs.mean(axis=0), p, atol=0.03)


def test_mix(spark):
    rng = random.Random(9)
    docs = [(i, f"text {i} " + "word " * rng.randrange(5, 60), rng.choice([" A", "a ", "B", "b", "C", None, "other"]), 0, 0) for i in range(1500)]
    docs += [(2000 + i, docs[i][1], "A", 0, 0) for i in range(50)] + [(3000, None, "A", 0, 0), (3001, "", "B", 0, 0)]
    goal = spark.createDataFrame([("a", 0.5, 2), ("B ", 0.3, 3), ("c", 0.1, 4), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    for fan in (2, 64):
        copies, shares = packing.mix(spark.createDataFrame(docs, DOC), goal, group_items=100, fan_in=fan)
        s = {r["source"]: r for r in shares.collect()}
        assert s["none"]["tokens"] == 0
        reach = sum(s[k]["tokens"] for k in "abc")
        for k, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
            assert abs(s[k]["tokens"] / reach - share / 0.9) < 0.005 and s[k]["max_copies"] <= {"a": 2, "b": 3, "c": 4}[k]
        rows = copies.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) and not {r["doc_id"] for r in rows} & {3000, 3001, 2000}
    # a text longer than a target, and one that outweighs all others of its source
    docs += [(4000, "long " * 60_000, "C", 0, 0), (4001, "big " * 2_000, "B", 0, 0)]
    copies, shares = packing.mix(spark.createDataFrame(docs, DOC), goal)
    s = {r["source"]: r for r in shares.collect()}
    reach = sum(s[k]["tokens"] for k in "abc")
    assert all(abs(s[k]["tokens"] / reach - share / 0.9) < 0.01 for k, share in (("a", 0.5), ("b", 0.3), ("c", 0.1))) and 4000 not in {r["doc_id"] for r in copies.where("copies > 0").collect()}
    c, s = packing.mix(spark.createDataFrame([], DOC), goal)
    assert c.count() == 0 and s.count() == 4


# 10: encodings -----------------------------------------------------------------------------------------------------------------

SOUND = {
    "de": "Für die Größe wurde eine natürliche Strömung gewählt. Später prüfen wir die übliche Fähigkeit über der Fläche.",
    "fr": "Après la méthode, l’équation reste très périodique à l’échelle du modèle. Dès que la théorie décroît, il est égal.",
    "ru": "Если величина мала, то слабая решётка остаётся постоянной. Здесь простая форма определяет, какой будет фаза.",
    "zh": "如果能谱是稳定,那么局部的边界不会影响信号。我们用矩阵来描述有限的散射,并给出临界的估计。",
    "en": "The so‑called field is 5 µm wide at ±0.2 °C — as before — and it’s “steady” in the naïve café-style sample.",
}
WRONG = [("de", "utf-8", "cp1252"), ("de", "utf-8", "latin-1"), ("de", "utf-8", "cp1250"), ("fr", "utf-8", "cp1251"), ("fr", "utf-8", "mac_roman"), ("de", "cp1252", "cp437"), ("de", "cp1252", "mac_roman"), ("ru", "cp1251", "cp1252"), ("zh", "utf-8", "latin-1"), ("zh", "gb18030", "latin-1"), ("en", "utf-8", "latin-1"), ("zh", "utf-8", "gb18030")]


def test_encodings_round_trip(spark):
    docs = [(i * 10 + j, t, "x") for i in range(40) for j, t in enumerate(SOUND.values())]
    bad = {}
    for n, (lang, true, wrong) in enumerate(WRONG):
        try:
            garbled = SOUND[lang].encode(true).decode(wrong)
        except UnicodeDecodeError:
            continue
        bad[5000 + n] = (garbled, SOUND[lang], f"{true}<{wrong}")
    twice = SOUND["fr"].encode().decode("latin-1").encode().decode("latin-1")
    bad[6000] = (twice, SOUND["fr"], "twice")
    part = SOUND["en"] + "\n\n" + SOUND["de"].encode().decode("latin-1")
    bad[6001] = (part, SOUND["en"] + "\n\n" + SOUND["de"], "part")
    gone = {7000: SOUND["de"].encode("cp1252").decode("utf-8", errors="replace"), 7001: SOUND["zh"].encode("gb18030").decode("utf-8", errors="replace")}
    extra = [(1, None, "x"), (8000, "", "x"), (8001, None, "x"), (None, "Ã©", "x"), (8002, "plain ascii", "x")]
    df = spark.createDataFrame(docs + [(k, v[0], "x") for k, v in bad.items()] + [(k, v, "x") for k, v in gone.items()] + extra, "doc_id bigint, text string, span string")
    got = {r["doc_id"]: r for r in encoding.restored(df).collect()}
    assert set(got) == {*bad, *gone}
    wrong = {k: (bad[k][2], got[k]["text"]) for k in bad if got[k]["text"] != bad[k][1]}
    assert not wrong, wrong
    assert got[7000]["text"] == SOUND["de"] and got[7000]["lost"] and got[7001]["lost"]
    assert encoding.damaged(df.limit(0)).count() == 0


def test_lattice_fills_lost_bytes():
    lattice = encoding.Lattice({"变": -1.0, "受": -9.0, "相": -2.0})
    data = list("相变".encode())
    data[4] = -1
    assert lattice.decode(data, "utf-8")[0] == "相变"


def test_letters_rarer_than_those_shown_are_restored(spark):
    """ó is ten times as frequent as î here; the words decide."""
    docs = [(i, "il paraît que " + "una canción " * 10) for i in range(40)]
    got = encoding.restored(spark.createDataFrame([*docs, (99, "il paraÓt que")], "doc_id bigint, text string")).collect()
    assert [(r["doc_id"], r["text"], r["channels"]) for r in got] == [(99, "il paraît que", ["cp1252<mac_roman"])]


def test_every_reading_is_offered():
    """The rarest of more than five readings is kept."""
    weights = {c: -2.0 for c in map(chr, [*range(0xA1, 0x100), *range(0x410, 0x450)])} | {"ï": -12.0}
    got = encoding.readings("naÔve", encoding.Lattice(weights))
    assert len({t for _, t, _ in got}) > 5 and ("cp1252<mac_roman", "naïve", 0.0) in got


def test_intact_letters_of_lost_spans_are_restored(spark):
    """UTF-8 read as cp1252, which has no character for some bytes."""
    docs = [(i * 10 + j, t) for i in range(20) for j, t in enumerate(SOUND.values())]
    garbled = SOUND["ru"].encode().decode("cp1252", errors="replace")
    got = {r["doc_id"]: r for r in encoding.restored(spark.createDataFrame([*docs, (900, garbled)], "doc_id bigint, text string")).collect()}
    text = got[900]["text"]
    assert encoding.LOST in garbled and got[900]["lost"] and "utf-8<cp1252" in got[900]["channels"]
    assert len(text) == len(SOUND["ru"]) and all(a in (b, encoding.LOST) for a, b in zip(text, SOUND["ru"])) and text.count(encoding.LOST) <= garbled.count(encoding.LOST)
    lattice = encoding.Lattice({c: -3.0 for c in "абвгдежзиклмнопрстуфхäöüß"})
    assert not [c for x in ("��", "Gr��e", "мала�") for c, _, _ in encoding.readings(x, lattice) if c.rpartition("<")[2] not in encoding.WIDE]


def test_no_container_or_target_is_left_out(spark):
    docs = [(i, f"text {i} words", f"s{i * 500}", 0, 0) for i in range(40)]
    boxes = spark.range(1100).select(F.concat(F.lit("c"), "id").alias("container"), F.lit(64).alias("capacity_tokens"))
    assert packing.pack(spark.createDataFrame(docs[:3], DOC), boxes).select("container").distinct().count() == 1100
    goal = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(1 / 20_000).alias("target_share"), F.lit(2).alias("max_repeats"))
    _, shares = packing.mix(spark.createDataFrame(docs, DOC), goal)
    assert {r["source"] for r in shares.where("available_tokens > 0").collect()} == {s for _, _, s, _, _ in docs} and shares.count() == 20_000


def test_edge_lines_with_wide_blanks_signs_and_rules(spark, corpus):
    rows = [
        ("blanks", "T", ["Plain layers"], "the boundary\nPLAIN  LAYERS   17\nof the surface"),
        ("signs", "T", ["Plain layers"], "the boundary\nPlain *layers*\nof the surface"),
        ("rule", "T", [], "the boundary\n" + "—" * 20 + " 58 " + "—" * 20 + "\nof the surface"),
    ]
    assert noise(spark, corpus, *rows) == {("blanks", "running_header"), ("blanks", "page_number"), ("signs", "running_header"), ("rule", "page_number")}
