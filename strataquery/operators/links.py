"""The link graph: parsing links from text, resolving them against a catalog, and graph queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import lookup_key
from ..session import cut
from .skew import hot_keys, skew_join

# Forms of links, fences, code and external targets.
WIKILINK = r"(?<!!)\[\[([^\[\]\n]+)\]\]"
MARKDOWN_LINK = r"(?<!!)\[([^\]\n]+)\]\(([^)\s]+)(?:\s+[\"'][^\"']*[\"'])?\)"
FENCE = r"^\s*(?:`{3,}|~{3,})"
CODE = r"(`+).*?\1"
EXTERNAL = r"(?i)^(?:https?://|mailto:|tel:|data:|javascript:)"
EXCERPT = 240


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _or_null(c: Column) -> Column:
    return F.nullif(_strip(c), F.lit(""))


def _fenced(fences: Column) -> Column:
    """array<struct<a, b>>: line ranges of fenced blocks, each closed by the sign that opened it; `fences` are (i, sign) of fence lines."""
    ranges = "array<struct<a:int,b:int>>"
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("a"), F.array().cast(ranges).alias("done"))
    closed = lambda s, b: F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), b.alias("b"))))
    step = lambda s, f: F.when(s["open"] == "", F.struct(f["sign"].alias("open"), f["i"].alias("a"), s["done"].alias("done"))).when(s["open"] == f["sign"], F.struct(F.lit("").alias("open"), F.lit(0).alias("a"), closed(s, f["i"]).alias("done"))).otherwise(s)
    return F.aggregate(fences, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(closed(s, F.lit(2**31 - 1))))


def lines_with_links(texts: DataFrame) -> DataFrame:
    """(source_id, source_md, line, text, source_heading, excerpt) of lines outside fences that may hold a link.

    One row expression a text: nothing is shuffled, and of a text only these lines go on. The heading is the last line above (or at)
    it that starts with `#`; the excerpt is the line and its two neighbors.
    """
    rows = texts.where(F.contains("text", F.lit("["))).select("source_id", "source_md", F.split("text", "\n").alias("lines"))
    told = rows.withColumn("all", F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))))
    heads = F.transform(F.filter("all", lambda n: n["x"].rlike(r"^\s*#")), lambda n: F.struct(n["i"].alias("i"), _or_null(F.regexp_replace(n["x"], "^[# ]+", "")).alias("title")))
    fences = F.transform(F.filter("all", lambda n: n["x"].rlike(FENCE)), lambda n: F.struct(n["i"].alias("i"), F.substring(F.regexp_replace(n["x"], r"^\s+", ""), 1, 1).alias("sign")))
    marked = told.withColumn("heads", heads).withColumn("fenced", _fenced(fences))
    around = lambda i: F.substring(F.array_join(F.filter(F.transform(F.slice("lines", F.greatest(i, F.lit(1)), F.lit(3)), _strip), lambda p: p != ""), " "), 1, EXCERPT)
    near = F.filter("all", lambda n: F.contains(n["x"], F.lit("[")) & ~F.exists("fenced", lambda r: n["i"].between(r["a"], r["b"])))
    shown = F.transform(near, lambda n: F.struct((n["i"] + 1).alias("line"), n["x"].alias("text"), F.try_element_at(F.filter("heads", lambda h: h["i"] <= n["i"]), F.lit(-1))["title"].alias("source_heading"), around(n["i"]).alias("excerpt")))
    return marked.select("source_id", "source_md", F.explode(shown).alias("n")).select("source_id", "source_md", "n.*")


def _found(masked: Column, line: Column, pattern: str) -> Column:
    """array<struct<column, seen, raw>>: matches of a pattern with their 1-based place, which the gaps between them tell."""
    hits, gaps = F.regexp_extract_all(masked, F.lit(pattern), F.lit(0)), F.split(masked, pattern)
    before = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(1), lambda n, g: n + F.length(g)) + F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda n, h: n + F.length(h))
    return F.transform(hits, lambda h, i: F.struct(before(i).alias("column"), h.alias("seen"), F.substring(line, before(i), F.length(h)).alias("raw")))


def parse_links(texts: DataFrame) -> DataFrame:
    """(source_id, source_md, raw, target, alias, anchor, line, column, syntax, source_heading, excerpt) of the internal links of texts (source_id, source_md, text).

    Fenced blocks and inline code hold no links; images and external targets are none; nulls have none.
    """
    code = F.regexp_extract_all("text", F.lit(CODE), F.lit(0))
    masked = F.when(F.contains("text", F.lit("`")), F.aggregate(code, F.col("text"), lambda t, c: F.replace(t, c, F.repeat(F.lit(" "), F.length(c))))).otherwise(F.col("text"))
    rows = lines_with_links(texts).withColumn("masked", masked)
    kind = lambda pattern, name: F.transform(_found(F.col("masked"), F.col("text"), pattern), lambda x: F.struct(F.lit(name).alias("syntax"), x["column"].alias("column"), x["seen"].alias("seen"), x["raw"].alias("raw")))
    each = rows.select("source_id", "source_md", "line", "source_heading", "excerpt", F.explode(F.concat(kind(WIKILINK, "wikilink"), kind(MARKDOWN_LINK, "markdown"))).alias("x")).select("*", "x.*")
    wiki = F.col("syntax") == "wikilink"
    inner = F.regexp_extract("seen", WIKILINK, 1)
    left = F.split_part(inner, F.lit("|"), F.lit(1))
    href = F.regexp_extract("seen", MARKDOWN_LINK, 2)
    whole = F.when(wiki, left).otherwise(href)
    after = lambda c, sign: F.when(F.instr(c, sign) > 0, F.substring(c, F.instr(c, sign) + 1, F.length(c)))
    target = F.split_part(whole, F.lit("#"), F.lit(1))
    out = each.select(
        "source_id", "source_md", "raw",
        F.when(wiki, _strip(target)).otherwise(target).alias("target"),
        F.when(wiki, _or_null(after(inner, "|"))).otherwise(_strip(F.regexp_extract("seen", MARKDOWN_LINK, 1))).alias("alias"),
        F.when(wiki, _or_null(after(left, "#"))).otherwise(F.nullif(after(href, "#"), F.lit(""))).alias("anchor"),
        F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"), "syntax", "source_heading", "excerpt",
    ).where(F.col("target") != "")
    return out.where((F.col("syntax") == "wikilink") | ~F.col("target").rlike(EXTERNAL))


def path_target(target: Column) -> Column:
    """`books/x/...md` and the like as `book:x`; leading dots, `content/`, `.md` and query strings dropped; other targets stay."""
    t = F.trim(F.split_part(F.replace(target, F.lit("\\"), F.lit("/")), F.lit("?"), F.lit(1)))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^content/", ""), "^/+", ""), r"\.md$", "")
    parts = F.filter(F.split(t, "/"), lambda p: (p != "") & (p != ".") & (p != ".."))
    kind, slug = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((F.size(parts) >= 2) & kind.isin("books", "papers", "notes") & (slug != "_index"), F.concat(F.regexp_replace(kind, "s$", ""), F.lit(":"), slug)).otherwise(t)


def names(catalog: DataFrame) -> DataFrame:
    """(key, doc_type, doc_id): every title and alias under its lookup key, once."""
    each = catalog.select("doc_id", "doc_type", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name is not null")
    return each.select(lookup_key(F.col("name")).alias("key"), "doc_type", "doc_id").distinct()


def resolve(links: DataFrame, catalog: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """Every link with target_id, status (resolved, ambiguous, broken), candidates (their number), relation and target_node_id.

    An id wins; else the only document of the source's type with that name; else the only one of any type. A name is summarized
    by counts and least ids before the join, so a name borne by very many documents is one row. catalog: doc_id,
    doc_type, title, aliases; headings: doc_id, key, node_id.
    """
    named = names(catalog)
    by_type = named.groupBy("key", "doc_type").agg(F.count("*").alias("tn"), F.min("doc_id").alias("tid"))
    by_name = by_type.groupBy("key").agg(F.sum("tn").alias("an"), F.min("tid").alias("aid"), F.map_from_entries(F.collect_list(F.struct("doc_type", F.struct("tn", "tid")))).alias("per"))  # few types
    ids = catalog.select(F.col("doc_id").alias("path"), F.lit(True).alias("is_id")).distinct()
    types = catalog.select(F.col("doc_id").alias("source_id"), F.col("doc_type").alias("source_type")).distinct()
    rows = cut(links.withColumn("path", path_target(F.col("target"))).withColumn("key", lookup_key(F.col("path"))))  # texts are parsed once; hot keys come from here
    hot = {c: hot_keys(rows, c) for c in ("source_id", "path", "key")}
    rows = skew_join(rows, types, "source_id", "raw", "left", hot=hot["source_id"])
    met = skew_join(skew_join(rows, ids, "path", "source_id", "left", hot=hot["path"]), by_name, "key", "source_id", "left", hot=hot["key"])
    own = F.col("per")[F.col("source_type")]
    target = F.when(F.col("is_id"), F.col("path")).when(own["tn"] == 1, own["tid"]).when(F.col("an") == 1, F.col("aid"))
    out = met.withColumn("target_id", target).withColumn("candidates", F.when(F.col("target_id").isNotNull(), F.lit(1).cast("bigint")).otherwise(F.coalesce("an", F.lit(0).cast("bigint")))).withColumn("status", F.when(F.col("target_id").isNotNull(), "resolved").when(F.col("candidates") > 0, "ambiguous").otherwise("broken")).withColumn("relation", F.lit("explicit")).drop("is_id", "an", "aid", "per", "source_type", "key", "path")
    if headings is None:
        return out.withColumn("target_node_id", F.lit(None).cast("string"))
    # only links with an anchor and a target meet headings; all others have no node
    out = cut(out.withColumn("__a", F.when(F.col("target_id").isNotNull(), lookup_key(F.col("anchor")))).withColumn("__at", F.when(F.col("__a").isNotNull(), F.concat_ws("\n", "target_id", "__a"))))
    h = headings.select(F.concat_ws("\n", "doc_id", "key").alias("__at"), F.col("node_id").alias("target_node_id"))
    return skew_join(out, h, "__at", "raw", "left").drop("__a", "__at")


def heading_map(chunks: DataFrame) -> DataFrame:
    """(doc_id, key, node_id): the first node of each normalized title of a document."""
    rows = chunks.where(F.coalesce(F.trim("title"), F.lit("")) != "").select(F.col("doc_key").alias("doc_id"), lookup_key(F.col("title")).alias("key"), "node_id", "local_id", "chunk_id")
    return rows.groupBy("doc_id", "key").agg(F.min_by("node_id", F.struct("local_id", "chunk_id")).alias("node_id"))


def provenance(catalog: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, status): sources named by a document that are ids of the catalog. catalog: doc_id, sources."""
    each = catalog.select(F.col("doc_id").alias("source_id"), F.explode("sources").alias("target_id"))
    return skew_join(each, catalog.select(F.col("doc_id").alias("target_id")).distinct(), "target_id", "source_id", "left_semi").select("source_id", "target_id", F.lit("provenance").alias("relation"), F.lit("resolved").alias("status"))


def preview(text: Column, limit: int = 320) -> Column:
    """First paragraph with text that is no shortcode or section tag, its lines joined without heading and quote signs."""
    paragraphs = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(F.array_join(F.transform(F.split(p, "\n"), lambda x: F.regexp_replace(x, r"^[ #>\t]+|[ #>\t]+$", "")), " ")))
    good = F.filter(paragraphs, lambda p: (p != "") & ~p.rlike(r"^(?:\{\{<|<section|</)"))
    return F.substring(F.coalesce(F.get(good, F.lit(0)), F.lit("")), 1, limit)


def backlinks(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc_id, source_id, occurrences, archived) of explicit resolved edges, counted before the shuffle. catalog: doc_id, status."""
    grouped = edges.where("status = 'resolved' and relation = 'explicit'").groupBy(F.col("target_id").alias("doc_id"), "source_id").agg(F.count("*").alias("occurrences"))
    return skew_join(grouped, catalog.select(F.col("doc_id").alias("source_id"), F.coalesce(F.col("status") == "archived", F.lit(False)).alias("archived")), "source_id", "doc_id")


def neighborhood(edges: DataFrame, catalog: DataFrame, limit: int = 40, with_provenance: bool = False) -> DataFrame:
    """(doc_id, neighbor, priority, n): neighbors of every document, mutual (0) before outgoing (1) before incoming (2), then by id; archived ones hidden.

    The limit is a row_number filter, applied before the shuffle too, so a hub with any number of neighbors sends few rows.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    e = edges.where(F.col("status") == "resolved").where((F.col("relation") == "explicit") | F.lit(with_provenance)).select("source_id", "target_id").distinct()
    both = e.select(F.col("source_id").alias("doc_id"), F.col("target_id").alias("neighbor"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("target_id").alias("doc_id"), F.col("source_id").alias("neighbor"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    flags = both.groupBy("doc_id", "neighbor").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    priority = F.when((F.col("o") == 1) & (F.col("i") == 1), 0).when(F.col("o") == 1, 1).otherwise(2)
    shown = skew_join(flags.withColumn("priority", priority), catalog.select(F.col("doc_id").alias("neighbor"), F.coalesce("status", F.lit("draft")).alias("s")), "neighbor", "doc_id").where("s <> 'archived'")
    return shown.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("priority", "neighbor"))).where(F.col("n") <= limit).select("doc_id", "neighbor", "priority", "n")


def shown_edges(edges: DataFrame, near: DataFrame, with_provenance: bool = False) -> DataFrame:
    """(doc_id, source_id, target_id, relation, line, raw): edges between a document and its shown neighbors, the last of equal ones."""
    e = edges.where(F.col("status") == "resolved").where((F.col("relation") == "explicit") | F.lit(with_provenance))
    last = e.groupBy("source_id", "target_id", "relation").agg(F.max_by(F.struct("line", "raw"), F.struct("source_md", "line", "raw")).alias("x"))
    pairs = near.select("doc_id", "neighbor")
    out = last.join(pairs, (F.col("source_id") == F.col("doc_id")) & (F.col("target_id") == F.col("neighbor"))).unionByName(last.join(pairs, (F.col("target_id") == F.col("doc_id")) & (F.col("source_id") == F.col("neighbor"))))
    return out.select("doc_id", "source_id", "target_id", "relation", "x.line", "x.raw").distinct()


def diagnostics(edges: DataFrame) -> DataFrame:
    """(status, syntax, n) of all explicit links."""
    return edges.where("relation = 'explicit'").groupBy("status", "syntax").agg(F.count("*").alias("n"))


def wikilinks(texts: DataFrame) -> DataFrame:
    """(source_id, source_md, raw, target, alias, anchor) of the distinct wikilinks of texts, those in code among them; what an export turns into links."""
    each = texts.select("source_id", "source_md", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(0)))).alias("raw"))
    inner = F.regexp_extract("raw", WIKILINK, 1)
    left = F.split_part(inner, F.lit("|"), F.lit(1))
    after = lambda c, sign: _or_null(F.when(F.instr(c, sign) > 0, F.substring(c, F.instr(c, sign) + 1, F.length(c))))
    return each.select("source_id", "source_md", "raw", _strip(F.split_part(left, F.lit("#"), F.lit(1))).alias("target"), after(inner, "|").alias("alias"), after(left, "#").alias("anchor")).where("target <> ''")


def export_text(texts: DataFrame, links: DataFrame, catalog: DataFrame, scheme: str = "doc") -> DataFrame:
    """(source_id, source_md, text): resolved wikilinks as `[label](scheme://id#anchor "id")`, others, and embedded images, as they were. links: resolved `wikilinks`."""
    title = catalog.select(F.col("doc_id").alias("target_id"), "title")
    done = skew_join(links.where("status = 'resolved'"), title, "target_id", "source_md")
    label = F.coalesce("alias", "title")
    new = F.concat(F.lit("["), label, F.lit(f"]({scheme}://"), F.col("target_id"), F.when(F.col("anchor").isNotNull(), F.concat(F.lit("#"), F.col("anchor"))).otherwise(F.lit("")), F.lit(' "'), F.col("target_id"), F.lit('")'))
    swaps = done.groupBy("source_id", "source_md").agg(F.collect_set(F.struct("raw", new.alias("new"))).alias("swaps"))  # the links of one text
    j = texts.join(swaps, ["source_id", "source_md"], "left")
    literal = lambda c: F.concat(F.lit(r"(?<!!)\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    value = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    swap = lambda t, x: F.regexp_replace(t, literal(x["raw"]), value(x["new"]))
    return j.select("source_id", "source_md", F.aggregate(F.sort_array(F.coalesce("swaps", F.array().cast("array<struct<raw:string,new:string>>"))), F.coalesce("text", F.lit("")), swap).alias("text"))


def export_files(texts: DataFrame, catalog: DataFrame, root: str, scheme: str = "doc") -> DataFrame:
    """Write a library as plain Markdown: a folder for each kind of document, its files in order of documents and places; an index; what didn't resolve.

    texts: source_id, source_md, text, place (their order in a document). Each document opens with a comment that names it. Written in
    range partitions, so a kind of any size is as many files as it needs. Returns the links that didn't resolve (source_id, source_md, raw, status, candidates).
    """
    links = cut(resolve(wikilinks(texts), catalog))
    out = export_text(texts, links, catalog, scheme).join(texts.select("source_id", "source_md", "place"), ["source_id", "source_md"])
    heads = texts.groupBy("source_id").agg(F.min(F.struct("place", "source_md")).alias("h")).select("source_id", "h.*", F.lit(True).alias("first"))
    kinds = cut(skew_join(out.join(heads, ["source_id", "place", "source_md"], "left"), catalog.select(F.col("doc_id").alias("source_id"), "doc_type"), "source_id", "source_md"))
    section = F.when(F.col("first"), F.concat(F.lit("<!-- id: "), F.col("source_id"), F.lit(" -->\n\n"), F.col("text"))).otherwise(F.col("text"))
    rows = kinds.select("doc_type", "source_id", "place", "source_md", F.concat(section, F.lit("\n")).alias("value"))
    rows.repartitionByRange("doc_type", "source_id", "place", "source_md").sortWithinPartitions("doc_type", "source_id", "place", "source_md").select(F.concat("doc_type", F.lit("s")).alias("kind"), "value").write.partitionBy("kind").text(root + "/content")
    index = kinds.select(F.concat("doc_type", F.lit("s")).alias("kind")).distinct().select(F.concat(F.lit("- ["), "kind", F.lit("](content/kind="), "kind", F.lit(")")).alias("value"))
    index.coalesce(1).sortWithinPartitions("value").write.text(root + "/index")  # a line a kind
    failed = links.where("status <> 'resolved'").select("source_id", "source_md", "raw", "status", "candidates")
    failed.write.json(root + "/diagnostics")
    return failed


def cited(text: Column, urls: Column, base: str = "") -> Column:
    """A text with its references `[n]` as links to urls (map<int, string>), code left alone.

    A line `[n] title` becomes `[n] [title](url)`; elsewhere `[n]`, with or without a target, becomes `[n](url)`. Numbers without a url
    stay; null gives ''.
    """
    whole = F.coalesce(text, F.lit(""))
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all(whole, F.lit(r"(?s)```.*?```|`[^`\n]*`"), F.lit(0))), lambda a, b: F.length(b) - F.length(a))
    mark = lambda i: F.concat(F.lit("\u0001"), i.cast("string"), F.lit("\u0002"))
    places = F.when(F.size(codes) > 0, F.sequence(F.lit(0), F.size(codes) - 1)).otherwise(F.array().cast("array<int>"))
    masked = F.aggregate(places, whole, lambda t, i: F.replace(t, F.get(codes, i), mark(i)))
    listed, inline = r"^\[(\d+)\]\s+(.+)$", r"\[(\d+)\](?:\([^)]*\))?"
    url = lambda x, form: F.concat(F.lit(base), F.lit("/"), F.regexp_replace(F.element_at(urls, F.regexp_extract(x, form, 1).try_cast("int")), "^/+", ""))

    def line(x: Column) -> Column:
        hits, gaps = F.regexp_extract_all(x, F.lit(inline), F.lit(0)), F.split(x, inline)
        linked = lambda h: F.coalesce(F.concat(F.lit("["), F.regexp_extract(h, inline, 1), F.lit("]("), url(h, inline), F.lit(")")), h)
        each = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(linked(F.get(hits, i)), F.lit("")))), "")
        own = F.coalesce(F.concat(F.lit("["), F.regexp_extract(x, listed, 1), F.lit("] ["), F.regexp_extract(x, listed, 2), F.lit("]("), url(x, listed), F.lit(")")), x)
        return F.when(x.rlike(listed), own).otherwise(each)

    done = F.array_join(F.transform(F.split(masked, "\n"), line), "\n")
    return F.aggregate(places, done, lambda t, i: F.replace(t, mark(i), F.get(codes, i)))
