"""From Markdown to nodes and chunks: lines, frontmatter, headings, windows of text, stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import numbered

# Chunk size and overlap in characters; a numbered line that may be a heading.
TARGET, OVERLAP = 500, 100
FRONTMATTER = r"(?s)\A---\n.*?\n---\n"
NUMBERED = r"^(\d+(?:\.\d+)*)\s+(\S.*)$"


def windows(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """array<string>: a blank text has none, one of at most `target` characters is whole, else windows of `target` every target - overlap characters."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(target - overlap))
    return F.when(F.trim(F.regexp_replace(t, r"\s+", " ")) == "", F.array().cast("array<string>")).when(n <= target, F.array(t)).otherwise(F.transform(starts, lambda s: F.substring(t, s + 1, F.lit(target))))


def body_lines(text: Column) -> Column:
    """Lines of a Markdown text without its frontmatter."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), FRONTMATTER, ""), "\n")


def section(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (0-based, end excluded; 0 or null: to the end of the text), trimmed."""
    lines = body_lines(text)
    s = F.coalesce(start, F.lit(0))
    e = F.when(F.coalesce(end, F.lit(0)) == 0, F.size(lines)).otherwise(F.least(F.coalesce(end, F.lit(0)), F.size(lines)))
    return F.regexp_replace(F.array_join(F.slice(lines, s + 1, F.greatest(F.lit(0), e - s)), "\n"), r"^\s+|\s+$", "")


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, fenced): every line with its number and whether it lies in a fenced block.

    The parity of fence lines before it is a running sum inside one text; texts are spread by key.
    """
    rows = texts.select(key, F.posexplode(body_lines(F.col(text))).alias("pos", "line"))
    fence = F.col("line").rlike(r"^\s*(?:```|~~~)")
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("__f", F.sum(fence.cast("int")).over(upto)).withColumn("fenced", (F.col("__f") % 2 == 1) | fence).drop("__f")


def pseudo_headings(lines: DataFrame) -> DataFrame:
    """(..., number, depth, promoted) of numbered lines outside fences that carry no `#`: depth counts the number's parts; depth 2 and more is promoted."""
    m = lines.where(~F.col("fenced") & F.col("line").rlike(NUMBERED))
    number = F.regexp_extract("line", NUMBERED, 1)
    depth = F.size(F.split(number, r"\."))
    level = F.least(F.lit(6), depth)
    return m.withColumn("number", number).withColumn("depth", depth).withColumn("promoted", F.when(depth >= 2, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("line"))).otherwise(F.col("line")))


def headings(lines: DataFrame, key: str) -> DataFrame:
    """(key, pos, level, title, end_pos, path): ATX headings outside fences, where their sections end, and the titles above them.

    The path is the last title of each smaller level since any heading of a smaller level closed it.
    """
    h = lines.where(~F.col("fenced") & F.col("line").rlike(r"^#{1,6}\s+\S")).select(key, "pos", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.regexp_replace("line", r"^#{1,6}\s+|\s+#*\s*$", "").alias("title"))
    w = W.partitionBy(key).orderBy("pos")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    for i in range(1, 7):
        # the last heading of level i counts unless one of a smaller level came after it
        last = F.last(F.when(F.col("level") == i, F.struct("pos", "title")), ignorenulls=True).over(so_far)
        shut = F.last(F.when(F.col("level") < i, F.col("pos")), ignorenulls=True).over(so_far)
        h = h.withColumn(f"__t{i}", F.when((F.col("level") >= i) & (shut.isNull() | (last["pos"] > shut)), last["title"]))
    path = F.array_compact(F.array(*(F.col(f"__t{i}") for i in range(1, 7))))
    return h.select(key, "pos", "level", "title", F.lead("pos").over(w).alias("end_pos"), path.alias("path"))


def node_keys(nodes: DataFrame) -> DataFrame:
    """Adds duplicate_ordinal and node_key: the n-th repeat of (doc_key, path, breadcrumb) by pos, and a hash of all of them."""
    w = W.partitionBy("doc_key", "path", "breadcrumb").orderBy("pos")
    named = nodes.withColumn("duplicate_ordinal", F.row_number().over(w) - 1)
    return named.withColumn("node_key", F.concat(F.lit("n_"), F.left(F.sha2(F.to_json(F.struct("doc_key", "path", "breadcrumb", "duplicate_ordinal")), 256), F.lit(24))))


def local_ids(chunks: DataFrame) -> DataFrame:
    """Adds local_id: dense from 0 in a document, by node_key, ordinal and hash of the body."""
    rows = chunks.withColumn("__h", F.sha2(F.coalesce("body", F.lit("")), 256))
    ids = numbered(rows, ["doc_key"], ["node_key", "node_local_ordinal", "__h", "chunk_id"], "local_id")
    return chunks.join(ids.select("chunk_id", "local_id"), "chunk_id")
