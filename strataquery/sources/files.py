"""Reading a content tree: discovery, fingerprints, frontmatter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import multiset_hash
from ..session import cut

# Places of documents in a content tree.
BOOK, PAPER, NOTE = r"/books/([^/_][^/]*)/([^/]+\.md)$", r"/papers/([^/_][^/]*)/(_index\.md)$", r"/notes/([^/_][^/]*)\.md$"


def list_tree(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """(path, length, modificationTime) of all files below root that end in suffix.

    Spark's own file sources pass over names that start with `_`, among them every `_index.md`, so tasks list the tree:
    one starts at each entry of the root, and works directory by directory.
    """
    from pyarrow import fs as afs

    system, base = _system(root)
    prefix = root.rstrip("/").removesuffix(base.rstrip("/")) or "file://"
    tops = [(x.path, x.type == afs.FileType.Directory) for x in system.get_file_info(afs.FileSelector(base))]  # entries of one directory

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as a

        for pdf in batches:
            for top, is_dir in zip(pdf["path"], pdf["is_dir"]):
                inside, _ = _system(root)
                todo = [top]
                while todo:
                    at = todo.pop()
                    found = inside.get_file_info(a.FileSelector(at)) if is_dir or at != top else [inside.get_file_info(at)]
                    todo += [x.path for x in found if x.type == a.FileType.Directory]
                    files = [x for x in found if x.type == a.FileType.File and x.path.endswith(suffix)]
                    if files:
                        yield pd.DataFrame({"path": [x.path for x in files], "length": [x.size for x in files], "modificationTime": [x.mtime for x in files]})

    rows = spark.createDataFrame(tops, "path string, is_dir boolean").repartition(max(1, len(tops)))
    listed = rows.mapInPandas(walk, "path string, length bigint, modificationTime timestamp")
    return listed.withColumn("path", F.concat(F.lit(prefix), F.col("path")))


def read_files(listed: DataFrame) -> DataFrame:
    """(path, length, modificationTime, content) of listed files; tasks read a few files at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                yield part.assign(content=[_bytes(p) for p in part["path"]])

    return listed.select("path", "length", "modificationTime").repartition("path").mapInPandas(read, "path string, length bigint, modificationTime timestamp, content binary")


def read_tree(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """read_files of all files below root that end in suffix."""
    return read_files(list_tree(spark, root, suffix))


def write_tree(files: DataFrame, root: str) -> int:
    """Write (path, text) as UTF-8 files below root, path by path; returns how many. A file appears under its name when it is whole."""
    base = root.rstrip("/")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = _system(base)
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["text"]):
                full = f"{at}/{path}"
                system.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{full}.part") as out:
                    out.write((text or "").encode())
                system.move(f"{full}.part", full)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "text").mapInPandas(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def stable_records(spark: SparkSession, root: str, suffix: str = ".md", attempts: int = 3) -> DataFrame:
    """(path, length, modificationTime, sha256, tries): a snapshot of a tree in which no file changed while it was read.

    Each file is read once between two looks at its size and time, and read again if they differ; then the tree is listed once
    more, and files that came, went or changed since are all read anew. A tree that doesn't come to rest in `attempts` is an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        from pyarrow import fs as a

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                system, inner = _system(path)
                look = lambda system=system, inner=inner: (lambda i: (i.size, i.mtime) if i.type == a.FileType.File else None)(system.get_file_info(inner))
                for n in range(1, attempts + 1):
                    before = look()
                    if before is None:
                        break
                    digest = sha256(_bytes(path)).hexdigest()
                    if look() == before:
                        rows.append((path, before[0], before[1], digest, n))
                        break
            yield pd.DataFrame(rows, columns=["path", "length", "modificationTime", "sha256", "tries"]).astype({"tries": "int32", "length": "int64"})

    schema = "path string, length bigint, modificationTime timestamp, sha256 string, tries int"
    stat = ["path", "length", "modificationTime"]
    todo, done = list_tree(spark, root, suffix), None
    for _ in range(attempts):
        fresh = cut(todo.select("path").repartition("path").mapInPandas(read, schema))
        done = fresh if done is None else done.unionByName(fresh)
        now = cut(list_tree(spark, root, suffix))
        done = cut(done.join(now.select(*stat), stat, "left_semi"))
        todo = now.join(done.select(*stat), stat, "left_anti")
        if todo.isEmpty():
            return done
    raise RuntimeError(f"{root} did not come to rest in {attempts} attempts")


def _system(path: str):
    """(file system, path in it) of a path with or without a scheme; names may hold any characters."""
    from pyarrow import fs

    scheme, sign, rest = path.partition("://")
    if not sign or scheme == "file":
        return fs.LocalFileSystem(), rest if sign else path
    host, _, inner = rest.partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, f"{base.rstrip('/')}/{inner}"


def _bytes(path: str) -> bytes:
    system, inner = _system(path)
    with system.open_input_stream(inner) as f:
        return f.read()


def file_records(files: DataFrame) -> DataFrame:
    """(path, sha256, length): the fingerprint of every file's bytes."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def discover(paths: DataFrame) -> DataFrame:
    """(doc_key, doc_type, slug, files): books need `_index.md` and chapters, papers are their `_index.md`, notes are flat files; folders named `_...` are skipped.

    paths: path (and more columns). Files are sorted; documents in type order (book, paper, note), then slug.
    """
    p = F.col("path")
    kind = F.when(p.rlike(BOOK), "book").when(p.rlike(PAPER), "paper").when(p.rlike(NOTE), "note")
    slug = F.when(kind == "book", F.regexp_extract(p, BOOK, 1)).when(kind == "paper", F.regexp_extract(p, PAPER, 1)).otherwise(F.regexp_extract(p, NOTE, 1))
    found = paths.select("path", kind.alias("doc_type"), slug.alias("slug")).where("doc_type is not null")
    docs = found.groupBy("doc_type", "slug").agg(F.sort_array(F.collect_set("path")).alias("files"))
    whole = (F.col("doc_type") != "book") | (F.exists("files", lambda f: f.endswith("/_index.md")) & (F.size("files") >= 2))
    order = F.when(F.col("doc_type") == "book", 0).when(F.col("doc_type") == "paper", 1).otherwise(2)
    return docs.where(whole).select(F.concat_ws(":", "doc_type", "slug").alias("doc_key"), "doc_type", "slug", "files").orderBy(order, "slug")


def document_fingerprints(documents: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_key, content_hash): a hash over the (path, sha256) of a document's files, whatever their order."""
    each = documents.select("doc_key", F.explode("files").alias("path")).join(records.select("path", "sha256"), "path")
    return each.groupBy("doc_key").agg(multiset_hash(F.to_json(F.struct("path", "sha256"))).alias("content_hash"))


def cached_records(listed: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, length, modificationTime, sha256, reused) of listed files: only those are read whose stat the cache (with sha256) lacks."""
    stat = ["path", "length", "modificationTime"]
    known = listed.select(*stat).join(cache.select(*stat, "sha256").distinct(), stat).withColumn("reused", F.lit(True))
    new = read_files(listed.join(cache.select(*stat), stat, "left_anti")).select(*stat, F.sha2("content", 256).alias("sha256"), F.lit(False).alias("reused"))
    return known.unionByName(new)


def is_safe_path(path: Column) -> Column:
    """Relative, without traversal, drives or NUL."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)|^[/\\]|^[A-Za-z]:|\x00")


def is_doc_key(key: Column) -> Column:
    """`type:slug` with a known type and a slug without separators, colon or NUL."""
    return F.coalesce(key.rlike(r"^(?:book|paper|note):[^/\\:\x00]+$"), F.lit(False))


FRONT = "path string, meta map<string,string>, body string, body_offset int, error string"


def parse_frontmatter(texts: DataFrame) -> DataFrame:
    """FRONT of (path, text): the head between two `---` lines as text values (lists joined by '\\u001f'), the body, its first line, and what is wrong.

    Simple YAML: scalars, [inline] and dash lists. An unterminated head or a line that is none of these is an error, and the text the body.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *_front(t or "")) for p, t in zip(pdf["path"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["path", "meta", "body", "body_offset", "error"]).astype({"body_offset": "int32"})

    return texts.select("path", "text").mapInPandas(parse, FRONT)


def _front(text: str) -> tuple[dict, str, int, str | None]:
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return {}, text, 0, None
    ends = [i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"]
    if not ends:
        return {}, text, 0, "unterminated frontmatter"
    meta: dict[str, str] = {}
    last = ""
    for x in lines[1 : ends[0]]:
        bare = x.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- ") and last:
            meta[last] = "\x1f".join(filter(None, [meta[last], bare[2:].strip().strip("'\"")]))
            continue
        name, colon, value = x.partition(":")
        if not colon or not name.strip() or x[0].isspace():
            return {}, text, 0, f"invalid frontmatter line: {bare[:60]}"
        last, value = name.strip(), value.strip()
        meta[last] = "\x1f".join(v.strip().strip("'\"") for v in value[1:-1].split(",")) if value.startswith("[") and value.endswith("]") else value.strip("'\"")
    return meta, "\n".join(lines[ends[0] + 1 :]), ends[0] + 1, None


def governance(meta: DataFrame) -> DataFrame:
    """(path, status, reviewed_at, sources, confidence, problem): status draft, reviewed or archived, confidence in 0..1; else a problem."""
    m = F.col("meta")
    conf = F.expr("try_cast(meta['confidence'] as double)")
    status = F.coalesce(m["status"], F.lit("draft"))
    problem = F.when(~status.isin("draft", "reviewed", "archived"), "status").when(m["confidence"].isNotNull() & (conf.isNull() | ~conf.between(0, 1)), "confidence")
    return meta.select("path", status.alias("status"), m["reviewed_at"].alias("reviewed_at"), F.when(m["source"].isNotNull(), F.split(m["source"], "\x1f")).otherwise(F.array().cast("array<string>")).alias("sources"), conf.alias("confidence"), problem.alias("problem"))


def missing_governance(meta: DataFrame, required: tuple[str, ...] = ("id", "title", "status")) -> DataFrame:
    """(path, missing): keys a migration would add; files that have all give no row."""
    gone = F.filter(F.array(*map(F.lit, required)), lambda k: F.element_at("meta", k).isNull())
    return meta.select("path", gone.alias("missing")).where(F.size("missing") > 0)


def conflicting_ids(meta: DataFrame) -> DataFrame:
    """(id, files): ids that more than one file claims, counted before the shuffle."""
    return meta.where(F.element_at("meta", "id").isNotNull()).groupBy(F.element_at("meta", "id").alias("id")).agg(F.count("*").alias("files")).where("files > 1")


def migrated(texts: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """(path, text, missing): every readable file with the keys its head lacks, each with its default (a column of path).

    New lines go before the end of the head, or into a new head; nothing else changes. Files whose head can't be read, or that lack
    nothing, give no row.
    """
    front = parse_frontmatter(texts).where("error is null").select("path", F.map_keys("meta").alias("keys"), "body_offset")
    lines = F.array_compact(F.array(*(F.when(~F.array_contains("keys", k), F.struct(F.lit(k).alias("k"), F.concat(F.lit(f"{k}: "), v).alias("line"))) for k, v in defaults.items())))
    todo = texts.select("path", "text").join(front.withColumn("new", lines).where(F.size("new") > 0), "path")
    added = F.array_join(F.transform("new", lambda x: x["line"]), "\n")
    parts = F.split("text", "\n")
    last = F.col("body_offset") - 1  # the line that ends the head, if there is one
    inside = F.concat_ws("\n", F.slice(parts, 1, last), F.array(added), F.slice(parts, F.col("body_offset"), F.size(parts)))
    text = F.when(F.col("body_offset") > 0, inside).otherwise(F.concat(F.lit("---\n"), added, F.lit("\n---\n"), F.coalesce("text", F.lit(""))))
    return todo.select("path", text.alias("text"), F.transform("new", lambda x: x["k"]).alias("missing"))


def migrate(spark: SparkSession, root: str, backup: str, defaults: dict[str, Column], suffix: str = ".md") -> DataFrame:
    """Write `migrated` of a tree over it, after the files it changes are copied below `backup`; returns (path, missing), paths below root."""
    files = read_tree(spark, root, suffix).select(F.substring("path", len(root.rstrip("/")) + 2, 1 << 20).alias("path"), F.decode("content", "UTF-8").alias("text"))
    todo = cut(migrated(files, defaults))
    write_tree(files.join(todo.select("path"), "path", "left_semi"), backup)
    write_tree(todo, root)
    return todo.select("path", "missing")


def publish_documents(documents: DataFrame, root: str) -> int:
    """Write documents (doc_type, slug, title, author, tags, text) into a content tree, each with a head; returns how many.

    Books and papers are folders with an `_index.md`, notes (and unknown types) files. A missing title is the slug; an empty author or no
    tags give no line.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    title = F.coalesce(F.nullif("title", F.lit("")), "slug")
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), quoted(title)), F.when(F.col("author") != "", F.concat(F.lit("author: "), quoted(F.col("author")))), F.when(F.size("tags") > 0, F.concat(F.lit("tags: ["), F.array_join(F.transform("tags", quoted), ", "), F.lit("]"))), F.lit("---"))
    folder = F.when(F.col("doc_type") == "book", "books").when(F.col("doc_type") == "paper", "papers").otherwise("notes")
    path = F.concat(folder, F.lit("/"), "slug", F.when(folder == "notes", F.lit(".md")).otherwise(F.lit("/_index.md")))
    return write_tree(documents.where(is_safe_path(F.col("slug"))).select(path.alias("path"), F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text")), root)


def page_list(pages: Column, total: Column) -> Column:
    """0-based pages of a list like '1-3,7', cut to the document; null or empty: all pages."""
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    num = lambda s: F.trim(s).try_cast("int")

    def span(part: Column) -> Column:
        lo = F.greatest(F.lit(1), num(F.split_part(part, F.lit("-"), F.lit(1))))
        hi = F.least(total, num(F.when(F.contains(part, F.lit("-")), F.split_part(part, F.lit("-"), F.lit(2))).otherwise(part)))
        return F.when(lo <= hi, F.sequence(lo - 1, hi - 1)).otherwise(F.array().cast("array<int>"))

    return F.when(F.coalesce(pages, F.lit("")) == "", every).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(pages, ","), span)))))
