"""Filling containers of fixed capacity (problem 8), and mixing sources to target shares (problem 9)."""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from math import ceil, floor, log

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, small

#: Folder of the public vocabulary files, and the file used to measure texts; both are parameters.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern that byte-level vocabularies of this family are used with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str = "text", into: str = "n_tokens", path: str | None = None) -> DataFrame:
    """df with the length of `text` in tokens; null and empty texts have 0. The vocabulary file is sent to executors that lack it."""
    where = path or f"{TOKENIZERS}/{VOCABULARY}"
    context = df.sparkSession.sparkContext
    sent = context.__dict__.setdefault("_strataquery_vocabularies", set())
    if os.path.exists(where) and where not in sent:
        context.addFile(os.path.realpath(where))
        sent.add(where)
    name = os.path.basename(os.path.realpath(where))

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(where if os.path.exists(where) else SparkFiles.get(name))
        return texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int32")

    return df.withColumn(into, count(F.coalesce(F.col(text), F.lit(""))))


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin (0, 1, ...) of every item; each size lies in 1..capacity.

    Each bin is filled greedily with the largest item that still fits. When none fits, its smallest item gives
    way to the two unpacked items that fill the widened gap best, if they leave less room.
    """
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(sizes, kind="stable")[::-1]:
        by_size[sizes[i]].append(int(i))
    left = np.bincount(sizes, minlength=capacity + 1)
    bins = np.full(len(sizes), -1, dtype=np.int64)
    index = np.arange(capacity + 1)
    top, number, open_items = capacity, 0, len(sizes)
    while open_items:
        below = np.maximum.accumulate(np.where(left > 0, index, 0))  # the largest size at hand up to each size
        gap, held = capacity, []
        while (s := int(below[gap])) > 0:
            while s > 0 and left[s] == 0:
                s = int(below[s - 1])
            if s == 0:
                break
            held.append((s, by_size[s].pop()))
            left[s] -= 1
            gap -= s
        if gap and len(held) > 1:
            small = min(held)
            room = gap + small[0]
            pair = _best_pair(left, room, small[0])
            if pair:
                held.remove(small)
                by_size[small[0]].append(small[1])
                left[small[0]] += 1
                for s in pair:
                    held.append((s, by_size[s].pop()))
                    left[s] -= 1
        for _, i in held:
            bins[i] = number
        number += 1
        open_items -= len(held)
    return bins


def _best_pair(left: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """Two sizes at hand of the largest sum in (more_than, room]."""
    window = left[: room + 1]
    have = np.flatnonzero(window)
    if not len(have):
        return None
    below = np.maximum.accumulate(np.where(window > 0, np.arange(room + 1), 0))
    other = below[room - have]
    single = (other == have) & (window[have] < 2)  # an item can't pair with itself
    if single.any():
        less = have[single]
        other[single] = below[np.maximum(less - 1, 0)]
    total = np.where(other > 0, have + other, 0)
    at = int(np.argmax(total))
    return (int(have[at]), int(other[at])) if total[at] > more_than else None


#: Containers and targets are configuration: up to so many are broadcast, more take part in a plain join.
CONTAINERS, TARGETS = 1_000, 10_000


def pack(documents: DataFrame, sizes: DataFrame, group_items: int = 50_000, path: str | None = None) -> DataFrame:
    """(container, bin, doc_id, piece, n_tokens, capacity_tokens) for every document of at least one token.

    A document longer than the capacity fills whole bins with its first pieces, which need no packing; its rest is packed like
    any other item. A container's items are hashed into groups of about `group_items` that are packed side by
    side, so no task holds more than one group's ids and sizes; every group leaves at most one loosely
    filled bin. Containers of null or non-positive capacity take nothing. Repeated doc_ids are separate items.
    """
    measured = with_token_counts(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), path=path).where("n_tokens > 0").select("doc_id", "n_tokens")
    boxes = sizes.where("capacity_tokens > 0").select("container", "capacity_tokens").distinct()
    wide = cut(measured).join(small(boxes, CONTAINERS))
    # what needs no packing: whole bins of long documents
    whole = F.floor((F.col("n_tokens") - 1) / F.col("capacity_tokens")).cast("int")
    rests = cut(wide.select("container", "capacity_tokens", "doc_id", whole.alias("piece"), (F.col("n_tokens") - whole * F.col("capacity_tokens")).cast("int").alias("size"), F.monotonically_increasing_id().alias("at")))
    full = rests.where("piece > 0").select("container", "capacity_tokens", "doc_id", "at", F.explode(F.sequence(F.lit(0), F.col("piece") - 1)).alias("piece"))
    filled = full.select("container", F.concat_ws("-", F.lit("whole"), "at", "piece").alias("bin"), "doc_id", "piece", F.col("capacity_tokens").alias("n_tokens"), "capacity_tokens")
    items = rests.groupBy("container").agg(F.count("*").alias("items"))
    placed = rests.join(small(items, CONTAINERS), "container").withColumn("group", F.pmod(F.xxhash64("doc_id", "at"), F.ceil(F.col("items") / group_items)).cast("bigint")).drop("items")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ignore_index=True)
        bins = best_two_fit(pdf["size"].to_numpy(), int(pdf["capacity_tokens"].iloc[0]))
        at = int(pdf["group"].iloc[0])
        return pd.DataFrame({"container": pdf["container"], "bin": [f"{at}-{b}" for b in bins], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "n_tokens": pdf["size"], "capacity_tokens": pdf["capacity_tokens"]})

    packed = placed.drop("at").groupBy("container", "capacity_tokens", "group").applyInPandas(fill, "container string, bin string, doc_id bigint, piece int, n_tokens int, capacity_tokens int")
    return packed.unionByName(filled)


def pivotal(p: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Pivotal rounding of inclusion probabilities p in order, with weights w and uniform numbers u.

    Two fractional values meet; weight moves at random between them until one of them is 0 or 1. Every
    expectation and the sum of p x w are kept; at most one value stays fractional.
    """
    out = p.astype(float).tolist()
    eps = 1e-9
    at = -1
    for i in range(len(out)):
        if not eps < out[i] < 1 - eps:
            out[i] = round(out[i])
            continue
        if at < 0:
            at = i
            continue
        a, b, r = out[at], out[i], w[at] / w[i]
        up, down = min(1 - a, b / r), min(a, (1 - b) / r)
        if u[i] < down / (up + down):
            a, b = a + up, b - up * r
        else:
            a, b = a - down, b + down * r
        open_a, open_b = eps < a < 1 - eps, eps < b < 1 - eps
        out[at], out[i] = a if open_a else round(a), b if open_b else round(b)
        at = at if open_a else i if open_b else -1
    return np.array(out, dtype=float)


def _draw(pdf: pd.DataFrame, seed: int, last: bool) -> np.ndarray:
    """Rounded values of one group, largest texts first; in the last group the residual is drawn too."""
    rng = np.random.default_rng([seed, int(last), int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF, len(pdf)])
    u = rng.random(len(pdf))
    p = pivotal(pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy(), u)
    return np.where((p > 0) & (p < 1), (rng.random(len(p)) < p).astype(float), p) if last else p


#: A text is drawn by itself if its square is more than this part of the squares of all texts of its source up to its class of size.
PART = 1 / 64


def _outliers(texts: DataFrame) -> DataFrame:
    """Texts (doc_id, source, n_tokens) whose square is more than PART of the squares of all texts up to their class of size.

    Rounding in pairs ends with one open text of about the size up to which squares add up to its own; these would likely stay open to
    the end. In a class (sizes that differ by less than a factor of two) there are fewer than 1 / PART: at most some 2,000 a source.
    """
    square = F.pow(F.col("n_tokens").cast("double"), 2)
    size_class = F.floor(F.log2("n_tokens")).cast("int")
    sums = texts.groupBy("source", size_class.alias("c")).agg(F.sum(square).alias("sq"))
    upto = sums.select("source", "c", F.sum("sq").over(W.partitionBy("source").orderBy("c").rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    return texts.withColumn("c", size_class).join(small(upto, 32 * TARGETS), ["source", "c"]).where(square > PART * F.col("upto")).select("doc_id", "source", "n_tokens")


def _one_by_one(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Copies of the outliers of a source, largest first: each as likely as what is left to draw asks for, and never so few or many that the rest couldn't make up for it."""
    pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], ignore_index=True)
    gap, usable, most = float(pdf["goal"].iloc[0]), float(pdf["usable"].iloc[0]), int(pdf["most"].iloc[0])
    u = np.random.default_rng([seed, int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF, len(pdf)]).random(len(pdf))
    copies = []
    for n, r in zip(pdf["n_tokens"].tolist(), u):
        x = gap / usable
        low = max(0, ceil((gap - most * (usable - n)) / n))
        c = max(0, min(most, floor(gap / n), max(low, floor(x) + int(r < x - floor(x)))))
        copies.append(c)
        gap, usable = gap - n * c, usable - n
    return pdf.assign(copies=copies)[["doc_id", "source", "n_tokens", "copies"]]


def _by_source(spark: SparkSession, values: dict[str, tuple], names: str) -> DataFrame:
    """A table of configuration size: source and some numbers."""
    return small(spark.createDataFrame([(k, *map(float, v)) for k, v in values.items()], f"source string, {names}"), TARGETS)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, group_items: int = 50_000, fan_in: int = 64, least: float = 0.5, seed: int = 7, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Copies a text, and the shares reached.

    Returns (doc_id, source, n_tokens, copies), one row per distinct text of a target source that can be used, and (source,
    target_share, available_tokens, tokens, actual_share, max_copies), one row a target. Sources are compared trimmed and
    lower-cased; equal texts count as one, under their least doc_id, so no text is used more than
    max_repeats times. Without `total_tokens` the collection is the largest in which every source that has
    text can reach its share; a text longer than its source's whole target would break the share with one copy and gets none,
    which lowers the total, though never under `least` of what all texts together would give. Every other text gets floor(x)
    copies, x = share x total / available, and one more with probability x - floor(x), drawn by pivotal rounding that keeps the
    sum of tokens: the texts that weigh much among those of their source (see _outliers) one by one, largest first, so
    that the others make up for their luck; hashed groups of all others in order of length; then the groups' residuals in a tree
    of `fan_in`. Targets without text reach 0. Null or empty texts and other sources are left out.
    """
    spark = documents.sparkSession
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    goal = targets.where(F.col("source").isNotNull()).groupBy(norm(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = documents.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select("doc_id", norm(F.col("source")).alias("source"), "text").join(small(goal.select("source"), TARGETS), "source")
    # texts are measured where they are; only their hashes and lengths cross the network
    counted = with_token_counts(wanted, path=path).where("n_tokens > 0").select("doc_id", "source", "n_tokens", F.sha2("text", 256).alias("h"))
    once = counted.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("d"), F.max("n_tokens").alias("n_tokens"))
    texts = cut(once.select("d.doc_id", "d.source", "n_tokens"))
    have = {r["source"]: (int(r["n"]), int(r["t"])) for r in texts.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}  # one row a target
    rule = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in goal.collect()}
    live = {s: v for s, v in rule.items() if s in have and v[0] > 0 and v[1] > 0}
    usable = {s: have[s][1] for s in live}
    reach = lambda parts: min((parts[s][0] / share for s, (share, _) in live.items()), default=0.0)
    most = min(reach({s: (m * usable[s],) for s, (_, m) in live.items()}), float(total_tokens or np.inf)) if live else 0.0
    total = most
    while live:  # each round leaves out longer texts than the last; most often there is one
        limits = _by_source(spark, {s: (share * total,) for s, (share, _) in live.items()}, "longest double")
        usable = dict.fromkeys(live, 0) | {r["source"]: int(r["t"]) for r in texts.join(limits, "source").where("n_tokens <= longest").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
        now = max(least * most, min(total, reach({s: (m * usable[s],) for s, (_, m) in live.items() if usable[s]} | {s: (np.inf,) for s in live if not usable[s]})))
        if now >= total:
            break
        total = now
    longest = _by_source(spark, {s: (share * total,) for s, (share, _) in live.items()} or {"": (0,)}, "longest double")
    fitting = cut(texts.join(longest, "source").where("n_tokens <= longest").select("doc_id", "source", "n_tokens"))
    goals = _by_source(spark, {s: (share * total, usable[s], m) for s, (share, m) in live.items()} or {"": (0, 0, 0)}, "goal double, usable double, most double")
    alone = cut(_outliers(fitting).join(goals, "source").groupBy("source").applyInPandas(lambda pdf: _one_by_one(pdf, seed), "doc_id bigint, source string, n_tokens int, copies int"))
    drawn = dict.fromkeys(live, 0)
    for r in alone.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("drawn"), F.sum("n_tokens").alias("n")).collect():  # one row a target
        drawn[r["source"]] = int(r["drawn"])
        usable[r["source"]] -= int(r["n"])
    total = min([total, *((drawn[s] + m * usable[s]) / share for s, (share, m) in live.items() if drawn[s] + usable[s])])
    x = {s: min(max(0.0, (share * total - drawn[s]) / usable[s]), float(m)) if usable[s] else 0.0 for s, (share, m) in live.items()}
    groups = {s: max(1, ceil(have[s][0] / group_items)) for s in live}
    plan = _by_source(spark, {s: (x[s], groups[s]) for s in live} or {"": (0, 1)}, "x double, groups double")
    others = fitting.join(small(alone.select("doc_id"), 200_000), "doc_id", "left_anti")
    start = others.join(plan, "source").select("doc_id", "source", "n_tokens", F.floor("x").cast("int").alias("base"), (F.col("x") - F.floor("x")).alias("p"), F.pmod(F.xxhash64("doc_id"), F.col("groups").cast("bigint")).cast("int").alias("g"))

    def rounds(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], ignore_index=True)
            return pdf.assign(p=_draw(pdf, seed, last))

        return run

    schema = "doc_id bigint, source string, n_tokens int, base int, p double, g int"
    levels = max(1, 1 + ceil(log(max(groups.values(), default=1), fan_in) - 1e-9))
    parts, now = [], start
    for level in range(levels):
        done = cut(now.groupBy("source", "g").applyInPandas(rounds(level == levels - 1), schema))
        parts.append(done.where("p = 0 or p = 1"))
        now = done.where("p > 0 and p < 1").withColumn("g", (F.col("g") / fan_in).cast("int"))
    chosen = parts[0]
    for more in parts[1:]:
        chosen = chosen.unionByName(more)
    copies = chosen.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p")).cast("int").alias("copies")).unionByName(alone)
    used = copies.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("tokens"), F.max("copies").alias("max_copies"))
    avail = texts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    one = used.agg(F.sum("tokens").alias("all_tokens"))
    shares = goal.join(avail, "source", "left").join(used, "source", "left").join(F.broadcast(one)).select("source", "target_share", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"))
    return copies, shares
