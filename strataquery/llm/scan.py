"""Repairing text read from scanned pages (problem 1).

Edge lines (running headers, page numbers) are told by their form and the titles of the record; word breaks
by hyphen evidence from the corpus; misread words by joining rare words to frequent ones on the
difference of their anagram hashes. Texts are read once, in the JVM; words are judged by counted tokens.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_counts, skew_join
from ..session import at_most, cut

# What scanners read (left) for what was printed (right). Ligature signs are among them.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("c", "e"), ("b", "h"), ("u", "n"), ("f", "t"), ("q", "g"),
    ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("6", "b"), ("8", "b"), ("9", "g"),
    ("e", "c"), ("h", "b"), ("n", "u"), ("t", "f"), ("g", "q"), ("m", "rn"), ("i", "l"), ("l", "i"), ("a", "o"), ("o", "a"), ("y", "v"), ("v", "y"),
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
]
#: Confusions between letters that real words differ by too; they need WEAK times the evidence.
RARER = {("e", "c"), ("h", "b"), ("n", "u"), ("t", "f"), ("g", "q"), ("m", "rn"), ("i", "l"), ("l", "i"), ("a", "o"), ("o", "a"), ("y", "v"), ("v", "y")}
WEAK = 8
#: Misreadings that don't look like letters; a word with one of them needs less evidence.
SIGNS = "015!|ﬀﬁﬂﬃﬄﬅﬆ"

#: Marks of a word break: hyphen-minus, hyphen, non-breaking hyphen, not sign, soft hyphen.
HYPHENS = "-‐‑¬­"
ROMAN = "(?=[ivxlc])(?:x{0,3}l?x{0,3})(?:ix|iv|v?i{0,3})"
PAGE = rf"(?i)^\s*[-–—·•*\[(|]*\s*(?:page|p\.|pg\.|seite|s\.|página|pág\.|стр\.)?\s*(?:\d{{1,4}}|{ROMAN})(?:\s*(?:/|of|von|de)\s*\d{{1,4}})?\s*[-–—·•*\])|]*\s*$"
#: Signs and blanks that PAGE allows in any number around a page number.
ORNAMENTS = "-–—·•*[](| \t\r\f\v"
NUMBERED = r"(^\s*[-–—·•\[(]*\s*\d{1,4}\s*[-–—·•\])]*\s+)|(\s+[-–—·•\[(]*\s*\d{1,4}\s*[-–—·•\])]*\s*$)"
CHAPTER = r"(?i)^\s*(?:chap(?:ter|\.)?|kapitel|kap\.|chapitre|cap[íi]tulo|cap\.|глава|第)\s*(?:\d{1,3}|[ivxl]+)\s*[.:章]?\s*"
EDGE = "\u0001"

def _title_form(t: Column) -> Column:
    """Titles and lines as they are compared: without markup signs, spaces folded, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(t, r"[*`#=\[\]]+", " "), r"\s+", " ")))


def marked_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text, header, number, titles, tokens, named): one row a chunk; `text` is without its edge lines.

    `tokens` are those of the text, `named` those of the titles (see with_tokens_of). An edge line is a page number alone, or a title of the record (its breadcrumb or title; a page number or chapter
    word before or after it is ignored). A first line that is the chunk's own title is a heading unless it carries a
    number. Repeats of a chunk_id count once; null and empty bodies give no row.
    """
    fields = F.struct("body", "title", "breadcrumb")
    once = chunks.where(F.col("chunk_id").isNotNull() & (F.col("body") != "")).groupBy("chunk_id").agg(F.min(fields).alias("c")).select("chunk_id", "c.*")
    titles = F.array_compact(F.concat(F.coalesce("breadcrumb", F.array().cast("array<string>")), F.array("title")))
    named = once.withColumn("names", F.filter(F.transform(titles, _title_form), lambda t: F.length(t) > 0))
    # Cheap guards come first: only a line that holds a title, in a text that does, or is as short as a page number, meets the patterns.
    named = named.withColumn("whole", _title_form(F.col("body"))).withColumn("near", F.filter("names", lambda n: F.contains(F.col("whole"), n))).drop("whole")
    known = lambda form: F.array_contains(F.col("names"), form)

    def kind(line: Column) -> Column:
        bare = F.regexp_replace(line, NUMBERED, "")
        core = F.regexp_replace(bare, CHAPTER, "")
        # of two titles the second may be cut short
        parts = F.contains(line, F.lit("|")) & F.forall(F.split(core, r"\s*\|\s*"), lambda x: F.exists("names", lambda n: (n == _title_form(x)) | ((F.length(x) >= 12) & F.startswith(n, _title_form(x)))))
        holds = (F.size("near") > 0) & F.exists("near", lambda n: F.contains(_title_form(line), n)) & ~line.rlike(r"^\s*(?:#{1,6}\s|=|\*\*|`|\[\[)|=\s*$")
        header = holds & (known(_title_form(core)) | known(_title_form(bare)) | known(_title_form(line)) | parts)
        page = (F.length(F.translate(line, ORNAMENTS, "")) <= 30) & line.rlike(PAGE) & line.rlike(r"\d|\p{L}")
        return F.when(page, "number").when(header, F.when(bare != line, "both").otherwise("header")).otherwise("")

    lines = named.withColumn("lines", F.split("body", "\n"))
    told = lines.withColumn("kinds", F.when(F.size("lines") > 1, F.transform("lines", kind)).otherwise(F.array()))
    marked = F.array_join(F.transform("lines", lambda x, i: F.when(F.coalesce(F.get("kinds", i), F.lit("")) != "", F.lit(EDGE)).otherwise(x)), "\n")
    flat = told.select(
        "chunk_id",
        F.when(F.exists("kinds", lambda k: k != ""), without_edges(marked)).otherwise(F.col("body")).alias("text"),
        F.exists("kinds", lambda k: k.isin("header", "both")).alias("header"),
        F.exists("kinds", lambda k: k.isin("number", "both")).alias("number"),
        F.array_join(titles, "\n").alias("titles"),
    )
    return with_tokens_of(with_tokens_of(flat, "text", "tokens"), "titles", "named")


def without_edges(text: Column) -> Column:
    """Edge lines and the blank lines around them go; the sentence they cut continues."""
    t = F.regexp_replace(text, rf"^(?:\s*{EDGE}\s*\n)+\s*|(?:\n\s*{EDGE}\s*)+$", "")
    return F.regexp_replace(F.regexp_replace(t, rf"\s*{EDGE}(?:\s*{EDGE})*[ \t]*\n*", "\n"), EDGE, "")


BREAK = rf"([\p{{L}}\p{{M}}0-9!|]*\p{{L}}[0-9!|]*)([{HYPHENS}])[ \t]?\n[ \t]*(\p{{L}}[\p{{L}}\p{{M}}0-9!|]*|[0-9!|]\p{{L}}[\p{{L}}\p{{M}}0-9!|]*)"


#: What a word can be made of, what never is part of one (code, links, templates, formulas), and how lines end inside words.
IN_WORD = r"\p{L}\p{M}0-9!|"
ASIDE = r"(?s)```.*?```|\{\{.*?\}\}|\[\[.*?\]\]|<[^>]*>|`[^`\n]*`|\$[^$\n]*\$|\]\([^)\n]*\)"
BROKEN = rf"[{HYPHENS}][ \t]?\n"


def with_tokens_of(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with the words of `text` as the scanner left them, lower case, compounds with their hyphens: code, links and templates aside, broken words in one piece.

    Signs that end a sentence, or stand before a sign, are no part of a word. One split of the text; what only some texts need
    is guarded by the characters it starts with. Each step is a column, since an expression that is used twice would be computed twice.
    """
    step = F.col("__t")
    rows = df.withColumn("__t", F.when(F.col(text).rlike(r"[`{\[<$\]]"), F.regexp_replace(text, ASIDE, " ")).otherwise(F.col(text)))
    rows = rows.withColumn("__t", F.lower(F.when(step.rlike(BROKEN), F.regexp_replace(step, BREAK, "$1$3")).otherwise(step)))
    rows = rows.withColumn("__t", F.when(step.rlike("[!|]"), F.regexp_replace(step, rf"(?<![{IN_WORD}])[0-9!|]+(?=[!|])|(?<=\p{{L}}\p{{L}})!+(?![{IN_WORD}])", "")).otherwise(step))
    return rows.withColumn(into, F.split(step, rf"[^{IN_WORD}‑-]+")).drop("__t")


def words_of(tokens: DataFrame, *keep: str) -> DataFrame:
    """(word, *keep) of distinct tokens (token, ...): the parts of compounds that hold a letter."""
    return tokens.select(F.explode(F.split("token", "[-‑]")).alias("word"), *keep).where((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}"))


def _anagram(word: Column) -> Column:
    """Order-free hash: the sum of a wide value for each character, so a fixed exchange of letters is a fixed difference."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.when(c == "", F.lit(0)).otherwise(F.shiftright(F.xxhash64(c), 8)))


def token_counts(marked: DataFrame) -> DataFrame:
    """(token, n, titled): how often every token occurs in texts and titles of all chunks, and whether a title has it."""
    each = marked.select(F.explode("tokens").alias("token"), F.lit(False).alias("t")).unionByName(marked.select(F.explode("named").alias("token"), F.lit(True).alias("t")))
    return each.where(F.length("token") >= 2).groupBy("token").agg(F.count("*").alias("n"), F.max("t").alias("titled"))


def vocabulary(counted: DataFrame) -> DataFrame:
    """(word, n, titled) of counted tokens."""
    return words_of(counted, "n", "titled").groupBy("word").agg(F.sum("n").alias("n"), F.max("titled").alias("titled"))


def corrections(words: DataFrame, ratio: float = 8.0, least: int = 4) -> DataFrame:
    """(word, fixed, n): the best ranked correction of every word that is a misread one.

    A rare word (at least `ratio` times rarer than its variant, or holding a sign of SIGNS) meets frequent
    words whose anagram hash differs by a known confusion or two; what only shares letters is cut by an edit
    check. Fewer confusions win, then frequency, then the lesser word. A word with a sign inside that has no variant in
    the corpus is read by the likeliest sign confusions. Titles aren't scanned: a word of a title without signs is right. Words seen once can be right words of one text,
    so a variant without signs must also occur `least` times.
    """
    signs_in = lambda c: F.regexp_count(c, F.lit(f"[{SIGNS}]"))
    odd = F.col("word").rlike(f"[{SIGNS}]")
    # The table is a constant: each word meets only the confusions it can hold, by number in the order of the table.
    differences = words.sparkSession.range(1).select(*((_anagram(F.lit(r)) - _anagram(F.lit(w))).alias(f"d{i}") for i, (w, r) in enumerate(CONFUSIONS))).first()
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(r).alias("r"), F.lit(differences[i]).alias("d"), F.lit(max(len(w), len(r))).alias("reach"), F.lit(sum(c in SIGNS for c in w)).alias("signs"), F.lit(WEAK if (w, r) in RARER else 1).alias("weak")) for i, (w, r) in enumerate(CONFUSIONS)))
    rare = words.where((odd | ~F.col("titled")) & (F.length("word") >= 3) & F.col("word").rlike(r"^[\p{L}\p{M}]*[\p{L}0-9!|][\p{L}\p{M}0-9!|]*$")).select("word", F.col("n").alias("own"), odd.alias("odd"), signs_in("word").alias("signs"), _anagram(F.col("word")).alias("h"))
    one = rare.select("*", F.explode(F.filter(table, lambda c: F.contains(F.col("word"), c["w"]))).alias("a")).select("word", "own", "odd", "signs", (F.col("h") + F.col("a.d")).alias("h"), "a.i", "a.reach", F.col("a.signs").alias("by"), "a.weak")
    frequent = words.where(F.col("word").rlike(r"^[\p{L}\p{M}]{3,}$") & ~F.col("word").rlike(f"[{SIGNS[5:]}]") & (F.col("n") >= 2)).select(F.col("word").alias("fixed"), F.col("n"), _anagram(F.col("word")).alias("h"))
    enough = lambda steps, weak: F.when(F.col("odd"), F.col("n") >= F.col("own")).otherwise((F.col("n") >= least) & (F.col("n") >= ratio * F.col("own") * steps * weak))
    single = one.where(F.col("signs") <= F.col("by") + 1).join(frequent, "h").where(enough(1, F.col("weak")) & (F.levenshtein("word", "fixed") <= F.col("reach")))
    # Two confusions meet in the middle: one undone on the rare word, the other made on the frequent one. A second one is tried where
    # signs or length leave room for it.
    made = frequent.select("*", F.explode(F.filter(table, lambda c: F.contains(F.col("fixed"), c["r"]))).alias("b")).select("fixed", "n", (F.col("h") - F.col("b.d")).alias("h"), F.col("b.i").alias("bi"), F.col("b.w").alias("bw"), F.col("b.reach").alias("breach"), F.col("b.signs").alias("bby"), F.col("b.weak").alias("bweak"))
    room = (F.length("word") >= 5) & (F.col("odd") | (F.length("word") >= 7))
    double = one.where(room).join(made, "h").where((F.col("bi") >= F.col("i")) & F.contains("word", F.col("bw")) & (F.col("signs") <= F.col("by") + F.col("bby") + 1) & enough(2, F.col("weak") * F.col("bweak")) & (F.levenshtein("word", "fixed") <= F.col("reach") + F.col("breach")))
    met = single.select("word", "fixed", "n", F.lit(1).alias("steps")).unionByName(double.select("word", "fixed", "n", F.lit(2).alias("steps")))
    best = met.groupBy("word").agg(F.min_by(F.struct("fixed", "n"), F.struct("steps", F.expr("-n"), "fixed")).alias("b")).select("word", "b.fixed", "b.n")
    inner = r"^\p{L}{1,}(?:[015!|]\p{L}+){1,3}$|^[!|]\p{L}{3,}$|^\p{L}{3,}[|]$"
    guess = F.translate(F.translate("word", "0!5", "ois"), "1|", "ll")
    lone = words.where(F.col("word").rlike(inner) & (F.length("word") >= 4) & F.col("word").rlike(r"\p{L}{2}")).join(best.select("word"), "word", "left_anti").select("word", guess.alias("fixed"), F.lit(0).cast("bigint").alias("n"))
    signs = F.col("word")
    for wrong, right in CONFUSIONS[-7:]:
        signs = F.replace(signs, F.lit(wrong), F.lit(right))
    ligatures = words.where(F.col("word").rlike(f"[{SIGNS[5:]}]")).join(best.select("word"), "word", "left_anti").select("word", signs.alias("fixed"), F.lit(0).cast("bigint").alias("n"))
    return best.unionByName(lone).unionByName(ligatures)


#: Corrections that are broadcast at most; more of them are joined by a shuffle of counted words.
CORRECTIONS = 200_000


def misread(marked: DataFrame, counted: DataFrame, fixes: DataFrame) -> DataFrame:
    """(chunk_id, word, fixed, times) of every misread word of every chunk.

    A token meets the corrections of its words. Up to CORRECTIONS of them go to the texts; beyond it tokens are counted by chunk
    first, and those the corpus shows to be hot are spread.
    """
    by_token = cut(words_of(counted.select("token"), "token").join(fixes.select("word", "fixed"), "word").groupBy("token").agg(F.collect_list(F.struct("word", "fixed")).alias("x")))  # a token has few words
    each = marked.select("chunk_id", F.explode("tokens").alias("token"))
    if at_most(by_token, CORRECTIONS):
        met = each.join(F.broadcast(by_token), "token").withColumn("times", F.lit(1).cast("bigint"))
    else:
        met = skew_join(each.groupBy("chunk_id", "token").agg(F.count("*").alias("times")), by_token, "token", "chunk_id", hot=hot_counts(counted, "token", "n"))
    return met.select("chunk_id", "times", F.explode("x").alias("x")).groupBy("chunk_id", F.col("x.word").alias("word"), F.col("x.fixed").alias("fixed")).agg(F.sum("times").alias("times"))


def breaks(marked: DataFrame, counted: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, left, sign, right, joined): line-end breaks that are no compounds.

    Only a hyphen-minus or a non-breaking hyphen can belong to the word; it does if the corpus has the
    hyphenated word inside lines more often than the joined one.
    """
    found = marked.where(F.col("text").rlike(BROKEN)).select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(BREAK), F.lit(0)))).alias("m"))
    part = lambda i: F.regexp_extract("m", BREAK, i)
    cand = found.select("chunk_id", part(1).alias("left"), part(2).alias("sign"), part(3).alias("right")).withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("compound", F.lower(F.concat_ws("-", "left", "right")))
    inside = counted.where(F.col("token").rlike("[-‑]")).select("n", F.explode(F.regexp_extract_all("token", F.lit(r"(?<!\p{L})(?=(\p{L}+[-‑]\p{L}+))"), F.lit(1))).alias("c"))
    compounds = inside.groupBy(F.regexp_replace("c", "‑", "-").alias("compound")).agg(F.sum("n").alias("whole"))
    weighed = cand.join(words.select(F.col("word").alias("joined"), "n"), "joined", "left").join(compounds, "compound", "left")
    # the joined form was counted at this break too
    keep = F.col("sign").isin("-", "‑") & (F.coalesce("whole", F.lit(0)) > F.coalesce("n", F.lit(0)) - 1)
    return weighed.where(~keep | (F.coalesce("whole", F.lit(0)) == 0)).select("chunk_id", "left", "sign", "right", "joined")


def found_noise(chunks: DataFrame) -> DataFrame:
    """(chunk_id, kind): hyphenation, misread (two misread words or more), running_header, page_number."""
    marked = cut(marked_lines(chunks))  # read by every part below
    counted = cut(token_counts(marked))
    words = cut(vocabulary(counted))
    edges = marked.select("chunk_id", F.explode(F.array_compact(F.array(F.when(F.col("header"), F.lit("running_header")), F.when(F.col("number"), F.lit("page_number"))))).alias("kind"))
    broken = breaks(marked, counted, words).select("chunk_id", F.lit("hyphenation").alias("kind")).distinct()
    wrong = misread(marked, counted, corrections(words)).groupBy("chunk_id").agg(F.sum("times").alias("n")).where("n >= 2").select("chunk_id", F.lit("misread").alias("kind"))
    return edges.unionByName(broken).unionByName(wrong)


def _cased(word: str, like: str) -> str:
    """`word` in the case of what stood there: letter by letter where lengths agree, else by the first letter or all of them."""
    if like.isupper() and sum(c.isalpha() for c in like) > 1:
        return word.upper()
    if len(word) == len(like):
        return "".join(w.upper() if c.isupper() else w for w, c in zip(word, like))
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def restore(text: str, joins: set[tuple[str, str, str]], fixes: dict[str, str]) -> str:
    """The text with broken words joined and misread ones corrected: whole words only, and none in code, links, templates or formulas."""
    import regex

    mended = regex.sub(BREAK, lambda m: m[1] + m[3] if (m[1], m[2], m[3]) in joins else m[0], text) if joins else text
    if not fixes:
        return mended

    def one(m) -> str:
        token = m["word"]
        if token is None:
            return m[0]
        lead = regex.match(r"[0-9!|]+(?=[!|])", token)
        start = lead.end() if lead else 0
        tail = regex.search(r"(?<=\p{L}\p{L})!+$", token)
        end = tail.start() if tail else len(token)
        core = token[start:end]
        fixed = fixes.get(core.lower())
        return m[0] if fixed is None else token[:start] + _cased(fixed, core) + token[end:]

    return regex.sub(rf"(?:{ASIDE[4:]})|(?P<word>[{IN_WORD}]+)", one, mended, flags=regex.S)


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, body): continuous paragraphs without edge lines, with broken and misread words restored.

    Lines of a paragraph are joined by a space (by nothing between CJK characters) where the chunk shows noise or hard wraps;
    blocks of markup (tables, lists, code, formulas) keep their lines. Only texts with words to restore leave the JVM.
    """
    marked = cut(marked_lines(chunks))  # read by every part below
    counted = cut(token_counts(marked))
    words = cut(vocabulary(counted))
    fixes = misread(marked, counted, corrections(words)).groupBy("chunk_id").agg(F.collect_list(F.struct("word", "fixed")).alias("fixes"))
    joins = breaks(marked, counted, words).groupBy("chunk_id").agg(F.collect_list(F.struct("left", "sign", "right")).alias("joins"))
    todo = joins.join(fixes, "chunk_id", "full_outer")

    @F.pandas_udf("string")
    def mended(texts: pd.Series, breaks: pd.Series, words: pd.Series) -> pd.Series:
        sets = lambda x: [] if x is None else x
        return pd.Series([restore(t, {(j["left"], j["sign"], j["right"]) for j in sets(b)}, {f["word"]: f["fixed"] for f in sets(w)}) for t, b, w in zip(texts, breaks, words)], dtype=object)

    texts = marked.select("chunk_id", "text")
    both = cut(texts.join(todo, "chunk_id", "left"))
    needy = F.col("joins").isNotNull() | F.col("fixes").isNotNull()
    whole = both.where(~needy).select("chunk_id", F.col("text").alias("flow"), "text").unionByName(both.where(needy).select("chunk_id", mended("text", "joins", "fixes").alias("flow"), "text"))
    flow = F.col("flow")
    kept = r"(?m)^\s*(?:[|!{<>#\\*+$`=-]|\d+[.)]\s)|```"
    joined_cjk = F.regexp_replace(flow, r"(?<=[一-鿿,。，、；：!？])[ \t]*\n(?=[一-鿿,。，、；：])", "")
    body = F.when(F.col("text").rlike(kept), flow).otherwise(F.regexp_replace(F.regexp_replace(joined_cjk, r"[-‐‑][ \t]?\n(?=\p{L})", "-"), r"(?<!\n)[ \t]*\n(?!\n)[ \t]*", " "))
    return whole.select("chunk_id", body.alias("body"))
