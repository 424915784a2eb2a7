"""Text decoded with the wrong character encoding: finding it and restoring it (problem 10).

A noisy channel: some spans of a text went through a channel (bytes of one encoding read as another). Channels are undone
on byte lattices, where lost bytes are wildcards; the readings are weighed by the frequency of their words in the corpus, and
a Viterbi search over each text decides which spans went through which channel.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_counts, skew_join
from ..session import at_most, cut

# Fixed values: (encoding the bytes were in, encoding they were read as), single confusions.
CHANNELS = [("utf-8", w) for w in ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "gb18030", "koi8_r", "cp866", "mac_cyrillic", "big5", "shift_jis")]
CHANNELS += [("cp1252", w) for w in ("cp437", "mac_roman", "cp1250", "cp1251", "cp850")] + [("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252")]
CHANNELS += [("cp1251", w) for w in ("cp1252", "latin-1", "koi8_r", "cp866", "mac_roman")] + [("koi8_r", w) for w in ("cp1251", "cp1252", "latin-1")] + [("cp866", "cp1251"), ("cp866", "cp1252")]
CHANNELS += [("gb18030", w) for w in ("cp1252", "latin-1", "cp1251", "mac_roman")]
WIDE = {"gb18030", "big5", "shift_jis"}
LOST = "�"
#: Nats: what entering a channel costs, what each well-formed UTF-8 sequence speaks for it, and what a sound span inside costs.
ENTER, SEQUENCE, SOUND = 2.3, 3.0, 2.0
#: Share of the weight of all characters that fit partly lost bytes from which the likeliest is taken.
SURE = 0.6
#: What is seen less often may itself be garbled.
KNOWN = 3
#: Distinct spans with a second reading that are broadcast at most; more of them are joined by a shuffle of all spans.
OFFERS = 200_000
#: Words that speak for a reading of one span at most.
MOST = 4
UNIT = r"[㐀-鿿]|[\p{L}\p{M}&&[^㐀-鿿]]+|[^\x00-\x7f]"
SPACE = r"[ \t\r\n]+"


@lru_cache(maxsize=None)
def _table(codec: str) -> dict[str, int]:
    """Characters of a one-byte encoding; bytes without a character, and C1 controls, stand for themselves."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def to_bytes(text: str, wrong: str) -> list[int] | None:
    """The bytes behind a text that was read as `wrong`; a lost character is the wildcard -1. None if there are none."""
    if wrong in WIDE or wrong == "utf-8":
        out: list[int] = []
        for ch in text:
            if ch == LOST:
                out.append(-1)
                continue
            try:
                out.extend(ch.encode(wrong))
            except UnicodeEncodeError:
                return None
        return out
    table = _table(wrong)
    try:
        return [table[ch] if ch != LOST else -1 for ch in text]
    except KeyError:
        return None


class Lattice:
    """Viterbi decoding of bytes with wildcards into the likeliest characters of an encoding."""

    def __init__(self, weights: dict[str, float]):
        self.w = weights
        self.floor = min(weights.values(), default=-20.0) - 2
        self._index: dict[str, dict[tuple[int, ...], tuple[float, str]]] = {}

    def _best(self, codec: str, seq: tuple[int, ...]) -> tuple[float, str] | None:
        """The likeliest character of these bytes, wildcards matching any byte; LOST if it doesn't outweigh all others together."""
        if codec not in self._index:
            index: dict[tuple[int, ...], tuple[float, str]] = {}
            mass: dict[tuple[int, ...], float] = {}
            for ch, w in self.w.items():
                try:
                    b = tuple(ch.encode(codec))
                except UnicodeEncodeError:
                    continue
                if not 2 <= len(b) <= 3:
                    continue
                wild = codec == "utf-8" or "一" <= ch <= "鿿"  # what a wildcard may stand for in running text
                for mask in range(1 << len(b) if wild else 1):
                    key = tuple(-1 if mask >> i & 1 else x for i, x in enumerate(b))
                    mass[key] = mass.get(key, 0.0) + exp(w)
                    if key not in index or index[key][0] < w:
                        index[key] = (w, ch)
            self._index[codec] = {k: (log(mass[k]), v[1] if exp(v[0]) >= SURE * mass[k] else LOST) for k, v in index.items()}
        return self._index[codec].get(seq)

    def decode(self, data: list[int], codec: str) -> tuple[str, float, int] | None:
        """(text, log weight, well-formed sequences without a lost byte) of the best path; exact decoding where nothing is lost."""
        if -1 not in data:
            try:
                text = bytes(data).decode(codec)
            except (UnicodeDecodeError, ValueError):
                return None
            odd = [c for c in text if c > "\x7f"]
            return text, sum(self.w.get(c, self.floor) for c in odd), len(odd)
        n = len(data)
        best: list[tuple[float, int, str, int] | None] = [None] * (n + 1)
        best[0] = (0.0, 0, "", 0)
        for i in range(n):
            if best[i] is None:
                continue
            score, _, _, seqs = best[i]
            steps = []
            if data[i] != -1 and data[i] < 0x80:
                steps.append((1, 0.0, chr(data[i]), 0))
            for width in (2, 3) if codec == "utf-8" else (2,):
                part = tuple(data[i : i + width])
                if len(part) == width and (hit := self._best(codec, part)):
                    steps.append((width, hit[0] - 1.5 * part.count(-1), hit[1], int(-1 not in part)))
            if data[i] == -1:
                steps.append((1, self.floor - 2, LOST, 0))
            for width, w, ch, s in steps:
                if best[i + width] is None or best[i + width][0] < score + w:
                    best[i + width] = (score + w, i, ch, seqs + s)
        if best[n] is None:
            return None
        out, at = [], n
        while at:
            _, prev, ch, _ = best[at]
            out.append(ch)
            at = prev
        return "".join(reversed(out)), best[n][0], best[n][3]


def readings(span: str, lattice: Lattice) -> list[tuple[str, str, float]]:
    """(channel, text, bonus) of every way to undo a channel on a span, at most one a channel.

    A well-formed UTF-8 sequence hardly comes by chance, which the bonus holds. A reading needs characters the corpus knows; how
    frequent they are drops none, since its words are weighed later.
    """
    seen: dict[str, tuple[str, float]] = {}

    def consider(text: str, channel: str, bonus: float) -> None:
        if text != span and text not in seen and not any("\x00" < c < " " or "\x80" <= c < "\xa0" for c in text):
            seen[text] = (channel, bonus)

    lost = LOST in span
    for true, wrong in CHANNELS:
        if lost and true != "utf-8":
            continue
        data = to_bytes(span, wrong)
        got = data and lattice.decode(data, true)
        if not got:
            continue
        text, _, seqs = got
        if lost and wrong not in WIDE and not seqs:  # lost bytes alone fit anything
            continue
        known = all(c in lattice.w for c in text if c > "\x7f" and c != LOST)
        bonus = SEQUENCE * min(seqs, 4) if true == "utf-8" and known and not (wrong in WIDE and lost) else 0.0
        if known:
            consider(text, f"{true}<{wrong}", bonus)
        if true == "utf-8" and wrong in ("cp1252", "latin-1"):
            for again in ("cp1252", "latin-1"):  # the same mistake made twice
                second = to_bytes(text, again)
                got2 = second and lattice.decode(second, true)
                if got2 and got2[0] != text and all(c in lattice.w for c in got2[0] if c > "\x7f"):
                    consider(got2[0], f"{true}<{again}<{wrong}", bonus + SEQUENCE * min(got2[2], 4))
    if lost:
        data = to_bytes(span, "utf-8")
        got = data and lattice.decode(data, "gb18030")
        if got and sum("一" <= c <= "鿿" for c in got[0]) >= max(2, got[0].count(LOST)):
            consider(got[0], "gb18030<utf-8", 0.0)
    return [(c, t, b) for t, (c, b) in seen.items()]


def decide(spans: list[tuple[int, list[tuple[str, str, float]]]]) -> list[tuple[int, str, str]]:
    """Viterbi over the spans of one text: (number, channel, reading) of the spans that went through a channel.

    spans: (number among the text's spans, readings as (channel, text, gain)), those without readings left out: they are sound, and
    what they cost a channel that goes on past them follows from the numbers. States are 'sound' and the channels at hand.
    """
    states = ["", *sorted({c for _, r in spans for c, _, _ in r})]
    score = {s: 0.0 if not s else -ENTER for s in states}
    back: list[dict[str, str]] = []
    last = spans[0][0] - 1 if spans else 0
    for at, options in spans:
        gain = {c: g for c, _, g in options}
        passed = (at - last - 1) * SOUND  # to stay in a channel over sound spans; to leave it is free
        last = at
        cost = lambda p, s, passed=passed: 0.0 if not s else min(passed, ENTER) if p == s else ENTER
        came = {s: max(states, key=lambda p: (score[p] - cost(p, s), p == s)) for s in states}
        score = {s: score[came[s]] - cost(came[s], s) + (gain.get(s, -SOUND) if s else 0.0) for s in states}
        back.append(came)
    state = max(states, key=lambda s: (score[s], s == ""))
    out = []
    for (at, options), came in zip(reversed(spans), reversed(back)):
        if state:
            out.extend((at, c, t) for c, t, g in options if c == state)
        state = came[state]
    return out[::-1]


def token_counts(documents: DataFrame, text: str) -> DataFrame:
    """(token, n): how often every stretch between blanks occurs in all texts. The only pass over all texts; what follows works on distinct tokens."""
    return documents.select(F.explode(F.split(F.col(text), SPACE)).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def unit_counts(counted: DataFrame) -> DataFrame:
    """(unit, n): occurrences of every word, ideograph and non-ASCII sign, of counted tokens; no unit holds a blank."""
    return counted.select("n", F.explode(F.regexp_extract_all(F.lower("token"), F.lit(UNIT), F.lit(0))).alias("unit")).groupBy("unit").agg(F.sum("n").alias("n"))


def character_weights(units: DataFrame) -> dict[str, float]:
    """Log shares of non-ASCII characters, in both cases: at most as many as Unicode has. One counts as known if it is seen KNOWN times."""
    rows = units.where(F.col("unit").rlike(r"[^\x00-\x7f]")).select("n", F.explode(F.array_distinct(F.split("unit", ""))).alias("c")).where(F.col("c") > "\x7f").groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") >= KNOWN).collect()
    total = sum(r["n"] for r in rows) or 1
    out: dict[str, float] = {}
    for r in rows:
        for ch in {r["c"], r["c"].upper()}:
            if len(ch) == 1 and ch != LOST:
                out[ch] = max(out.get(ch, -99.0), log(r["n"] / total))
    return out


ODD = r"[^\x00-\x7f]"


def spans_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, span): stretches between blanks that hold a non-ASCII character, by their number among those of the text."""
    return documents.where(F.col(text).rlike(ODD)).select(key, F.posexplode(F.filter(F.split(F.col(text), SPACE), lambda x: x.rlike(ODD))).alias("pos", "span"))


def weighed_readings(counted: DataFrame, units: DataFrame) -> DataFrame:
    """(span, options array<struct<channel, text, gain>>): readings of each distinct span that its words speak for.

    Two measures compare log-frequencies: of the rarest word, and the mean of words with a non-ASCII character (times
    the reading's words, MOST at most). A wrong reading glues words together or cuts them, which one of the two shows. Readings
    with a bonus gain by the better measure; between one-byte encodings, where any byte is well formed, both must speak
    for the reading, every word must be known and the rarest be twice as frequent. Words the corpus lacks count as a tenth.
    """
    spark = counted.sparkSession
    shared = spark.sparkContext.broadcast(character_weights(units))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(shared.value)
        for pdf in batches:
            rows = []
            for span in pdf["span"]:
                got = readings(span, lattice)
                if got:
                    rows.append((span, "", span, 0.0))
                    rows.extend((span, c, t, b) for c, t, b in got)
            yield pd.DataFrame(rows, columns=["span", "channel", "text", "bonus"])

    offered = cut(counted.select("span").mapInPandas(read, "span string, channel string, text string, bonus double"))  # spans with a second reading only
    parts = offered.select("span", "channel", "text", "bonus", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(UNIT), F.lit(0))).alias("unit"))
    ln = F.ln(F.coalesce(F.col("n").cast("double"), F.lit(0.1)))
    odd = F.col("unit").rlike(r"[^\x00-\x7f]")
    weighed = skew_join(parts, units, "unit", "span", "left", hot=hot_counts(units, "unit", "n")).groupBy("span", "channel", "text", "bonus").agg(F.coalesce(F.avg(F.when(odd, ln)), F.lit(0.0)).alias("mean"), F.count_if(odd).alias("words"), F.min(ln).alias("least"), F.min(F.coalesce("n", F.lit(0))).alias("rarest"))
    by_span = weighed.groupBy("span").agg(F.max(F.when(F.col("channel") == "", F.struct("mean", "least"))).alias("own"), F.collect_list(F.when(F.col("channel") != "", F.struct("channel", "text", "bonus", "mean", "words", "least", "rarest"))).alias("all"))
    by_mean = lambda x: (x["mean"] - F.col("own.mean")) * F.least(F.lit(MOST), x["words"])
    by_least = lambda x: x["least"] - F.col("own.least")
    wide = lambda x: x["channel"].startswith("gb18030<")
    gain = lambda x: F.when(x["bonus"] > 0, F.greatest(by_mean(x), by_least(x)) + x["bonus"]).when(wide(x), by_mean(x)).otherwise(F.least(by_mean(x), by_least(x)))
    keep = lambda x: (gain(x) > 0) & ((x["bonus"] > 0) | wide(x) | ((x["rarest"] >= 2) & (by_least(x) > 0.69)))
    options = F.transform(F.filter("all", keep), lambda x: F.struct(x["channel"].alias("channel"), x["text"].alias("text"), gain(x).alias("gain")))
    return by_span.select("span", options.alias("options")).where(F.size("options") > 0)


def _skeleton(c: str):
    bare = F.regexp_replace(c, r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$", "")
    return bare, F.lower(F.regexp_replace(bare, r"[^\x00-\x7f]", "*"))


def lost_words(counted: DataFrame) -> DataFrame:
    """(span, text): spans with lost bytes and the sound span that fits them, each lost byte one character, if it outweighs all others that fit together.

    Sound spans are merged by their skeleton (non-ASCII characters as wildcards) before the join, one row each.
    """
    bare, key = _skeleton("span")
    keyed = counted.withColumn("bare", bare).withColumn("key", key)
    sound = keyed.where(~F.contains("span", F.lit(LOST)) ).groupBy("key").agg(F.max_by("bare", F.struct("n", "bare")).alias("fit"), F.max("n").alias("n"), F.sum("n").alias("all")).where((F.col("n") >= 2) & (F.col("n") >= SURE * F.col("all")))
    gone = keyed.where(F.contains("span", F.lit(LOST)) & ~F.col("bare").rlike(rf"[^\x00-\x7f{LOST}]") & (F.length(F.regexp_replace("bare", LOST, "")) + 2 >= F.length(F.regexp_replace("bare", f"[^{LOST}]", ""))))
    return gone.join(sound.select("key", "fit"), "key").select("span", F.replace("span", "bare", "fit").alias("text"))


def damaged(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, edits array<struct<pos, channel, text>>, lost): texts with garbled or lost characters.

    `edits` are the spans (by their number among the text's spans) with their restored form; `lost` tells that characters are
    gone (U+FFFD); for those the edits hold the likeliest reading, if any. Null and empty texts, and rows without a key, give
    no row; rows of one key and text count once.
    """
    docs = documents.where(F.col(key).isNotNull()).select(key, text)
    tokens = cut(token_counts(docs, text))
    units = cut(unit_counts(tokens))
    counted = cut(tokens.where(F.col("token").rlike(ODD)).select(F.col("token").alias("span"), "n"))  # distinct spans, each read once
    options = weighed_readings(counted, units)
    fits = lost_words(counted)
    none = F.array().cast("array<struct<channel:string,text:string,gain:double>>")
    lost = counted.where(F.contains("span", F.lit(LOST))).select("span", F.lit(True).alias("lost"))
    met = options.join(fits, "span", "full_outer").join(lost, "span", "full_outer")
    offers = cut(met.select("span", F.coalesce("lost", F.lit(False)).alias("lost"), F.concat(F.coalesce("options", none), F.when(F.col("text").isNotNull(), F.array(F.struct(F.lit("lost").alias("channel"), "text", F.lit(9.0).alias("gain")))).otherwise(none)).alias("options")))
    spans = spans_of(docs, key, text)
    # only spans that have a second reading or a lost character are looked for; the others are sound
    odd = spans.join(F.broadcast(offers), "span") if at_most(offers, OFFERS) else skew_join(spans, offers, "span", key, hot=hot_counts(counted, "span", "n"))
    listed = odd.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("pos", "options"))).alias("spans"), F.max("lost").alias("lost"))

    @F.pandas_udf("array<struct<pos:int,channel:string,text:string>>")
    def search(column: pd.Series) -> pd.Series:
        def one(spans) -> list[dict]:
            told = [(s["pos"], [(o["channel"], o["text"], o["gain"]) for o in s["options"]]) for s in spans]
            return [{"pos": p, "channel": c, "text": t} for p, c, t in decide(told)]

        return column.map(one)

    return listed.select(key, search("spans").alias("edits"), "lost").where((F.size("edits") > 0) | F.col("lost"))


def restored(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, channels, lost): damaged texts with every span restored that can be; blanks stay as they were."""
    found = damaged(documents, key, text)

    @F.pandas_udf("string")
    def apply(texts: pd.Series, edits: pd.Series) -> pd.Series:
        import re

        cutter = re.compile(rf"({SPACE})")

        def one(t: str, todo) -> str:
            parts = cutter.split(t)
            spans = [i for i in range(0, len(parts), 2) if not parts[i].isascii()]
            for e in todo:
                parts[spans[e["pos"]]] = e["text"]
            return "".join(parts)

        return pd.Series([one(t, e) for t, e in zip(texts, edits)])

    both = documents.where(F.col(key).isNotNull()).select(key, text).distinct().join(found, key)
    return both.select(key, apply(text, "edits").alias("text"), F.array_sort(F.array_distinct(F.transform("edits", lambda e: e["channel"]))).alias("channels"), "lost")
