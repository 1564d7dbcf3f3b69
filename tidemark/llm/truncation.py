"""Problem 8: texts cut off by a limit of their source or in transfer.

Two sources of evidence:

* Discrete hazards of text length, h(L) = texts of length L / texts of at least length L,
  by window functions per source and for lengths counted in characters, in bytes and in UTF-16
  units. Each is tested against the pooled hazard of its neighbours, with the dispersion that these show;
  with the false-discovery rate controlled over all tests, lengths that are significant and at least
  ``RATIO`` times as frequent as their neighbours are the limits at which a source cuts.
* Endings. All texts together teach which word contexts end a sentence and which
  go on: counts of (last three words), (last two), (last one) before a full stop and before a
  further word, with numbers and percent signs mapped to one word each.

At a significant length a text with an incomplete ending was cut (kind ``limit``). A text cut in transfer lies at
no limit, so hazards can't show it; it is flagged (kind ``transfer``) only if the corpus says that its ending goes on: the
context never ends a sentence, or its last "word" is only the beginning of a word that the context knows.

Hazards and contexts count different texts, not deliveries, and every threshold is a share with a fixed
smoothing, so the verdict on a text doesn't change when the corpus is delivered again.
Counts are made in each batch before the shuffle. Only contexts in which unfinished texts end, and words of which their last
word may be the beginning, are aggregated and joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import materialize

NEAR, GAP = 10, 2  # the farthest and nearest later lengths that give the expected hazard; the earlier ones follow from SOFT
SOFT = 12  # a source that cuts between words ends its texts within so many units before the limit
FALSE_DISCOVERY = 0.01
RATIO = 5.0  # a limit is at least so many times as frequent as its neighbours, a zone before a soft limit SOFT_RATIO times
SOFT_RATIO = 3.0
BINS, FINEST = 50, 15_000  # p values are ranked by bins of a fiftieth of a power of ten
#: A context that ends a sentence in at most this share (smoothed) goes on.
ENDS = 0.03
SALTS = 16
TAIL = 200  # characters in which the signs of an ending lie

_TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|%|[^\W\d_]+(?:['’\-][^\W\d_]+)*|[.!?…]+|[^\w\s]")
_MARK = re.compile(r"\s*(?:\[\s*(?:more|\.\.\.|…|mehr|más|continued|truncated)\s*\]|\(\s*(?:cont(?:inued|\.)?|more|Forts\.|sigue)\s*\)|(?:read|see) more)\s*$", re.I)
_DOTS = re.compile(r"\s*(?:…|\.{3,})\s*$")
_END = re.compile(r"[.!?。！？][\"'”’»)\]*_~\s]*$")
#: Ends of complete texts that are no sentences: links, tags, code, brackets, smileys.
_STRUCTURE = re.compile(r"(?:https?://\S+|www\.\S+|[#@]\w+|```|[)\]}>»”\"']|[:;]-?[)(DP/|]|[\U0001F300-\U0001FAFF☀-➿])\s*$")
_NUMBER_STOP = re.compile(r"\d\.\s*$")
_SIGNED = re.compile(r"(?:^|[.!?…)\n]\s*)(?:signed|regards|gez|saludos|--|—)\b[^.!?\n]{0,60}$", re.I)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of all words of some texts in order: number of the text, number of the word, what follows, and the words by number.

    What follows is 1 for the end of a sentence, 0 for a further word, -1 for neither.
    """
    found = [_TOKEN.findall(t.casefold()) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    code, vocabulary = pd.factorize(np.array([t for f in found for t in f], dtype=object))
    word = np.empty(len(vocabulary), dtype=np.int64)  # number of the word, or of a mark: -2 ends a sentence, -9 says nothing, -3 any other
    names: dict[str, int] = {}
    for i, tok in enumerate(vocabulary):
        c = tok[0]
        name = "0" if c.isdigit() else "percent" if c == "%" else tok if c.isalpha() else None
        word[i] = names.setdefault(name, len(names)) if name is not None else -2 if c in ".!?…" else -9 if c in ",-'’" else -3
    w = word[code] if len(code) else np.empty(0, dtype=np.int64)
    is_word = w >= 0
    at = np.cumsum(is_word) - 1  # the word before each mark
    after = np.zeros(int(is_word.sum()), dtype=np.int64)
    own = doc[is_word]
    mark = ~is_word & (w != -9) & (at >= 0)
    mark[mark] = own[at[mark]] == doc[mark]
    after[at[mark]] = np.where(w[mark] == -2, 1, -1)  # the last mark counts
    last = np.flatnonzero(np.diff(own, append=-1) != 0)
    after[last] = np.where(after[last] == 1, 1, -1)
    return own, w[is_word], after, list(names)


def contexts(text: str) -> tuple[list[str], list[int]]:
    """Normalised words, and for each what follows: 1 the end of a sentence, 0 a further word, -1 neither."""
    _, word, after, names = _tokens([text])
    return [names[i] for i in word], after.tolist()


def ending(text: str) -> str:
    """How a text ends: sentence, marked (omission stated), dots, structure, comma or open.

    All signs of an ending are short, but for a link, which is the last word: no more is looked at than these.
    """
    text = text.rstrip()
    if len(text) > TAIL:
        text = text[min(len(text) - TAIL, len(text) - len(text.rsplit(None, 1)[-1])) :]
    if _MARK.search(text):
        return "marked"
    if _DOTS.search(text):
        return "dots"
    if _END.search(text):
        return "sentence"
    if _STRUCTURE.search(text) or _SIGNED.search(text[-100:]):
        return "structure"
    if text.rstrip()[-1:] in (",", ";", "-", "–", "("):
        return "comma"
    return "open"


_FIELDS = [T.StructField(n, T.StringType() if n in ("source", "how", "a", "b", "c") else T.DoubleType() if n in ("ends", "goes", "weight") else T.LongType()) for n in ("source", "chars", "bytes", "utf16", "how", "a", "b", "c", "ends", "goes", "weight")]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text, and the counts of the contexts, in which a text weighs as much as it counts."""
    for pdf in batches:
        texts, weight = pdf["_text"].tolist(), pdf["_weight"].to_numpy(dtype=float)
        own, word, after, names = _tokens(texts)
        how = [ending(t) for t in texts]
        start = np.searchsorted(own, np.arange(len(texts) + 1))
        for i in np.flatnonzero(np.diff(start)):
            if how[i] != "sentence":
                after[start[i + 1] - 1] = -1
        none = len(names)  # no word before
        names = [*names, ""]
        place = np.arange(len(word)) - start[own] if len(word) else np.empty(0, dtype=np.int64)
        b = np.where(place >= 1, np.roll(word, 1), none)
        a = np.where(place >= 2, np.roll(word, 2), none)
        use = (after >= 0) & (weight[own] > 0)
        abc = np.stack([a[use], b[use], word[use]], axis=1)
        packed = (abc[:, 0] * len(names) + abc[:, 1]) * len(names) + abc[:, 2]
        values, at = np.unique(packed, return_inverse=True)
        ends = np.bincount(at, weights=after[use] * weight[own[use]], minlength=len(values))
        seen = np.bincount(at, weights=weight[own[use]], minlength=len(values))
        lookup = np.array(names, dtype=object)
        n, m = len(texts), len(values)
        body = np.full((n, 3), "", dtype=object)
        for i in range(n):
            if how[i] in ("marked", "dots"):
                tail = contexts(_DOTS.sub("", _MARK.sub("", texts[i][-2000:])))[0][-3:]
            else:
                tail = [names[j] for j in word[max(start[i], start[i + 1] - 3) : start[i + 1]]]
            if tail:
                body[i, 3 - len(tail) :] = tail
            if how[i] == "sentence" and _NUMBER_STOP.search(texts[i][-40:]):
                how[i] = "number"
        blank = [None] * m
        out = {"key": [*pdf["_key"], *blank], "source": [*pdf["_source"], *blank], "chars": [*map(len, texts), *blank],
               "bytes": [*(len(t.encode("utf-8", "surrogatepass")) for t in texts), *blank], "utf16": [*(len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts), *blank], "how": [*how, *blank]}
        for i, (name, v) in enumerate((("a", values // len(names) ** 2), ("b", values // len(names) % len(names)), ("c", values % len(names)))):
            out[name] = [*body[:, i], *lookup[v]]
        out |= {"ends": [*[None] * n, *ends.tolist()], "goes": [*[None] * n, *(seen - ends).tolist()], "weight": [*weight.tolist(), *blank]}
        yield pd.DataFrame(out, dtype=object)


def significant_lengths(texts: DataFrame) -> DataFrame:
    """``source, unit, length, n, expected, dispersion, p, soft``: the lengths at which a source ends texts far more often than at their neighbours.

    Rows have source, chars, bytes, utf16 and the weight with which they count. soft: the lengths just before it are raised as well, as the source
    cuts between words. Windows run over the lengths of a source, of which there are at most as many as its longest text has units.
    """
    long = texts.filter("weight > 0").select("source", "weight", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes", "utf16")])).alias("x")).select("source", "weight", "x.*")
    counts = long.groupBy("source", "unit", "length").agg(F.round(F.sum("weight"), 6).alias("n"))
    whole = Window.partitionBy("source", "unit")
    by = whole.orderBy("length")
    at = counts.withColumn("risk", F.sum("n").over(whole.orderBy(F.desc("length"))))

    def ended(lo: int, hi: int) -> Column:
        return F.coalesce(F.sum("n").over(by.rangeBetween(lo, hi)), F.lit(0))

    def at_least(shift: int) -> Column:
        """Texts at least as long as this length and a shift: from bounded sums."""
        if shift < 0:
            return F.col("risk") + ended(shift, -1)
        return F.col("risk") - ended(0, shift - 1) if shift else F.col("risk")

    def exposed(lo: int, hi: int) -> Column:
        """Texts at risk, summed over lengths from lo to hi relative to this one."""
        return (hi - lo + 1) * (at_least(lo) + at_least(hi + 1)) / 2

    # neighbours: lengths before any zone that cutting between words raises, and lengths after
    lo, hi = -4 * SOFT, -SOFT - 1
    earlier = (ended(lo, hi) + 1.0) / F.greatest(exposed(lo, hi), F.lit(1.0))
    later = (ended(GAP, NEAR) + 1.0) / (exposed(GAP, NEAR) + 1 / earlier)
    cells = hi - lo + 1 + NEAR - GAP + 1
    squares = sum((F.coalesce(F.sum(F.col("n") * F.col("n")).over(by.rangeBetween(*r)), F.lit(0)) for r in ((lo, hi), (GAP, NEAR))), F.lit(0.0)) / cells
    mean = (ended(lo, hi) + ended(GAP, NEAR)) / cells
    dispersion = F.greatest(F.lit(1.0), (squares - mean * mean) / F.greatest(mean, F.lit(1e-9)))  # at least Poisson's
    tested = (at.withColumn("expected", F.col("risk") * F.greatest(earlier, later)).withColumn("dispersion", dispersion)
              # the zone leaves out the length just before, where a trimmed blank puts a text
              .withColumn("zone_n", ended(-SOFT, -2)).withColumn("zone_expected", exposed(-SOFT, -2) * earlier))

    def tail(n: Column, mu: Column) -> Column:
        """Upper tail of an overdispersed Poisson distribution, by Chernoff's bound: never below the exact one."""
        n, mu = n.cast("double"), F.greatest(mu, F.lit(1e-9))
        return F.when(n > mu, F.exp((n - mu - n * F.log(n / mu)) / F.col("dispersion"))).otherwise(F.lit(1.0))

    tested = materialize(tested.withColumn("p", tail(F.col("n"), F.col("expected"))).withColumn("zone_p", tail(F.col("zone_n"), F.col("zone_expected"))), "hazards")
    # Benjamini-Hochberg over all tests: ranks by bins of p, each of which counts as its upper edge, so the order is over a bounded number of rows
    level = F.when(F.col("p") > 0, F.least(F.floor(-F.log10("p") * BINS), F.lit(FINEST))).otherwise(F.lit(FINEST))
    bins = tested.groupBy(level.alias("bin")).agg(F.count("*").alias("k"))
    running = bins.withColumn("rank", F.sum("k").over(Window.orderBy(F.desc("bin")))).withColumn("all", F.sum("k").over(Window.partitionBy()))
    edge = F.pow(F.lit(10.0), -F.col("bin") / BINS)
    limit = running.filter(edge <= F.col("rank") / F.col("all") * FALSE_DISCOVERY).agg(F.max(edge).alias("limit"))
    found = tested.join(F.broadcast(limit), F.col("p") <= F.col("limit")).filter(F.col("n") >= RATIO * F.col("expected"))  # limit: one row
    soft = (F.col("zone_p") <= F.col("limit")) & (F.col("zone_n") >= SOFT_RATIO * F.col("zone_expected"))
    return found.select("source", "unit", "length", "n", "expected", "dispersion", "p", soft.alias("soft"))


def _weighed(src: DataFrame) -> DataFrame:
    """Add ``_weight``: 1 for the first row (by key) of each text of a source and 0 for its repeats; rows alike in key and text share their 1.

    Only hashes and keys are shuffled, and texts only if the repeats are too many to be sent to them.
    """
    src = src.withColumn("_h", F.xxhash64("_source", "_text"))
    hashed = src.select("_key", "_h").groupBy("_h", "_key").agg(F.count("*").alias("_m"))
    many = hashed.groupBy("_h").agg(F.sum("_m").alias("_n"), F.min(F.struct("_key", "_m")).alias("_x")).filter("_n > 1")
    many = many.select("_h", F.col("_x._key").alias("_least"), F.col("_x._m").alias("_same"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = hashed.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    repeats = salted.join(many, ["_h", "_salt"]).select("_h", "_key", F.when(F.col("_key") == F.col("_least"), 1.0 / F.col("_same")).otherwise(0.0).alias("_w"))
    return src.join(repeats, ["_h", "_key"], "left").withColumn("_weight", F.coalesce("_w", F.lit(1.0))).drop("_w", "_h")


def truncated(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``key, source, how, at_limit, goes_on, is_cut, kind`` of each text that isn't null or empty.

    how: what the text ends in (see ``ending``; ``number`` is a full stop after a digit). at_limit: its length is
    one of its source's significant lengths. goes_on: whether the corpus says that the ending goes on (null: it says
    nothing). kind: ``limit`` or ``transfer`` of a cut text. Repeated texts are judged alike and count once; rows with a null
    key are judged, and each counts; a null source is a source; an empty table gives an empty result.
    """
    src = df.select(F.col(key).alias("_key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    kind = src.schema["_key"].dataType
    seen = materialize(_weighed(src).mapInPandas(_scan, T.StructType([T.StructField("key", kind), *_FIELDS])), "endings")
    texts = seen.filter("how is not null").drop("ends", "goes")
    words = seen.filter("ends is not null")

    hard = significant_lengths(texts).select("source", "unit", "length", "soft")
    limits = materialize(hard.select("source", "unit", F.explode(F.sequence(F.col("length") - F.when(F.col("soft"), SOFT).otherwise(1), F.col("length"))).alias("length")).distinct(), "limits")
    unsure = materialize(texts.filter("how <> 'sentence' and how <> 'structure'").select("a", "b", "c").distinct(), "unsure")

    counts = materialize(words.join(unsure.select("c").distinct(), "c", "left_semi").groupBy("a", "b", "c").agg(F.round(F.sum("ends"), 6).alias("e"), F.round(F.sum(F.col("ends") + F.col("goes")), 6).alias("n")), "contexts")

    def level(keys: list[str], tag: str) -> DataFrame:
        return counts.join(unsure.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.sum("e").alias(f"e{tag}"), F.sum("n").alias(f"n{tag}"))

    # words of which a last word may be the beginning, after the word before it
    starts = F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substr(w, 1, i))"))
    beginnings = unsure.select("b", "c").distinct()
    begun = (words.filter("length(c) > 1").join(unsure.select("b").distinct(), "b", "left_semi").groupBy("a", "b", F.col("c").alias("w")).agg(F.round(F.sum(F.col("ends") + F.col("goes")), 6).alias("n"))
             .select("a", "b", "n", starts.alias("c")).join(beginnings, ["b", "c"], "left_semi").groupBy("a", "b", "c").agg(F.sum("n").alias("l")))
    begun = materialize(begun, "beginnings")

    known = unsure
    for keys, tag in ((["a", "b", "c"], "3"), (["b", "c"], "2"), (["c"], "1")):
        known = known.join(level(keys, tag), keys, "left")
    known = known.join(begun.withColumnRenamed("l", "l3"), ["a", "b", "c"], "left").join(begun.groupBy("b", "c").agg(F.sum("l").alias("l2")), ["b", "c"], "left")
    finals = texts.filter("how = 'open'").groupBy("c").agg(F.round(F.sum("weight"), 6).alias("f1"))  # habits: a last word of many texts
    known = known.join(finals, "c", "left").na.fill(0)
    goes_on = F.expr(f"""CASE WHEN c = '' THEN null
        WHEN (n3 + 0.5) / (n3 + l3 + 1) <= 0.1 THEN true
        WHEN n1 = 0 AND (f1 + 0.5) / (f1 + l2 + 1) <= 0.2 AND 0.5 / (l2 + 1) <= 0.1 THEN true
        WHEN f1 / (n1 + f1 + 20) >= 0.1 THEN false
        WHEN (e3 + 0.2) / (n3 + 1.7) <= {ENDS} THEN true
        WHEN e3 / (n3 + 4) > {ENDS} THEN false
        WHEN (n2 + 0.5) / (n2 + l2 + 1) <= 0.1 THEN true
        WHEN (e2 + 0.2) / (n2 + 1.7) <= {ENDS} THEN true
        WHEN e2 / (n2 + 4) > {ENDS} THEN false
        WHEN (e1 + 0.1) / (n1 + 1) <= 0.002 THEN true END""")
    known = known.withColumn("goes_on", goes_on).withColumn("never", F.expr("(e3 + 0.2) / (n3 + 1) <= 0.02")).withColumn("seen", F.expr(f"(e3 + 0.2) / (n3 + 1.7) <= {ENDS} OR (e2 + 0.2) / (n2 + 1.7) <= {ENDS}")).select("a", "b", "c", "goes_on", "never", "seen")

    judged = texts.join(known, ["a", "b", "c"], "left")
    for unit in ("chars", "bytes", "utf16"):
        at = limits.filter(F.col("unit") == unit).select("source", F.col("length").alias(unit), F.lit(True).alias(f"_{unit}"))
        judged = judged.join(at, ["source", unit], "left")
    judged = judged.withColumn("at_limit", F.coalesce("_chars", "_bytes", "_utf16", F.lit(False)))
    # an omission mark after words that many texts elsewhere end in this way is style
    outside = F.round(F.sum(F.when(~F.col("at_limit"), F.col("weight")).otherwise(0.0)), 6)
    habit = judged.filter("how = 'dots'").groupBy("b", "c").agg((outside / (F.round(F.sum("weight"), 6) + 1) > 0.6).alias("style"))
    judged = judged.join(habit, ["b", "c"], "left").withColumn("style", F.coalesce("style", F.lit(False)))
    by_limit = F.expr("at_limit AND CASE how WHEN 'sentence' THEN false WHEN 'structure' THEN false WHEN 'number' THEN coalesce(never, false) WHEN 'dots' THEN coalesce(goes_on, false) OR NOT style ELSE true END")
    in_transfer = F.coalesce(F.expr("CASE how WHEN 'marked' THEN true WHEN 'comma' THEN true WHEN 'dots' THEN goes_on AND seen WHEN 'open' THEN goes_on END"), F.lit(False))
    judged = judged.withColumn("kind", F.when(by_limit, "limit").when(in_transfer, "transfer"))
    return judged.select(F.col("key").alias(key), "source", "how", "at_limit", "goes_on", F.col("kind").isNotNull().alias("is_cut"), "kind")


def source_report(judged: DataFrame) -> DataFrame:
    """Of each source: texts, cut texts and their share."""
    return judged.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("is_cut").cast("bigint")).alias("n_cut")).withColumn("share_cut", F.round(F.col("n_cut") / F.col("n"), 6))
