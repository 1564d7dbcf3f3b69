"""Problem 7: passages of held-out test items inside documents.

Size-partitioned MinHash containment search (an LSH ensemble). Domains are the sets
of five-word shingles of documents. Against a passage of 12 words the Jaccard similarity of a whole long document vanishes, so
a document with more than 16 shingles is cut into overlapping domains of 16, in one of which a passage of 12 words lies whole;
the size partitions are those of the domains. Queries are the 12-word windows of the
items' own text. The number of hash functions of each size partition follows from the
least Jaccard similarity at which a domain of that size can hold what the allowed edits
leave of a passage, at a stated chance to miss it.

The index of the items' hash values is a table, and the search an equi-join with it, so there may be any number of items. To
spare the shuffle, values of documents pass a Bloom filter of the index first; it is at most ``MOST_BITS`` bits
whatever the number of items, and lets through all that the join could find. A value that many documents
have is split by salts.

A collision is verified on the words around it: shared shingles are looked up exactly, and from each
the alignment is extended both ways with as many edits as the length allows. A passage of any length with one edit in eight words holds
a piece of 12 to 23 words of which the same is true, so the words around a domain that a piece can reach are enough.
The exact containment of the item's shingles in the verified stretches is reported.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import materialize

SHINGLE = 5
WORDS = 12  # least passage
PER_EDIT = 8  # one word in eight may differ
PIECE = 2 * WORDS - 1  # every longer passage holds a piece of at most so many words
BLOCK, STRIDE = 16, 8  # shingles in a domain of a long document
MISS = 0.002
BITS, CHECKS, MOST_BITS = 32, 5, 1 << 28  # of the Bloom filter: per value, looked up per value, and in all (32 MB)
SALTS = 8

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_TAG = re.compile(r"<[/!a-zA-Z][^<>]*>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_OFFSETS = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, markup, invisible characters or width variants."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.casefold())


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(words: list[str]) -> np.ndarray:
    """A hash for each word; equal words are hashed once."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    code, known = pd.factorize(np.array(words, dtype=object))
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in known), dtype=np.uint64, count=len(known))[code]


def shingles(h: np.ndarray) -> np.ndarray:
    if len(h) < SHINGLE:
        return np.empty(0, dtype=np.uint64)
    n, s = len(h) - SHINGLE + 1, np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
    for j in range(SHINGLE):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return _mix(s)


def kept() -> int:
    """The fewest shingles that any passage with the edits its length allows shares with its item (2: of 16 words, with the 6th and 11th changed)."""
    least = WORDS
    for n in range(WORDS, 3 * PER_EDIT):  # longer ones keep more
        for at in combinations(range(n), n // PER_EDIT):
            least = min(least, sum(not any(i <= e < i + SHINGLE for e in at) for i in range(n - SHINGLE + 1)))
    return least


def bands(size: int, query: int = WORDS - SHINGLE + 1) -> int:
    """Hash functions for domains of at most ``size`` shingles: each kept shingle may be all that its window and the domain share."""
    j = kept() / (query + size - 1)
    return math.ceil(math.log(MISS) / math.log(1 - j))


PARTITIONS = tuple((u, bands(u)) for u in (8, 16))
_MULTIPLY = _mix(np.arange(1, PARTITIONS[-1][1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _permuted(s: np.ndarray, j: int) -> np.ndarray:
    x = s * _MULTIPLY[j]
    return (x ^ (x >> np.uint64(32))) * _MULTIPLY[j]


def _key(value: np.ndarray, j: int) -> np.ndarray:
    """A MinHash value under function ``j`` as one number to join on."""
    return _mix(value ^ _OFFSETS[j]).view(np.int64)


def _positions(key: np.ndarray, check: int, bits: int) -> np.ndarray:
    return _mix(key.view(np.uint64) + _OFFSETS[check]) & np.uint64(bits - 1)


class Filter:
    """A Bloom filter of the index's keys."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def passes(self, key: np.ndarray) -> np.ndarray:
        """Positions of keys that may be in the index."""
        at = np.arange(len(key))
        for check in range(CHECKS):
            p = _positions(key[at], check, self.bits)
            at = at[(self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0]
        return at


def windows(h: np.ndarray) -> np.ndarray:
    """Keys of the 12-word windows of a stretch of an item's own words, each once."""
    part, n = shingles(h), WORDS - SHINGLE + 1
    keys = [_key(np.lib.stride_tricks.sliding_window_view(_permuted(part, j), n).min(axis=1), j) for j in range(len(_MULTIPLY))]
    return np.unique(np.concatenate(keys))


def _sentences(text: str | None) -> list[list[str]]:
    return [w for part in _SENTENCE.split(text or "") if (w := words_of(part))]


def _name(words: list[str], kind: str = "") -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(kind + " ".join(words))).view(np.int64))


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What an item's text may share with others: its sentences and its shingles."""
    for pdf in batches:
        names, marks = [], []
        for t in pdf["t"]:
            parts = _sentences(t)
            words = [w for part in parts for w in part]
            found = {_name(part, "sentence ") for part in parts} | set(shingles(_hashed(words)).view(np.int64).tolist())
            names += [_name(words)] * len(found)
            marks += found
        yield pd.DataFrame({"th": names, "mark": marks}, dtype="int64")


def own_stretches(text: str, shared: set[int]) -> list[np.ndarray]:
    """The words, hashed, of each stretch of at least 12 words that belong to an item alone.

    A sentence that other items have too, of any length, isn't its own, nor is a stretch of 12 or more words all of whose shingles
    others have.
    """
    parts = _sentences(text)
    h = _hashed([w for part in parts for w in part])
    begins = np.cumsum([0, *map(len, parts)]).tolist()
    starts, own, common = set(begins), np.ones(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    for part, lo, hi in zip(parts, begins, begins[1:]):
        if _name(part, "sentence ") in shared:
            own[lo:hi] = False
    for k, x in enumerate(shingles(h).view(np.int64).tolist()):
        if x in shared:
            common[k : k + SHINGLE] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], common.astype(np.int8), [0]])))
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
        lo = next((k for k in range(lo, lo + SHINGLE) if k in starts), lo)  # words before an instruction may be alike by chance
        if hi - lo >= WORDS:
            own[lo:hi] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
    return [h[lo:hi] for lo, hi in zip(edge[::2], edge[1::2]) if hi - lo >= WORDS]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(th, part, h.tobytes()) for th, t, shared in zip(pdf["th"], pdf["t"], pdf["shared"]) for part, h in enumerate(own_stretches(t, set() if shared is None else set(shared)))]
        if rows:
            yield pd.DataFrame(rows, columns=["th", "part", "words"])


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = [windows(np.frombuffer(w, dtype=np.uint64)) for w in pdf["words"]]
        n = [len(k) for k in keys]
        if keys:
            yield pd.DataFrame({"key": np.concatenate(keys), "th": np.repeat(pdf["th"].to_numpy(dtype=np.int64), n), "part": np.repeat(pdf["part"].to_numpy(dtype=np.int32), n)})


def _bits(bits: int):
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b for b in batches if len(b)):
            at = np.unique(np.concatenate([_positions(pdf["key"].to_numpy(), c, bits) for c in range(CHECKS)]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pd.DataFrame({"at": word.astype(np.int64), "bits": value.view(np.int64)})

    return put


def domains(texts: list[str], known: Filter) -> list[tuple[int, np.ndarray, bytes]]:
    """Of each domain with values that may be in the index: number of its text, these keys, and the words (hashed) around it."""
    words = [words_of(t) for t in texts]
    size = np.array([len(w) if len(w) >= WORDS - 1 else 0 for w in words], dtype=np.int64)  # one of twelve words may be missing
    h = _hashed([x for w, n in zip(words, size) if n for x in w])
    doc = np.repeat(np.arange(len(texts)), size)
    if not len(h):
        return []
    begin = np.cumsum(size) - size
    s = shingles(h)
    inside = doc[: len(s)] == doc[SHINGLE - 1 :]
    v, owner = s[inside], doc[: len(s)][inside]
    place = np.arange(len(h))[: len(s)][inside] - begin[owner]  # of a shingle in its text
    chunk = np.flatnonzero(place % STRIDE == 0)  # starts of runs of STRIDE shingles
    last = np.append(owner[chunk][1:] != owner[chunk][:-1], True)
    alone = last & np.append(True, last[:-1])  # the only run of its text
    first = np.flatnonzero(~last | alone)
    second = np.where(alone[first], first, first + 1)
    small = alone[first]
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for j in range(len(_MULTIPLY)):
        least = np.minimum.reduceat(_permuted(v, j), chunk)
        d = np.arange(len(first)) if j < PARTITIONS[0][1] else np.flatnonzero(~small)
        key = _key(np.minimum(least[first[d]], least[second[d]]), j)
        ok = known.passes(key)
        hits.append((d[ok], key[ok]))
    d, key = (np.concatenate(x) for x in zip(*hits))
    order = np.argsort(d, kind="stable")
    d, key = d[order], key[order]
    who, start = np.unique(d, return_index=True)
    out = []
    for i, lo, hi in zip(who.tolist(), start.tolist(), [*start[1:].tolist(), len(d)]):
        at = chunk[first[i]]
        t, p = int(owner[at]), int(place[at])
        lo_w, hi_w = max(0, p - PIECE), min(int(size[t]), p + BLOCK + SHINGLE - 1 + PIECE)
        out.append((t, key[lo:hi], h[begin[t] + lo_w : begin[t] + hi_w].tobytes()))
    return out


def verified(item: np.ndarray, doc: np.ndarray) -> set[int]:
    """Shingles of an item's stretch that a stretch of a document shares, if the latter holds a passage of it."""
    ours, theirs = shingles(item), shingles(doc).tolist()
    where: dict[int, list[int]] = {}
    for k, x in enumerate(ours.tolist()):
        where.setdefault(x, []).append(k)
    item, most = item.tolist(), min(len(item), PIECE) // PER_EDIT
    for pos, x in enumerate(theirs):
        for k in where.get(x, ()):
            left = _reach(item[:k][::-1], doc[max(0, pos - k - most - 1) : pos][::-1].tolist(), most)
            right = _reach(item[k + SHINGLE :], doc[pos + SHINGLE : pos + len(item) + most + 1].tolist(), most)
            if any(left[a] + SHINGLE + right[b] >= max(WORDS, PER_EDIT * (a + b)) for a in range(most + 1) for b in range(most + 1 - a)):
                return where.keys() & set(theirs)
    return set()


def _reach(a: list[int], b: list[int], most: int) -> list[int]:
    """For 0..most edits: how many words of ``a`` a start of ``b`` covers, ending in an equal word."""
    out, best = [], 0
    front = {0: 0}  # diagonal (words of b less words of a) -> words of a covered
    for e in range(most + 1):
        if e:
            new: dict[int, int] = {}
            for d, i in front.items():
                for nd, ni in ((d, i + 1), (d + 1, i), (d - 1, i + 1)):  # changed, added, dropped
                    if ni <= len(a) and 0 <= ni + nd <= len(b):
                        new[nd] = max(new.get(nd, -1), ni)
            front = new
        for d, i in list(front.items()):
            at = i
            while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                i += 1
            front[d] = i
            if i > at:
                best = max(best, i)
        out.append(best)
    return out


def leaks(docs: DataFrame, items: DataFrame, doc: str, text: str, item: str, item_text: str) -> DataFrame:
    """``doc, item, shared, containment``: each document that holds a passage of an item's own text (12 words, one edit in eight words).

    shared: how many different shingles of the item's own text stand in the verified stretches; containment: their share of
    all of these. Sentences that several items hold, of any length, and stretches of 12 or more words whose shingles several items hold,
    are no own text; an item without 12 own words in a row can't be found. Null and empty texts give nothing; repeated documents each give
    their rows, items of the same text are all reported. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    its = items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).filter("length(t) > 0")

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(th=[_name([w for part in _sentences(t) for w in part]) for t in pdf["t"]])

    named = materialize(its.mapInPandas(name, T.StructType([T.StructField("i", items.schema[item].dataType), T.StructField("t", T.StringType()), T.StructField("th", T.LongType())])), "items")
    texts = named.groupBy("th").agg(F.min("t").alias("t"))
    marks = materialize(texts.select("t").mapInPandas(_marks, "th bigint, mark bigint"), "marks")
    shared = marks.groupBy("mark").agg(F.min("th").alias("_a"), F.max("th").alias("_b")).filter("_a <> _b").select("mark")
    common = marks.join(shared, "mark").groupBy("th").agg(F.collect_set("mark").alias("shared"))
    parts = materialize(texts.join(common, "th", "left").mapInPandas(_parts, "th bigint, part int, words binary"), "parts")
    index = materialize(parts.mapInPandas(_index, "key bigint, th bigint, part int"), "index")
    bits = min(MOST_BITS, 1 << (BITS * max(32, index.count())).bit_length())  # a power of two
    put = index.select("key").mapInPandas(_bits(bits), "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most MOST_BITS / 64 rows
    filled = np.zeros(bits // 64, dtype=np.int64)
    filled[put["at"].to_numpy(dtype=np.int64)] = put["bits"].to_numpy(dtype=np.int64)
    known = spark.sparkContext.broadcast(Filter(filled.view(np.uint64), bits))

    src = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row")).filter("length(_text) > 0")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = domains(pdf["_text"].tolist(), known.value)
            at = [t for t, _, _ in got]
            if at:
                yield pd.DataFrame({"_doc": pdf["_doc"].iloc[at].to_numpy(), "_row": pdf["_row"].iloc[at].to_numpy(), "keys": [k for _, k, _ in got], "around": [w for _, _, w in got]})

    kind = T.StructField("_doc", src.schema["_doc"].dataType)
    some = src.mapInPandas(search, T.StructType([kind, T.StructField("_row", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("around", T.BinaryType())]))
    some = materialize(some.withColumn("_at", F.monotonically_increasing_id()), "domains")
    keyed = some.select("_at", F.explode("keys").alias("key")).withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(SALTS)).cast("int"))
    used = index.join(keyed.select("key").distinct(), "key", "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = keyed.join(used, ["key", "_salt"]).select("_at", "th", "part").distinct()
    # parts are salted like the documents, as one stretch may be in many of them
    salted = parts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tried = pairs.join(some.drop("keys"), "_at").withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(SALTS)).cast("int")).join(salted, ["th", "part", "_salt"]).select("_doc", "_row", "th", "words", "around")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [verified(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)) for a, b in zip(pdf["words"], pdf["around"])]
            keep = [i for i, g in enumerate(got) if g]
            held = [np.array(sorted(got[i]), dtype=np.uint64).view(np.int64) for i in keep]
            if keep:
                yield pd.DataFrame({"_doc": pdf["_doc"].iloc[keep].to_numpy(), "_row": pdf["_row"].iloc[keep].to_numpy(), "th": pdf["th"].iloc[keep].to_numpy(), "held": held})

    hits = tried.mapInPandas(verify, T.StructType([kind, T.StructField("_row", T.LongType()), T.StructField("th", T.LongType()), T.StructField("held", T.ArrayType(T.LongType()))]))
    found = hits.groupBy("_row", "th").agg(F.first("_doc").alias("_doc"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("shared"))

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"th": pdf["th"], "held": [np.unique(shingles(np.frombuffer(w, dtype=np.uint64))).view(np.int64) for w in pdf["words"]]})

    sizes = parts.mapInPandas(total, "th bigint, held array<bigint>").groupBy("th").agg(F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("_all"))
    whole = named.select(F.col("i").alias(item), "th").join(sizes, "th")
    return found.join(whole, "th").select(F.col("_doc").alias(doc), item, "shared", (F.col("shared") / F.col("_all")).alias("containment"))
