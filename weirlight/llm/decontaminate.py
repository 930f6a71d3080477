"""Benchmark decontamination by spaced seeds.

Words are runs of letters, digits and underscores, in lower case. A mask picks some places of a span of
words; the hash of the words there stands for the span, so substituted words at the other places do
not matter. Documents' spans are looked up among the benchmark's, for each mask. Around each hit, item
and document are laid side by side, and all runs of equal words with few substituted ones are found.
Runs on one diagonal, as a replaced stretch makes them, and on nearby ones, as a lost or added word
makes them, count together. A document is
contaminated by an item of which it has ``least_words`` words in such runs, or the share ``share`` of
the item where that is less.

The hashes of both sides are joined. A benchmark of ``most_spans`` span hashes or fewer is sent to all
executors as one table of hashes, by which each document is looked up where it is read. A larger one is
joined by a shuffle: documents' spans pass a bitmap of the benchmark's hashes of bounded size, are joined
by hash, each hash dealt to ``SALTS`` tasks, and the diagonals found are verified with the texts of the
document and the item beside them. Both ways have the same results.

Cases: null and empty texts and items have no words and match nothing. Items with fewer words than a
mask's span match only as a whole. Texts are searched whole. Equal items each match. Equal documents
have equal results. Null item ids are not reported as ids, but their items count. Item ids that are no
whole numbers raise Spark's cast error. A column of the name ``out`` is replaced; other columns stay as
they are.
"""

from __future__ import annotations

import math
import unicodedata
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import materialise, small_batches
from ._words import code_points, mix, run_hashes

_U = np.uint64
MASKS = ("110110110", "111011101", "101110011", "111100111")
SPAN = 9
#: Code points of documents that are searched at a time.
TOGETHER = 1 << 19
#: Tasks that the spans of one hash are dealt to, and bits of the bitmap of the benchmark's hashes: 8 MB.
SALTS, BITMAP = 8, 26

_WORD = np.array([unicodedata.category(chr(i))[0] in "LNM" or i == 95 for i in range(1 << 16)] + [True])
_PLACE = mix(np.arange(1, SPAN + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def hashed_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a text."""
    points = code_points(text)
    return run_hashes(points, _WORD[np.minimum(points, 1 << 16)])


def span_hash(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hashes of all spans of words as the mask sees them."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, salt * 0x632BE59BD9B4E019 % 2**64, _U)
    for k, use in enumerate(mask):
        if use == "1":
            out += words[k : k + n] * _PLACE[k]
    return mix(out)


def item_words(text: str | None) -> np.ndarray:
    return hashed_words((text or "").lower())[0]


def words_needed(n: int, least_words: int, share: float) -> int:
    """How many words of an item of n words make it found."""
    return min(least_words, math.ceil(share * n)) if n >= SPAN else n


def masks_for(sizes) -> list[tuple[int, str]]:
    """(salt, mask) of all masks that items of such numbers of words need: short items are matched as a whole."""
    return [*enumerate(MASKS), *((len(MASKS) + n, "1" * n) for n in sorted({n for n in sizes if 0 < n < SPAN}))]


def found_in(words: np.ndarray, item: np.ndarray, diagonals: list[int], need: int) -> tuple[int, int] | None:
    """(words matched, first place) of an item along the diagonals and near them, None if they are fewer than needed."""
    matched, start = together([r for d in diagonals for r in runs_along(words, item, d)])
    return (matched, start) if matched >= need else None


class Index:
    """Span hashes of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], least_words: int = 13, share: float = 0.6):
        self.ids = [i for i, _ in items]
        self.words = [item_words(t) for _, t in items]
        self.need = [words_needed(len(w), least_words, share) for w in self.words]
        self.tables = []
        for salt, mask in masks_for(map(len, self.words)):
            whole = salt >= len(MASKS)
            rows = [(k, h) for k, w in enumerate(self.words) if (len(w) == len(mask) if whole else len(w) >= SPAN) for h in [span_hash(w, mask, salt)]]
            hashes = np.concatenate([h for _, h in rows]) if rows else np.zeros(0, _U)
            item = np.repeat([k for k, _ in rows], [len(h) for _, h in rows]).astype(np.int64)
            place = np.concatenate([np.arange(len(h)) for _, h in rows]) if rows else np.zeros(0, np.int64)
            order = np.argsort(hashes, kind="stable")
            bits = max(10, int(np.ceil(np.log2(64 * len(hashes) + 1))))
            known = np.zeros(1 << bits, bool)
            known[hashes >> _U(64 - bits)] = True
            self.tables.append((mask, salt, hashes[order], item[order], place[order], known, _U(64 - bits)))

    def hits(self, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (document, item, diagonal) where a span fits; doc: the document of each word, rising."""
        found = []
        for mask, salt, hashes, item, place, known, shift in self.tables:
            own = span_hash(words, mask, salt)
            if not len(own) or not len(hashes):
                continue
            at = np.flatnonzero(known[own >> shift])
            at = at[doc[at] == doc[at + len(mask) - 1]]
            low, high = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
            many = high - low
            at, low = np.repeat(at, many), np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            found.append(np.c_[doc[at], item[low], at - place[low]])
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text, (item id, words matched, words of the item, first word in the text)."""
        out: list[list[tuple]] = [[] for _ in texts]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") < TOGETHER):
                size += len(texts[end] or "")
                end += 1
            self._search([(t or "").lower() for t in texts[at:end]], at, out)
            at = end
        return out

    def _search(self, texts: list[str], first: int, out: list[list[tuple]]) -> None:
        words, starts = hashed_words("\n".join(texts))
        if not len(words):
            return
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        doc = np.searchsorted(begin, starts, "right") - 1
        bound = np.searchsorted(doc, np.arange(len(texts) + 1))
        hits = self.hits(words, doc)
        cut = np.flatnonzero(np.diff(hits[:, :2], axis=0).any(1)) + 1
        for rows in np.split(hits, cut):
            if not len(rows):
                continue
            d, k = int(rows[0, 0]), int(rows[0, 1])
            hit = found_in(words[bound[d] : bound[d + 1]], self.words[k], (rows[:, 2] - bound[d]).tolist(), self.need[k])
            if hit:
                out[first + d].append((self.ids[k], hit[0], len(self.words[k]), hit[1]))


def runs_along(words: np.ndarray, item: np.ndarray, diagonal: int) -> list[tuple[int, np.ndarray, int]]:
    """(diagonal, places of the item that are equal, first place in words) of every run along a diagonal.

    Equal words count 1 and substituted ones -1.5. The runs are the maximal scoring segments, so a run
    goes over substituted words as long as what follows makes up for them, and else another run begins.
    Runs of fewer than 4 equal words are none.
    """
    low, high = max(0, -diagonal), min(len(item), len(words) - diagonal)
    if high <= low:
        return []
    equal = low + np.flatnonzero(item[low:high] == words[low + diagonal : high + diagonal])
    if not len(equal):
        return []
    cuts = np.flatnonzero(np.diff(equal) > 1) + 1
    # Stretches of equal words, as bounds in equal; sums before and after each stretch.
    first, last = np.r_[0, cuts], np.r_[cuts, len(equal)]
    after = last - 1.5 * (equal[first] - low - first)
    # Each open run: its bounds, its sums, and the nearest run before it that begins no higher.
    open_: list[tuple[int, int, float, float, int]] = []
    for f, e, r in zip(first.tolist(), last.tolist(), after.tolist(), strict=True):
        left, j = r - (e - f), len(open_) - 1
        while True:
            while j >= 0 and open_[j][2] > left:
                j = open_[j][4]
            if j < 0 or open_[j][3] > r:
                break
            f, _, left, _, before = open_[j]
            del open_[j:]
            j = before
        open_.append((f, e, left, r, j))
    least = min(4, len(item))
    return [(diagonal, equal[f:e], int(equal[f]) + diagonal) for f, e, *_ in open_ if e - f >= least]


def together(runs, reach: int = 8) -> tuple[int, int]:
    """(words matched, first place): the most distinct places of an item in runs within ``reach`` diagonals of one of them.

    A window slides over the diagonals and counts how many of its runs cover each place, so each run
    comes in and goes out once. Of equal windows, the one with the smallest first place is taken.
    """
    if not runs:
        return 0, 0
    runs.sort(key=lambda r: r[0])
    cover = np.zeros(1 + max(int(r[1][-1]) for r in runs), np.int64)
    # Runs of the window that may still be its first: their first places rise.
    firsts: deque[int] = deque()
    best, matched, low, high = (0, 0), 0, 0, 0
    for k, (diagonal, _, _) in enumerate(runs):
        if k and runs[k - 1][0] == diagonal:
            continue
        while high < len(runs) and runs[high][0] <= diagonal + reach:
            places = runs[high][1]
            matched += np.count_nonzero(cover[places] == 0)
            cover[places] += 1
            while firsts and runs[firsts[-1]][2] >= runs[high][2]:
                firsts.pop()
            firsts.append(high)
            high += 1
        while runs[low][0] < diagonal - reach:
            places = runs[low][1]
            cover[places] -= 1
            matched -= np.count_nonzero(cover[places] == 0)
            if firsts[0] == low:
                firsts.popleft()
            low += 1
        best = max(best, (int(matched), -runs[firsts[0]][2]))
    return best[0], -best[1]


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("matched", T.IntegerType()), T.StructField("item_words", T.IntegerType()), T.StructField("first_word", T.IntegerType())]))


def searcher(index):
    """A column function over a broadcast index: text to an array of HITS."""

    @F.pandas_udf(HITS)
    def searched(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("item_id", "matched", "item_words", "first_word"), h, strict=True)) for h in hits] for hits in index.value.search(texts.tolist())])

    return searched


def contamination(docs: DataFrame, benchmark: DataFrame, text: Column | None = None, out: str = "hits", most_spans: int = 4_000_000, least_words: int = 13, share: float = 0.6) -> DataFrame:
    """docs with an array column ``out`` of (item_id, matched, item_words, first_word), empty for clean ones."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("text") != "")
    # A word takes one code point at least, and another parts it from the next.
    spans = len(MASKS) * (items.agg(F.sum(F.ceil(F.length("text") / 2))).first()[0] or 0)
    text = F.col("text") if text is None else text
    if spans > most_spans:
        return _by_shuffle(docs, items, text, out, least_words, share)
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    index = spark.sparkContext.broadcast(Index(rows, least_words, share))
    return docs.withColumn(out, F.array_sort(searcher(index)(text)))


def _spans(words: np.ndarray, masks: list[tuple[int, str]], whole: bool):
    """(hashes, places) of the spans of an item, or with ``whole`` of a document, for each mask that is due."""
    for salt, mask in masks:
        if whole or (len(words) >= SPAN if salt < len(MASKS) else len(words) == len(mask)):
            h = span_hash(words, mask, salt)
            yield h, np.arange(len(h))


def _by_shuffle(docs: DataFrame, items: DataFrame, text: Column, out: str, least_words: int, share: float) -> DataFrame:
    """contamination by a join of span hashes, for benchmarks of any size."""
    spark = docs.sparkSession
    items = materialise(items.withColumn("item", F.monotonically_increasing_id()), "benchmark")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]).alias("kept")
    table = materialise(docs.select(F.monotonically_increasing_id().alias("uid"), text.alias("text"), whole), "texts")

    @F.pandas_udf("int")
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(item_words(t)))

    short = [r[0] for r in items.select(size("text").alias("n")).where(F.col("n") < SPAN).distinct().collect()]
    masks = masks_for(short)

    def of_items(batches):
        for b in batches:
            parts = [(h, np.full(len(h), item), place) for item, t in zip(b["item"], b["text"], strict=True) for h, place in _spans(item_words(t), masks, False)]
            if parts:
                h, item, place = map(np.concatenate, zip(*parts, strict=True))
                yield pd.DataFrame({"h": h.view(np.int64), "item": item, "place": place})

    spans = materialise(items.mapInPandas(of_items, "h long, item long, place long"), "benchmark-spans")
    # One bit for each hash's top bits: 2**(BITMAP - 6) numbers at most come to the driver.
    top = F.shiftrightunsigned("h", 64 - BITMAP)
    bits = spans.select(F.shiftright(top, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITMAP}) & 63L as int))").alias("mask"))
    rows = bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bitmap = np.zeros(1 << (BITMAP - 6), _U)
    bitmap[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(_U)
    known = spark.sparkContext.broadcast(bitmap)

    def of_documents(batches):
        for b in batches:
            parts = []
            for uid, t in zip(b["uid"], b["text"], strict=True):
                for h, place in _spans(item_words(t), masks, True):
                    top = h >> _U(64 - BITMAP)
                    on = (known.value[top >> _U(6)] >> (top & _U(63))) & _U(1) == 1
                    if on.any():
                        parts.append((h[on], np.full(int(on.sum()), uid), place[on]))
            if parts:
                h, uid, at = map(np.concatenate, zip(*parts, strict=True))
                yield pd.DataFrame({"h": h.view(np.int64), "uid": uid, "at": at})

    probes = table.select("uid", "text").mapInPandas(of_documents, "h long, uid long, at long").withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int"))
    sides = spans.withColumn("salt", F.explode(F.lit(list(range(SALTS)))))
    met = probes.join(sides, ["h", "salt"]).groupBy("uid", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    pairs = met.join(items.withColumnRenamed("text", "item_text"), "item").join(table.select("uid", "text"), "uid")

    def verified(batches):
        for b in batches:
            rows = []
            for uid, item_id, a, t, diagonals in zip(b["uid"], b["item_id"], b["item_text"], b["text"], b["diagonals"], strict=True):
                item = item_words(a)
                hit = found_in(item_words(t), item, sorted(int(d) for d in diagonals), words_needed(len(item), least_words, share))
                if hit:
                    rows.append((uid, None if pd.isna(item_id) else int(item_id), hit[0], len(item), hit[1]))
            uid, ids, matched, n, first = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"uid": np.array(uid, np.int64), "item_id": pd.array(ids, "Int64"), "matched": np.array(matched, np.int32), "item_words": np.array(n, np.int32), "first_word": np.array(first, np.int32)})

    found = pairs.mapInPandas(verified, "uid long, item_id long, matched int, item_words int, first_word int")
    hits = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("item_id", "matched", "item_words", "first_word"))).alias("hits"))
    joined = table.select("uid", "kept").join(hits, "uid", "left")
    return joined.select("kept.*", F.coalesce("hits", F.array().cast(HITS)).alias(out))
