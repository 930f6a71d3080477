"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case, takes accents away, maps look-alike letters of other scripts to Latin ones and
digits and signs inside words to the letters they stand for, and joins letters that are spelled out
with signs between them. The lexicon is learned from labelled documents: whole words, and beginnings
of words that stand for their inflected forms, each with its log-odds as weight. Words that begin
like an entry but occur in clean documents are exception phrases: they, and phrases given by the
caller, are matched too, and the hits they cover do not count. The sum of weights and the sum per word
of the text (the length norm) make the score by a logistic curve.

Cases: null and empty texts, and texts without a hit, have a score under 0.5. Very long texts are
matched whole. Equal texts have equal scores. Without labelled documents of both classes every score
is 0. Labels of null ids or null values are not used. A column of the name ``out`` is replaced; other
columns stay as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import sample, sigmoid_fit
from ._shared import small_batches
from ._words import code_points

#: Look-alike letters, each pair the letter and the Latin one it passes for (fixed values).
HOMOGLYPHS = dict(
    "аa вb еe зe іi јj кk мm нh оo рp сc тt уy хx ѕs ԁd ԛq ԝw һh гr αa βb γy εe ηn ιi κk νv οo ρp τt υu χx ωw ıi łl øo đd ħh ɑa ɡg ⅼl".split()
)
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e"}
#: Invisible code points that split words.
INVISIBLE = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))

_TOP = 0x20000


def _folded_points() -> np.ndarray:
    """What each code point is folded to: a letter or digit, 32 for what separates words, 0 for what is left out."""
    table = np.full(_TOP + 1, 32, np.uint32)
    for i in range(_TOP):
        c = chr(i)
        if i in INVISIBLE or unicodedata.combining(c):
            table[i] = 0
        elif c.isalnum():
            low = unicodedata.normalize("NFKD", c.lower())[0]
            low = HOMOGLYPHS.get(low, low).lower()
            table[i] = ord(low[0]) if ord(low[0]) < 1 << 16 else 0xFFFD
    return table


_FOLDED: list[np.ndarray] = []
_SUB = str.maketrans(SUBSTITUTES)
_LEET = re.compile("[" + re.escape("".join(SUBSTITUTES)) + "]+")
_SPELLED = re.compile(r"(?<!\w)\w(?:[.\-_*·]\w){2,}(?!\w)")
_SPELLED_PART = re.compile(r"[.\-_*·]\w[.\-_*·]")
_SIGNS = re.compile(r"[.\-_*·]")


def _spell_out(text: str) -> str:
    """text with digits and signs that stand in a word, or digits at an end of one, as the letters they stand for."""
    out, last, n = [], 0, len(text)
    for m in _LEET.finditer(text):
        a, b = m.span()
        before, after = a > 0 and text[a - 1].isalpha(), b < n and text[b].isalpha()
        if before and after or after and not (a and text[a - 1].isalnum()) or before and a > 1 and text[a - 2].isalpha() and m.group().isdigit():
            out += text[last:a], m.group().translate(_SUB)
            last = b
    return "".join((*out, text[last:])) if out else text


def fold(text: str | None) -> str:
    """The text's words in folded form, with one space before, between and after them."""
    if not text:
        return "  "
    if not _FOLDED:
        _FOLDED.append(_folded_points())
    text = _spell_out(text)
    if _SPELLED_PART.search(text):
        text = _SPELLED.sub(lambda m: _SIGNS.sub("", m.group()), text)
    points = _FOLDED[0][np.minimum(code_points(f" {text} "), _TOP)]
    points = points[points != 0]
    space = points == 32
    space[1:] &= space[:-1]
    space[0] = False
    return points[~space].astype(np.uint16).tobytes().decode("utf-16-le", "replace") if len(points) > 1 else "  "


@dataclass
class Lexicon:
    """weights: by folded entry; entries with a space after them are whole words, others word beginnings."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (0.0, 0.0, -40.0)

    def matcher(self) -> ahocorasick.Automaton | None:
        """Over entries and exceptions, all with the space that begins a word."""
        if not self.weights:
            return None
        automaton = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            automaton.add_word(f" {entry}", (len(entry) + 1, weight))
        for phrase in self.exceptions:
            automaton.add_word(f" {phrase.strip()} ", (len(phrase.strip()) + 2, None))
        automaton.make_automaton()
        return automaton

    def score(self, texts, automaton) -> tuple[np.ndarray, np.ndarray]:
        """(scores, hits) of texts."""
        found = [raw_sums(t, automaton) for t in texts]
        x = features(np.array([f[0] for f in found]), np.array([f[2] for f in found]))
        a, b, c = self.curve
        score = 1 / (1 + np.exp(-np.clip(a * x[:, 0] + b * x[:, 1] + c, -30, 30)))
        return np.where(np.array([f[1] for f in found]) > 0, score, np.minimum(score, 0.01)), np.array([f[1] for f in found], dtype=int)


def raw_sums(text: str | None, automaton) -> tuple[float, int, int]:
    """(sum of weights, hits, words). At each place the longest entry counts, and none inside an exception.

    A form that comes n times counts 1 + log n times, so that mere repetition does not make a text toxic.
    """
    folded = fold(text)
    words = folded.count(" ") - 1
    if automaton is None or words < 1:
        return 0.0, 0, max(0, words)
    hits: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        elif hits.get(start, (0, 0.0))[0] < length:
            hits[start] = (length, weight)
    if excused:
        hits = {s: h for s, h in hits.items() if not any(a <= s and s + h[0] - 1 <= b for a, b in excused)} if len(excused) < 50 else _outside(hits, excused)
    forms = Counter((folded[s : folded.index(" ", s + 1)], w) for s, (_, w) in hits.items())
    return sum(w * (1 + math.log(n)) for (_, w), n in forms.items()), len(hits), words


def _outside(hits, excused):
    """The hits that no exception covers, for many exceptions: starts in order, with the furthest end so far."""
    excused.sort()
    starts, ends = np.array([a for a, _ in excused]), np.maximum.accumulate([b for _, b in excused])
    kept = {}
    for s, h in hits.items():
        k = np.searchsorted(starts, s, "right") - 1
        if k < 0 or ends[k] < s + h[0] - 1:
            kept[s] = h
    return kept


def features(sums: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each text: log of the sum of weights, and log of the sum for a thousand words."""
    return np.c_[np.log1p(sums), np.log1p(1000 * sums / np.maximum(words, 20))]


def _fold_udf():
    @F.pandas_udf(T.StringType())
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(fold)

    return folded


def _words_udf():
    @F.pandas_udf(T.StringType())
    def different(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(sorted(set(t.split()))))

    return different


def _sums_udf(lexicons: list):
    """Of folded texts and the number of the lexicon for each, the sum of weights and the words; 0 and 0 where there is no lexicon."""
    kept: list = []

    @F.pandas_udf("total double, words int")
    def sums(texts: pd.Series, which: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.extend(None if x is None else x.matcher() for x in lexicons)
        found = [raw_sums(t, kept[w]) if lexicons[w] is not None else (0.0, 0, 0) for t, w in zip(texts, which, strict=True)]
        return pd.DataFrame({"total": [f[0] for f in found], "words": [f[2] for f in found]})

    return sums


def _surprise(a: int, n: int, b: int, m: int) -> float:
    """Twice the log-likelihood ratio of a of n against b of m, 0 if a's rate is the lower."""
    if a * m <= b * n:
        return 0.0
    both = (a + b) / (n + m)
    part = lambda x, k, p: (x * np.log(x / (k * p)) if x else 0.0) + ((k - x) * np.log((k - x) / (k * (1 - p))) if k > x else 0.0)
    return 2 * float(part(a, n, both) + part(b, m, both))


class Evidence:
    """Which entries occur in which folded texts; only entries of min_docs toxic texts or more are told apart.

    Beginnings are counted a letter longer at a time, and only where the shorter one is frequent.
    """

    def __init__(self, texts: list[str], y: np.ndarray, min_docs: int, shortest: int, longest: int):
        self.y, self.min_docs, self.shortest = y, min_docs, shortest
        bad = [t for t, v in zip(texts, y, strict=True) if v]
        frequent: set[str] = set()
        for k in range(shortest, longest + 1):
            count: Counter = Counter()
            for t in bad:
                count.update({w[:k] for w in t.split() if len(w) >= k and (k == shortest or w[: k - 1] in frequent)})
            frequent |= {e for e, n in count.items() if n >= min_docs}
        count = Counter()
        for t in bad:
            count.update({w for w in t.split() if len(w) < shortest or w[: min(len(w), longest)] in frequent})
        self.entries = sorted(frequent | {f"{w} " for w, n in count.items() if n >= min_docs}, key=lambda e: (len(e.strip()), e))
        self.number = {e: i for i, e in enumerate(self.entries)}
        rows, found = [], []
        for r, t in enumerate(texts):
            mine = {i for w in set(t.split()) for i in self._of(w, longest)}
            rows.append(np.full(len(mine), r, np.int32))
            found.append(np.fromiter(mine, np.int32, len(mine)))
        self.rows, self.found = np.concatenate(rows), np.concatenate(found)
        # Words of clean texts that begin like an entry which may come to be one.
        a, b = self._counts(np.ones(len(texts), bool))
        likely = set(np.flatnonzero((a + 0.1) / max(1, len(bad)) > 2 * b / max(1, len(texts) - len(bad))).tolist())
        self.clean_words: dict[int, set[str]] = {}
        for t, v in zip(texts, y, strict=True):
            for w in () if v else set(t.split()):
                if f"{w} " not in self.number:
                    for i in likely.intersection(self._of(w, longest)):
                        self.clean_words.setdefault(i, set()).add(w)

    def _of(self, word: str, longest: int) -> list[int]:
        """Numbers of the entries that a word is an instance of."""
        out = []
        for k in range(self.shortest, min(len(word), longest) + 1):
            i = self.number.get(word[:k])
            if i is None:
                break
            out.append(i)
        whole = self.number.get(f"{word} ")
        return out if whole is None else [*out, whole]

    def _counts(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many toxic and clean texts that are on each entry is."""
        used, bad = on[self.rows], self.y[self.rows] > 0
        return tuple(np.bincount(self.found[used & side], minlength=len(self.entries)) for side in (bad, ~bad))

    def learn(self, on: np.ndarray, precision: float, surprise: float, phrases: tuple[str, ...]) -> Lexicon:
        """The lexicon of the texts that are on, without a curve."""
        n, m = int((self.y[on] > 0).sum()), int((self.y[on] == 0).sum())
        a, b = self._counts(on)
        rate_bad, rate_good = (a + 0.1) / n, (b + 0.5) / m
        good = (a >= self.min_docs) & (rate_bad / (rate_bad + rate_good) >= precision)
        weights: dict[str, float] = {}
        excused: set[str] = set()
        for i in np.flatnonzero(good):
            e = self.entries[i]
            covered = any(e[:j] in weights for j in range(self.shortest, len(e)))
            if not covered and _surprise(int(a[i]), n, int(b[i]), m) >= surprise:
                weights[e] = float(np.log(rate_bad[i] / rate_good[i]))
                excused.update(self.clean_words.get(i, ()))
        return Lexicon(weights, sorted(excused | {fold(p).strip() for p in phrases} - {""}))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    k: int = 5,
    left_out: int = 0,
    most_toxic: int = 3000,
    most_clean: int = 9000,
    min_docs: int = 4,
    precision: float = 0.9,
    surprise: float = 20.0,
    shortest: int = 4,
    longest: int = 12,
    exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """Learn a lexicon from about most_toxic and most_clean labelled documents at most.

    An entry is the shortest beginning of words, or else a whole word, that occurs in min_docs
    different toxic texts or more, whose rate among toxic texts is ``precision`` or more of the sum of
    its rates, and for which twice the log-likelihood ratio of the two rates is ``surprise`` or more.
    The curve is fitted on sums by lexicons that were learned without the text that is scored. What
    comes to the driver of a text are its different folded words, and later a sum and a count.
    """
    small_batches(docs.sparkSession)
    drawn = sample(docs, labels, "toxic", {1: most_toxic, 0: most_clean}, k, left_out)
    folded = drawn.select("label", _fold_udf()("text").alias("folded")).groupBy("folded").agg(F.max("label").alias("label"))
    folded = folded.withColumn("third", F.pmod(F.xxhash64("folded"), F.lit(3)).cast("int")).persist()
    rows = sorted(tuple(r) for r in folded.select(_words_udf()("folded"), (F.col("label") == 1).cast("int"), "third").collect())
    texts, y, third = [r[0] for r in rows], np.array([float(r[1]) for r in rows]), np.array([r[2] for r in rows])
    if not y.any() or y.all():
        folded.unpersist()
        return Lexicon()
    seen = Evidence(texts, y, min_docs, shortest, longest)
    of = lambda on: seen.learn(on, precision, surprise, exceptions)
    lexicon = of(np.ones(len(texts), bool))
    parts = []
    for part in range(3):
        rest = third != part
        parts.append(of(rest) if y[rest].any() and not y[rest].all() else None)
    found = sorted(tuple(r) for r in folded.select((F.col("label") == 1).cast("int"), _sums_udf(parts)("folded", "third").alias("s")).select("*", "s.total", "s.words").drop("s").collect())
    folded.unpersist()
    y = np.array([float(r[0]) for r in found])
    x = features(np.array([r[1] for r in found]), np.array([r[2] for r in found]))
    (a, b), c = sigmoid_fit(x, y)
    # Put 0.5 at the lowest cut that is as good as the best one, a quarter into the gap above it.
    z = a * x[:, 0] + b * x[:, 1] + c
    order = np.argsort(z, kind="stable")
    right = np.cumsum(y[order] == 0) + (y.sum() - np.cumsum(y[order] == 1))
    best = int(np.flatnonzero(right == right.max())[0])
    above = z[order][z[order] > z[order][best]]
    low, high = z[order][best], above[0] if len(above) else z[order][best] + 1
    lexicon.curve = (float(a), float(b), float(c - (low + 0.25 * (high - low))))
    return lexicon


def scorer(lexicon: Lexicon):
    """A column function: text to struct(score, hits)."""
    kept: list = []

    @F.pandas_udf("score double, hits int")
    def scored(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(lexicon.matcher())
        score, hits = lexicon.score(texts, kept[0])
        return pd.DataFrame({"score": score, "hits": hits})

    return scored


def score_documents(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct column ``out``: score (0 to 1) and hits."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, scorer(lexicon)(F.col(text_col)))


def predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")
