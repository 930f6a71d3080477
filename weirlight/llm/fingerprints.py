"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit codes.

A text's shingles of ``n`` words are hashed once. The top bits of a hash name its bin, and a bin keeps
its least hash. An empty bin takes over the hash of a filled bin that is drawn by a hash of the pair
(empty bin, try) until it is filled, which is optimal densification; after ``PROBES`` tries, the filled
bin of least hash with the empty one is taken, which has the same distribution. The low ``BITS`` bits of each bin make one hex digit of the fingerprint. Two bins agree
by chance with probability 2**-BITS, which the estimate of likeness takes out.

Cases: null counts as the empty text. Texts of fewer than ``n`` words have one shingle, all their words.
A text without words has the fingerprint ``NO_WORDS``; two such texts are alike (1), one such and
another are not (0). Equal texts have equal fingerprints; text case and punctuation count, the kind
and number of white space between words do not. Texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, with_next, words_of

BINS, BITS, NO_WORDS = 256, 4, "-"
#: Draws by hash for an empty bin before every filled bin is weighed.
PROBES = 16


def shingle_hashes(words: Column, n: int = 5) -> Column:
    """64-bit hashes of all runs of n words, of all words together if they are fewer; none if no word."""

    def of(hashes: Column) -> Column:
        count = F.size(hashes)
        runs = F.transform(F.sequence(F.lit(0), count - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))
        return F.when(count >= n, runs).when(count > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column, n: int = 5) -> Column:
    """BINS hex digits, or NO_WORDS."""
    shift = 64 - (BINS.bit_length() - 1)
    bin_of = lambda h: F.shiftright(h, shift) + BINS // 2
    digits = F.lit(list("0123456789abcdef"))

    bins = F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint"))

    def codes(least: Column) -> Column:
        own = F.map_from_arrays(F.transform(least, bin_of), least)

        def digits_of(filled: Column) -> Column:
            def drawn(b: Column) -> Column:
                # A few draws by hash find a filled bin where many are; where few are, each gets a draw and the least wins.
                tries = [F.get(filled, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
                lots = F.transform(least, lambda h: F.struct(F.xxhash64(b, bin_of(h)).alias("draw"), h.alias("h")))
                return F.coalesce(*tries, F.array_min(lots)["h"])

            def digit(h: Column, b: Column) -> Column:
                return F.get(digits, F.coalesce(h, drawn(b)).bitwiseAND(F.lit(2**BITS - 1)).cast("int"))

            return F.array_join(F.transform(filled, digit), "")

        return let(let(own, lambda m: F.transform(bins, lambda b: F.try_element_at(m, b))), digits_of)

    def least_of(ordered: Column) -> Column:
        first = F.filter(ordered, lambda h, i: (i == 0) | (F.shiftright(h, shift) != F.shiftright(F.get(ordered, i - 1), shift)))
        return F.when(F.size(ordered) == 0, F.lit(NO_WORDS)).otherwise(let(first, codes))

    return let(F.sort_array(shingle_hashes(words_of(text), n)), least_of)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' texts, 0 to 1, free of chance agreement."""
    chance = 2.0**-BITS
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))
    share = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    either = (a == NO_WORDS) | (b == NO_WORDS)
    return F.when(a == b, F.lit(1.0)).when(either, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), share))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last half (rounded down, in code points) replaced by the
    first as many code points of the next row's text in descending id order, in a ring. Rows of equal
    id follow by a hash of their text; null ids come last.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie")).withColumn("fingerprint", fingerprint(F.col("text")))
    placed = with_next(own, "id", "tie", ["text", "fingerprint"])
    n = F.length("text")
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    out = placed.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
