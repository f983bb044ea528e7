"""Spelling variants: words that differ by one code point, found through letter-parity bitmask bands.

1. `vocabulary` counts the words of all texts.
2. A word's mask has one bit per letter, set if the letter occurs an odd number of times. One inserted or
   deleted code point flips one bit, a replaced one two or none. The mask is split into three bands, so
   two near words agree on at least one. Words with equal bands and lengths that differ by one at most are
   candidates; masks that differ in over two bits are passed by, and the rest is verified on full words.
3. A bucket with over `MOST` words is not compared as a whole: its words are dealt out twice, by the first
   and by the last half of the code points that may still differ. One edit leaves one of the halves as it
   is, so no near pair is lost. Halving goes on while a bucket is large and a code point is left to halve,
   which ends with buckets whose size the alphabet bounds. No pair of a large bucket is emitted for its own sake.
4. `variants` picks each word's form and follows forms to the root. A form is at least `RATIO` times as
   frequent as its word, so a chain has at most log(largest count) steps, and pointers are doubled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import cut, forget, small

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
BITS = 63
BANDS = 3
#: The bits of each band, neighbours in the alphabet in different ones.
BAND_MASKS = [sum(1 << b for b in range(BITS) if b % BANDS == k) for k in range(BANDS)]
#: Words of a bucket that are compared with one another before it is halved.
MOST = 64

_UPPER = "".join(map(chr, range(65, 91)))


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def runs(text: Column, least: int = 1) -> Column:
    """Maximal runs of letters of at least `least` code points, in lower case (A-Z only); none for null."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), f"[^{LETTERS}]+"), lambda w: F.char_length(w) >= max(1, least))
    return F.transform(found, lower_ascii)


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of the column `word` with at least so many code points and occurrences."""
    long = words.filter(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def mask(word: Column) -> Column:
    """Bit by letter: set if the letter occurs an odd number of times. Accented letters share bits 26 to 62."""
    code = lambda c: F.ascii(c)
    bit = lambda c: F.when(code(c) <= 122, code(c) - 97).otherwise(26 + F.pmod(code(c) - 192, F.lit(BITS - 26)))
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).cast("int"))))


def _key(band: Column, bits: Column, size: Column, head: Column, tail: Column, length: Column) -> Column:
    """A bucket's name: band and its bits, length of the pair's shorter word, and the code points at either end that agree."""
    return F.xxhash64(band, bits, size, head, tail, F.substring(F.col("word"), F.lit(1), head), F.substring(F.col("word"), length - tail + 1, tail))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", _key(F.col("band"), F.col("bits"), F.col("size"), F.col("head"), F.col("tail"), F.char_length("word").cast("int")))


def _pairs(rows: DataFrame) -> DataFrame:
    """Near pairs within buckets, found at the first band on which the pair agrees."""
    a, b = rows.alias("a"), rows.alias("b")
    differ = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    longer = F.char_length("b.word") == F.col("a.size") + 1
    ordered = longer | ((F.char_length("b.word") == F.col("a.size")) & (F.col("a.word") < F.col("b.word")))
    first_band = F.lit(True)
    for k in range(1, BANDS):
        for earlier in range(k):
            first_band &= (F.col("a.band") != k) | (differ.bitwiseAND(F.lit(BAND_MASKS[earlier])) != 0)
    near = (F.bit_count(differ) <= 2) & first_band & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    met = (F.col("a.key") == F.col("b.key")) & (F.char_length("a.word") == F.col("a.size")) & ordered & near
    return a.join(b, met).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def near_pairs(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """a, a_n, b, b_n: every pair of words that one inserted, deleted or replaced code point tells apart, once."""
    words = vocabulary.select("word", "n", mask(F.col("word")).alias("mask"))
    length = F.char_length("word").cast("int")
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.col("mask").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(BAND_MASKS)])
    sizes = F.array(length, length - 1)  # the word as the pair's shorter one (or one of equals), and as its longer one
    rows = words.select("word", "n", "mask", F.explode(bands).alias("x")).select("word", "n", "mask", "x.*", F.explode(sizes).alias("size"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    found, rows, spent = [], cut(_placed(rows), "banded"), []
    while True:
        counted = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > most).select("key"), "large")
        spent += [rows, counted]
        n = counted.count()
        open_ = F.col("size") - F.col("head") - F.col("tail")
        if not n:
            found.append(_pairs(rows))
            break
        tagged = rows.join(small(counted.withColumn("large", F.lit(True)), n), "key", "left")
        halved = F.col("large").isNotNull() & (open_ > 1)
        found.append(_pairs(tagged.filter(~halved).drop("large")))
        half = F.floor(open_ / 2).cast("int")
        sides = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + open_ - half).alias("tail")))
        rows = tagged.filter(halved).select("word", "n", "mask", "band", "bits", "size", F.explode(sides).alias("x")).select("word", "n", "mask", "band", "bits", "size", "x.*")
        rows = cut(_placed(rows), "halved")
        if not rows.take(1):
            spent.append(rows)
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = cut(out.distinct(), "near-words")
    for table in spent:
        forget(table)
    return out


def variants(vocabulary: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of a vocabulary (word, n).

    A word's form is its near word of largest n, the smallest in code-point order among equals, if that n
    is at least `ratio` times the word's; root follows forms to the last one, and is the word itself where
    there is none. An empty vocabulary gives no rows. Words are expected once each and not null.
    """
    words = cut(vocabulary.select("word", "n"), "vocabulary")
    pairs = near_pairs(words, most)
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    best = cut(best.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    at = best.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    top = words.agg(F.max("n")).first()[0] or 1
    for _ in range(max(1, math.ceil(math.log2(math.log(max(top, 2), ratio) + 1)))):
        at = cut(at.alias("x").join(at.alias("y"), F.col("x.root") == F.col("y.word"), "left").select("x.word", F.coalesce("y.root", "x.root").alias("root")), "roots")
    rows = words.join(best, "word", "left").join(at, "word", "left")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
