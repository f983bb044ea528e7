import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import spelling


def near(a, b):
    """Whether one code point inserted, deleted or replaced tells the words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio=5):
    near_ = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near_[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n, len(near_[w]), form[w], counts[form[w]] if form[w] else None, root(w)) for w, n in counts.items()}


def words(rng, n):
    letters = "abcdefgéèïstx÷"
    out = set()
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        out.add(w)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(w))
            out.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    return out


@pytest.mark.parametrize("most", [2, 64])
def test_variants_equal_brute_force(spark, most):
    """Also where every bucket of over two words is halved."""
    rng = random.Random(4)
    counts = {w: rng.choice([5, 6, 9, 30, 31, 160, 900]) for w in words(rng, 700)}
    counts |= {"abcdef" + "x" * 40 + c: 5 for c in "abcdefghij"} | {c + "abcdef" + "x" * 40: 6 for c in "abcdefghij"}  # one half equal in all
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), most=most)
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect()} == brute(counts)


def test_chains_of_forms(spark):
    counts = {"abcdefg": 5, "abcdef": 25, "abcdex": 125, "abcdxx": 625, "zzzzzz": 7, "abcdxy": 625}
    found = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert found["abcdefg"] == ("abcdef", "abcdxx") and found["abcdex"] == ("abcdxx", "abcdxx") and found["zzzzzz"] == (None, "zzzzzz")


def test_runs_of_letters(spark):
    texts = [None, "", "Éa1bÀ", "ABC-def×G", "naïveİSTANBUL", "q" * 50_000, "x\U0001f600y"]
    rows = spark.createDataFrame([(k, t, "w") for k, t in enumerate(texts)], "doc_id long, text string, word string")
    found = [r.r for r in rows.orderBy("doc_id").select(spelling.runs(F.col("text")).alias("r")).collect()]
    assert found == [[], [], ["Éa", "bÀ"], ["abc", "def×g"], ["naïve", "stanbul"], ["q" * 50_000], ["x", "y"]]


def test_vocabulary_counts_and_floors(spark):
    rows = ["abcdef"] * 5 + ["abcde"] * 9 + ["ghijkl"] * 4 + [None] * 3
    found = spelling.vocabulary(spark.createDataFrame([(w,) for w in rows], "word string")).collect()
    assert [(r.word, r.n) for r in found] == [("abcdef", Counter(rows)["abcdef"])]


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
