import random

import numpy as np
import pytest

from quern.llm import near_dedup, substring_dedup
from quern.llm import words as W
from quern.llm.fm_index import FMIndex
from tests.llm import brute


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(6)]
    docs = [(k, t) for k, t in enumerate(base)]
    for k in range(60):  # a family of near copies, some far from one another
        w = base[0].split()
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary) + "x" * rng.randint(0, 2)
        docs.append((100 + k, " ".join(w)))
    docs += [(200, base[1]), (201, base[1].upper()), (202, None), (203, ""), (204, " \n\t"), (205, "one"), (206, "ONE"), (207, "one two"), (208, base[2] + " " + base[2])]
    docs += [(209, base[3][:300] + "\n" + base[4][200:]), (210, " ".join(rng.choice(vocabulary) for _ in range(6000)))]
    return docs


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    docs = corpus()
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, component_id string, rep int")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(rows, n).collect()}
    assert found == brute.near(docs, n)


@pytest.mark.parametrize("reach", ["neither", "one"])
def test_near_duplicates_that_share_only_buckets_of_an_unlike_pivot(spark, reach, monkeypatch):
    if reach == "one":
        monkeypatch.setattr(near_dedup, "BLOCK", 8)
    hashes = lambda words: near_dedup.shingles(W.cut(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]), lower=True).hashes, 1)
    x = [f"v{k}" for k in range(200)]
    y = x[:180] + [f"y{k}" for k in range(20)]
    one = np.array([near_dedup.minima(hashes([w])) for w in x[:180]])
    least_x, least_y = near_dedup.minima(hashes(x)), near_dedup.minima(hashes(y))
    shared = (least_x == least_y).reshape(near_dedup.BANDS, near_dedup.ROWS).all(axis=1)
    own = sorted({int(np.flatnonzero(one[:, k] == least_x[k])[0]) for b in np.flatnonzero(shared) for k in range(b * near_dedup.ROWS, (b + 1) * near_dedup.ROWS)})
    hub = [x[k] for k in own]  # a hub that shares every band that x and y share, and is unlike one or both of them
    if reach == "one":
        hub += y[180:] + [w for w in x[:180] if w not in hub][: 110 - len(hub)]
    docs = [(1, " ".join(x)), (2, " ".join(y))] + [(10 + k, " ".join(hub + [f"h{k}"])) for k in range(30)]
    sims = [len({*t} & {*hub}) / len({*t} | {*hub}) for t in (x, y)]
    assert shared.sum() > 3 and sims[0] < 0.54 and (sims[1] > 0.62 if reach == "one" else sims[1] < 0.54)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1).collect()}
    assert found == brute.near(docs, 1) and found[2][1] == 1


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c"), (3, None), (5, "a b c"), (5, "a b c"), (4, "a b c")], schema), 2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False)]


def test_a_large_family_in_many_blocks(spark, monkeypatch):
    """Several thousand near copies, some far from the pivot: every block of a group has the pivot's set first."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for k in range(2500):
        w = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 2, 3, 12])):
            w[at] = rng.choice(vocabulary)
        docs.append((k, " ".join(w)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), 1).collect()}
    assert found == brute.near(docs, 1) and len({c for _, c in found.values()}) > 10


def test_repeated_ids_with_other_texts(spark):
    long = " ".join(f"v{k}" for k in range(50))
    rows = [(1, long), (1, "p q r s"), (2, long + " x"), (3, "p q r s"), (3, "p q r s")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(found) == 5 and {r.component_id for r in found if r.doc_id == 3} == {1}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.id: r.root for r in near_dedup.components(edges).collect()}
    assert all(found[k] == 0 for k in range(1, 41)) and found[101] == 100


def test_compare_finds_links_the_pivot_misses():
    import pandas as pd

    rows, base = [], np.arange(100, dtype=np.uint64)
    for i, (gone, extra) in enumerate([(0, 0), (15, 15), (15, 15), (18, 40)]):
        shared = np.ones(100, bool)
        shared[:gone] = False
        rows.append((1, 10 + i, gone == 0, 100 - gone + extra, np.packbits(shared).tobytes(), (1000 + np.arange(extra)).astype(np.uint64).tobytes()))
    pairs = near_dedup._compare(80)(pd.DataFrame(rows, columns=["pivot", "id", "linked", "size", "shared", "extra"]))
    assert base.size == 100 and {tuple(sorted(p)) for p in pairs.itertuples(index=False)} >= {(11, 12)}


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup_equals_brute_force(spark, hot, monkeypatch):
    if hot:  # deal the windows of nearly every anchor out one by one, and join anchors instead of broadcasting them
        monkeypatch.setattr(substring_dedup, "ANCHOR_SEGMENTS", 1)
        monkeypatch.setattr(substring_dedup, "ANCHOR_ROWS", 0)
    docs = corpus(2)
    rows = spark.createDataFrame([(i, t, "x", [2]) for i, t in docs], "doc_id long, text string, n_removed string, spans array<int>")
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(rows).collect())
    assert found == sorted(brute.repeats(docs, 35))


def test_substring_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert substring_dedup.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"v{k}" for k in range(40))
    docs = [(1, long), (1, long), (None, None), (2, "a " * 34 + "a"), (3, "b " * 36)]
    found = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, schema)).collect())
    assert found == sorted((i or 0, *x) for i, *x in brute.repeats(docs, 35))


def test_fm_index_counts_like_a_scan():
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 5, rng.integers(3, 40)) for _ in range(30)]
    weights = rng.integers(1, 3, 30)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    index = FMIndex(np.concatenate(texts), first, weights, 41)
    stretches = {(t, k) for t, a, b in index.repeated(np.concatenate(texts), first, 6) for k in range(a, b - 5)}
    count = {}
    for t, w in zip(texts, weights, strict=True):
        for k in range(len(t) - 5):
            key = tuple(t[k : k + 6])
            count[key] = count.get(key, 0) + w
    assert stretches == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 5) if count[tuple(t[k : k + 6])] > 1}
