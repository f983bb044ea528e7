import math
import random
from collections import Counter, defaultdict

import numpy as np

from quern.operators import mining, topics


def dense(matrix, k, rounds=400):
    """Factors of a dense matrix by multiplicative updates from its singular vectors, as a yardstick."""
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    w, h = np.zeros((matrix.shape[0], k)), np.zeros((k, matrix.shape[1]))
    for j in range(k):
        best = max(((np.maximum(g * u[:, j], 0), np.maximum(g * vt[j], 0)) for g in (1, -1)), key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        w[:, j], h[j] = best[0] * np.sqrt(s[j]), best[1] * np.sqrt(s[j])
    w[w < 1e-9], h[h < 1e-9] = matrix.mean(), matrix.mean()
    for _ in range(rounds):
        h *= (w.T @ matrix) / (w.T @ w @ h + 1e-12)
        w *= (matrix @ h.T) / (w @ (h @ h.T) + 1e-12)
    return w, h


def frame(spark, m):
    return spark.createDataFrame([(i, f"t{j:02}", float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j] > 0], "key int, term string, weight double").repartition(3)


def test_two_topics(spark):
    m = np.array([[3, 2, 0, 0], [2, 3, 0, 0], [0, 0, 4, 3], [0, 0, 3, 4]], float)
    found = topics.factorize(frame(spark, m), "key", 2)
    best = {r.key: r.component for r in sorted(found.loadings.collect(), key=lambda r: r.loading)}
    assert found.residual < 0.06 and best[0] == best[1] != best[2] == best[3] and found.terms == ["t00", "t01", "t02", "t03"]


def test_factors_are_as_near_as_a_dense_run(spark):
    """The residual is within two hundredths of that of dense updates, and is what the factors leave."""
    rng = np.random.default_rng(3)
    for rows, terms, k in [(60, 40, 5), (150, 25, 4)]:
        m = rng.gamma(0.4, 1, (rows, 6)) @ rng.gamma(0.3, 1, (6, terms)) * (rng.random((rows, terms)) < 0.4)
        m[m.sum(axis=1) == 0, 0] = 0.5
        found = topics.factorize(frame(spark, m), "key", k)
        w, h = dense(m, k)
        error = lambda w, h, m=m: np.linalg.norm(m - w @ h) / np.linalg.norm(m)
        own = np.zeros((rows, k))
        for r in found.loadings.collect():
            own[r.key, r.component] = r.loading
        names = {t: i for i, t in enumerate(found.terms)}
        wide = np.zeros((k, terms))
        for t, i in names.items():
            wide[:, int(t[1:])] = found.weights[:, i]
        assert error(own, wide) <= error(w, h) * 1.02 and abs(error(own, wide) ** 2 - found.residual) < 1e-3
        assert (own >= 0).all() and (wide >= 0).all()


def test_bounds_and_empty_matrices(spark):
    m = np.eye(3)
    assert len(topics.factorize(frame(spark, m), "key", 9).weights) == 2  # rows less one
    none = topics.factorize(frame(spark, m).limit(0), "key", 3)
    assert none.loadings.count() == 0 and none.terms == []


def test_concepts_are_named_held_and_linked(spark):
    rng = random.Random(5)
    themes = [["lime", "mortar", "brick", "kiln"], ["sail", "harbour", "tide", "rope"], ["seed", "plough", "barley", "soil"]]
    docs = [(i, f"s{i % 5}", " ".join(rng.choice(themes[i % 3] + (themes[(i + 1) % 3][:1] if i % 6 == 0 else [])) for _ in range(12))) for i in range(90)]
    frame_ = spark.createDataFrame(docs, "doc_id int, source string, text string")
    asked = spark.createDataFrame([(1, "lime mortar in brick"), (2, "the tide and the harbour")], "q int, text string")
    found = topics.concept_map(frame_, "doc_id", "text", "source", asked, "text", ["the", "and", "in"], k=3, per_component=4, edge_evidence=3)
    concepts = {r.concept: r for r in found.concepts.collect()}
    texts = {i: t for i, _, t in docs}
    holds = lambda c: {i for i, t in texts.items() if f" {c} " in f" {t} "}
    assert len(concepts) >= 6 and len({r.component for r in concepts.values()}) == 3 and {r.origin for r in concepts.values()} == {"scope_anchor", "emergent"}
    assert all(r.df == len(holds(c)) and r.df >= 3 for c, r in concepts.items())
    assert not any(a != b and a in b for a in concepts for b in concepts)
    homes = defaultdict(set)
    for c, r in concepts.items():
        homes[r.component] |= {k for k, words in enumerate(themes) if any(w in c.split() for w in words)}
    assert sorted(len(x) for x in homes.values())[0] == 1
    sources = {i: s for i, s, _ in docs}
    for e in found.edges.collect():
        both = holds(e.left) & holds(e.right)
        assert e.shared == len(both) and e.sources == len({sources[i] for i in both}) >= 2
        assert set(e.evidence) <= both and len(e.evidence) <= 3 and len({sources[i] for i in e.evidence}) == len(e.evidence)
    per = defaultdict(list)
    for r in found.evidence.collect():
        per[r.concept].append(r.key)
    assert all(len(x) <= 5 and set(x) <= holds(c) for c, x in per.items())


def test_terms_that_tie_and_texts_without_words(spark):
    docs = [(k, "alpha beta gamma" if k % 2 else "beta gamma delta") for k in range(8)] + [(9, None), (10, ""), (11, "alpha beta gamma " * 30)]
    rows = mining.tfidf(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", [], min_df=2, max_df=1.0, features=4).collect()
    assert {r.term for r in rows} == {"beta", "beta gamma", "gamma", "alpha"}
    norm = defaultdict(float)
    for r in rows:
        norm[r.doc_id] += r.weight**2
    assert all(abs(x - 1) < 1e-9 for x in norm.values()) and 9 not in norm


def test_counts_of_terms_keep_what_plain_counting_keeps(spark):
    rng = random.Random(11)
    words = [f"w{min(int(rng.expovariate(0.15)), 40)}" for _ in range(9000)]
    docs = [(k, " ".join(words[k * 30 : k * 30 + rng.randint(0, 30)]) if k % 17 else None) for k in range(300)]
    grams = {k: Counter(" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)) for k, t in docs for ws in [[w for w in (t or "").split() if w != "w1"]]}
    df, cf = Counter(), Counter()
    for per in grams.values():
        df.update(per.keys())
        cf.update(per)
    for features in (25, 150, 100_000):
        vocabulary = sorted((t for t in cf if 3 <= df[t] <= 0.3 * len(docs)), key=lambda t: (-cf[t], t))[:features]
        want = {}
        for k, per in grams.items():
            raw = {t: (1 + math.log(per[t])) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in vocabulary if t in per}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            want |= {(k, t): x / norm for t, x in raw.items()}
        frame = spark.createDataFrame(docs, "k int, text string").repartition(5)
        rows, terms = mining.weighed(frame, "k", "text", ["w1"], max_df=0.3, features=features)
        assert terms == sorted(vocabulary)
        got = {(r.k, terms[e.t]): e.x for r in rows.collect() for e in r.entries}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
        assert {(r.k, r.term) for r in mining.tfidf(frame, "k", "text", ["w1"], max_df=0.3, features=features).collect()} == want.keys()


def test_phrases_are_found_without_a_row_for_every_run_of_words(spark):
    docs = [(1, "A b c, d a b", "x"), (2, None, None), (3, "a  b-c", "y"), (4, "", "x"), (5, "b", None)]
    phrases = ["a b", "a b c", "b", "A b", "a  b", "", None, "a b c d", "d a", "c"]
    frame = spark.createDataFrame(docs, "k int, text string, source string")
    found = mining.occurrences(spark.createDataFrame([(p,) for p in [*phrases, "b"]], "phrase string"), frame, "k", "text", "source")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [(p, k, s) for k, s, ps in [(1, "x", ["a b", "a b c", "b", "d a", "c"]), (3, "y", ["a b", "a b c", "b", "c"]), (5, None, ["b"])] for p in ps]))
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_counted_by_source_and_not_by_fragment(spark):
    """As distinct counts over all pairs of rows, with fragments of several sources, repeated rows and nulls."""
    rng = random.Random(4)
    rows = [(rng.choice("abcde"), rng.choice([*range(12), None]), rng.choice(["s", "t", None])) for _ in range(120)]
    found = mining.pairs(spark.createDataFrame(rows, "concept string, fragment int, source string").repartition(3)).collect()
    shared, sources, first = defaultdict(set), defaultdict(set), {}
    for c, f, s in rows:
        for d, g, _ in rows:
            if f is not None and f == g and c < d:
                shared[c, d].add(f), sources[c, d].add(s)
                first[c, d, s] = min(f, first.get((c, d, s), f))
    counted = Counter()
    for r in found:
        counted[r.left, r.right] += r.shared
    assert counted == {k: len(v) for k, v in shared.items()} and {(r.left, r.right, r.source): r.first for r in found} == first and len(found) == len(first)
    linked = {(r.left, r.right): (r.shared, r.sources) for r in mining.linked(mining.pairs(spark.createDataFrame(rows, "concept string, fragment int, source string")), 1).collect()}
    assert linked == {k: (len(v), len(sources[k] - {None})) for k, v in shared.items()}


def test_documents_of_a_phrase_with_and_without_repeated_keys(spark):
    phrases = spark.createDataFrame([("a b",), ("c",), ("x",)], "phrase string")
    rows = [(1, "a b c a b", "s"), (2, "c", None), (3, "b a", "t"), (None, "c", "t")]
    for more, df in (([], 2), ([(1, "c c", "u")], 2)):
        docs = spark.createDataFrame(rows + more, "k int, text string, source string")
        found = {r.phrase: (r.df, r.sources) for r in mining.spread(*mining.held(phrases, docs, "k", "text", "source"), "k", "source").collect()}
        assert found == {"a b": (1, 1), "c": (df, 2 + len(more))}


def test_a_pass_over_the_matrix_has_no_more_tasks_than_cores(spark, monkeypatch):
    """Each task sends a row for each term, so tasks that grew with the rows would shuffle ever more."""
    seen, sums = [], topics._sums
    monkeypatch.setattr(topics, "_sums", lambda rows, m, solve: seen.append(rows.rdd.getNumPartitions()) or sums(rows, m, solve))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        topics.factorize(frame(spark, np.random.default_rng(1).random((400, 9))).repartition(40), "key", 2, rounds=2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism
