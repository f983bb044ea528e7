import random
import re
import time

from pyspark.sql import functions as F

from quern.operators import graph, spans


def test_union_and_faults(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 6, 9), ("a", 12, 20), ("b", 3, 3), ("b", 5, 2), ("b", 2, 4), ("c", 0, 4), ("c", -2, 1), ("z", 0, 1), ("d", None, 3)], "k string, lo int, hi int")
    found = sorted((r.k, r.lo, r.hi) for r in spans.union(rows, "k").collect())
    assert found == [("a", 0, 9), ("a", 12, 20), ("b", 2, 4), ("c", -2, 4), ("z", 0, 1)]
    texts = spark.createDataFrame([("a", 18), ("b", 4), ("c", 4), ("d", 3), ("e", 0), ("f", 2)], "k string, length int")
    faults = {(r.k, r.lo, r.hi, r.fault) for r in spans.coverage_faults(rows, texts, "k").collect()}
    assert faults == {("a", 6, 7, "overlap"), ("a", 9, 12, "gap"), ("a", 12, 20, "outside"), ("b", 0, 2, "gap"), ("b", 3, 3, "inverted"), ("b", 5, 2, "inverted"), ("c", -2, 1, "outside"), ("c", 0, 1, "overlap"), ("d", None, 3, "inverted"), ("d", 0, 3, "uncovered"), ("f", 0, 2, "uncovered"), ("z", 0, 1, "unknown")}
    assert spans.coverage_faults(rows.limit(0), texts.limit(0), "k").count() == 0


def test_spans_are_sorted_once_by_bounded_tasks(spark, monkeypatch):
    rng = random.Random(5)
    own = [(rng.randrange(60), rng.choice([None, rng.randrange(-3, 30)]), rng.randrange(0, 40)) for _ in range(700)] + [(None, 1, 2), (70, 5, 5)]
    held = [(k, rng.choice([0, 9, 30])) for k in range(70)] + [(70, 4), (None, 3)]
    rows, texts = spark.createDataFrame(own, "k int, lo int, hi int"), spark.createDataFrame(held, "k int, length int")
    want = []
    for key, n in held:
        mine = sorted((a, b) for k, a, b in own if k is not None and k == key and a is not None and b > a)
        end = 0
        for a, b in mine:
            want += [(key, a, b, "outside")] * (a < 0 or b > n) + [(key, end, a, "gap")] * (a > end) + [(key, a, min(b, end), "overlap")] * (0 <= a < end)
            end = max(end, b)
        want += [(key, end if mine else 0, n, "gap" if mine else "uncovered")] * (n > 0 and (not mine or end < n))
    known = {k for k, _ in held if k is not None}
    want += [(k, a, b, "inverted" if k in known else "unknown") for k, a, b in own if k not in known or a is None or b <= a]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    for most in (1_000_000, 20):
        monkeypatch.setattr(spans, "SORT_ROWS", most)
        found = spans.coverage_faults(rows, texts, "k")
        assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") == 1 and f", {-(-len(own) // 20)})" in found._jdf.queryExecution().executedPlan().toString()  # one window, 20 spans a task


def test_points_outside_equal_brute_force(spark):
    rng = random.Random(2)
    own = [(k, lo := rng.randrange(5000), lo + rng.choice([0, 1, 30, 4000])) for k in range(6) for _ in range(12)]
    points = [(k, rng.randrange(9000), rng.random()) for k in range(7) for _ in range(300)]
    found = spans.outside(spark.createDataFrame(points, "k int, at int, v double"), spark.createDataFrame(own, "k int, lo int, hi int"), "k").collect()
    want = [p for p in points if not any(k == p[0] and lo <= p[1] < hi for k, lo, hi in own)]
    assert sorted(map(tuple, found)) == sorted(want) and 0 < len(want) < len(points)


def test_a_long_text_of_many_tokens_and_spans(spark):
    """A million identifiers and ten thousand spans: pieces meet by bin, not each with each."""
    text = "alpha beta_1 gamma\n" * 333_334
    docs = spark.createDataFrame([(1, text)], "k int, text string")
    exempt = spark.range(10_000).select(F.lit(1).alias("k"), (F.col("id") * 600).alias("lo"), (F.col("id") * 600 + 90).alias("hi"))
    began = time.time()
    uses = spans.deprecated_uses(docs, "k", "text", spark.createDataFrame([("beta_1",), ("beta",), ("gamma",)], "term string"), exempt)
    n = uses.count()
    want = sum(1 for m in re.finditer("beta_1|gamma", text) if not (m.start() % 600 < 90 and m.start() // 600 < 10_000))
    assert n == want and time.time() - began < 60


def test_places_of_terms(spark):
    docs = spark.createDataFrame([(1, "old is\nnot olden\n  old_x old é old"), (2, None), (3, "")], "k int, text string")
    found = [(r.k, r.term, r["at"], r.line, r.col) for r in spans.term_uses(docs, "k", "text", spark.createDataFrame([("old",), ("old",)], "term string")).orderBy("at").collect()]
    assert found == [(1, "old", 0, 1, 1), (1, "old", 25, 3, 9), (1, "old", 31, 3, 15)]
    columns = spark.createDataFrame([("t", "old_id"), ("t", "golden"), ("u", "old")], "table string, column string")
    assert sorted((r.table, r["column"]) for r in spans.deprecated_columns(columns, spark.createDataFrame([("old",)], "term string")).collect()) == [("t", "old_id"), ("u", "old")]


def test_a_walk_runs_no_hop_that_cannot_count(spark):
    edges = spark.createDataFrame([(f"r{k}", f"n{k}", f"n{k + 1}") for k in range(9)] + [("b", "n1", "n3")], "relation_id string, src string, dst string")
    seeds = spark.createDataFrame([("n0",), ("n1",)], "node string")
    whole = sorted(map(tuple, graph.walk(edges, seeds, 9).select("depth", "relation_path", "seed", "at", "path_hash").collect()))
    for most in (1, 2, 4, 7, 100):
        got = graph.walk(edges, seeds, 9, most).collect()
        assert sorted((r.depth, r.relation_path, r.seed, r["at"], r.path_hash) for r in got) == whole[:most]
        assert [r.path_hash for r in got] == sorted(r.path_hash for r in got)
    plan = graph.walk(edges, seeds, 9, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Limit")[0] and plan.count("Union") == 0  # two paths of one hop are enough


def test_paths_are_checked(spark):
    edges = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c")], "relation_id string, src string, dst string")
    paths = spark.createDataFrame([("h1", "a", "r1>r2", "a>b>c"), ("h2", "a", "r1>r9", "a>b>c"), ("h3", "a", "r2", "a>b"), ("h4", "x", "r1", "a>b"), ("h5", "a", "r1>r2", "a>b")], "path_hash string, seed string, relation_path string, node_path string")
    assert {tuple(r) for r in graph.path_faults(paths, edges).collect()} == {("h2", 2, "unknown_relation"), ("h3", 1, "broken"), ("h4", 0, "broken"), ("h5", 2, "broken")}
