import random

import pytest
from pyspark.sql import functions as F

from quern.operators import preparation, scope
from quern.sources import blobs

ASSESSED = "case_id string, key string, candidate_id int, rank long, independence_group string, codes array<string>"


def test_compact_sets_are_ready_and_minimal(spark):
    rng = random.Random(3)
    rows = [(c, k, i, i, f"g{rng.randint(0, 3)}", [] if rng.random() < 0.7 else ["x"]) for c in "abcdef" for i in range(8) for k in ("p", "q")]
    needs = {"p": 2, "q": 1}
    assessed = spark.createDataFrame(rows, ASSESSED)
    cases = spark.createDataFrame([(c, True, 2) for c in "abcdef"], "case_id string, in_corpus boolean, min_total int")
    requirements = spark.createDataFrame([(c, k, n) for c in "abcdef" for k, n in needs.items()], "case_id string, key string, min_groups int")
    decided, kept = preparation.prepare(cases, requirements, assessed, assessed.limit(0))

    def ready(case, ids):
        groups = {k: {g for c, q, i, _, g, x in rows if c == case and q == k and i in ids and not x} for k in needs}
        return all(len(groups[k]) >= n for k, n in needs.items()) and len(set().union(*groups.values())) >= 2

    found = {c: {r.candidate_id for r in kept.collect() if r.case_id == c} for c in "abcdef"}
    for r in decided.collect():
        assert (r.decision == "ready") == ready(r.case_id, set(range(8)))
        if r.decision == "ready":
            assert ready(r.case_id, found[r.case_id])
            assert not any(ready(r.case_id, found[r.case_id] - {i}) for i in found[r.case_id])


def test_cases_without_candidates_are_insufficient_and_drilled(spark):
    cases = spark.createDataFrame([("a", True, 1), ("b", False, 1)], "case_id string, in_corpus boolean, min_total int")
    requirements = spark.createDataFrame([("a", "k", 1), ("b", "k", 1)], "case_id string, key string, min_groups int")
    none = spark.createDataFrame([], ASSESSED)
    local = spark.createDataFrame([("a", "k", 5, 1, "g", []), ("b", "k", 6, 1, "g", [])], ASSESSED)
    decided, kept = preparation.prepare(cases, requirements, none, local)
    assert {tuple(r) for r in decided.select("case_id", "drilled", "decision").collect()} == {("a", True, "ready"), ("b", False, "gap_preserved")}
    assert [tuple(r) for r in kept.collect()] == [("a", 5, 1)]


def test_eligible_ranks_have_no_gaps(spark):
    rows = spark.createDataFrame([("a", 1, 4, [], "x", None), ("a", 2, 9, [], "x", "x"), ("a", 3, 6, ["noise"], "y", "z"), ("b", 4, 2, [], None, None)], "case_id string, candidate_id int, rank int, reasons array<string>, kind string, role string")
    found = {r.candidate_id: (r.rank, r.tags) for r in preparation.eligible(rows, ["kind", "role"]).collect()}
    assert found == {1: (1, ["x"]), 2: (2, ["x"]), 4: (1, [])}


def test_blobs_are_stored_once_and_verified(spark, tmp_path):
    root, texts = f"file://{tmp_path}/store", ["one", "two", "one", "", None, "x" * 100_000]
    (tmp_path / "store").mkdir()
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    first = blobs.promote(rows, root).collect()
    assert len(first) == 4 and all(r.created for r in first) and sum(r.bytes for r in first) == 100_006
    again = blobs.promote(rows, root)
    assert not any(r.created for r in again.collect())
    assert blobs.verify(again, root).isEmpty()
    one, two = (tmp_path / "store" / r.relative_path for r in sorted(first, key=lambda r: r.bytes)[1:3])
    records = again.cache()
    records.count()
    one.write_bytes(b"own")
    two.unlink()
    assert sorted(r.fault for r in blobs.verify(records, root).collect()) == ["altered", "missing"]


def test_identity_manifests_map_every_file_once(spark):
    files = spark.createDataFrame([("a",), ("b",)], "relative_path string")
    declared = spark.createDataFrame([("a", 1), ("b", 1)], "relative_path string, logical_id int")
    assert {tuple(r) for r in scope.identified(files, declared).collect()} == {("a", 1), ("b", 1)}
    for wrong in (declared.filter("relative_path = 'a'"), declared.unionByName(declared.filter("relative_path = 'a'")), declared.unionByName(declared.limit(1).withColumn("relative_path", F.lit("c")))):
        with pytest.raises(ValueError):
            scope.identified(files, wrong)
