import pytest

from quern.operators import answers, review
from quern.sources import bundles


def test_segments_cover_the_text(spark):
    texts = spark.createDataFrame([(1, "hello brave world"), (2, "bare"), (3, "")], "id int, text string")
    spans = spark.createDataFrame([(1, 6, 11, "traced")], "id int, start int, end int, kind string")
    found = sorted((r.id, r.start, r.end, r.kind, r.part) for r in answers.segments(texts, spans).collect())
    assert found == [(1, 0, 6, "plain", "hello "), (1, 6, 11, "traced", "brave"), (1, 11, 17, "plain", " world"), (2, 0, 4, "plain", "bare")]


def test_case_sets_keep_claims_without_evidence(spark):
    claims = spark.createDataFrame([("c1", ["e1", "e2"]), ("c2", [])], "claim_id string, evidence_ids array<string>")
    citations = spark.createDataFrame([("e1", "s1", "quoted"), ("e2", "s2", "absent")], "evidence_id string, source_id string, quote string")
    evidence = spark.createDataFrame([("e1", "a quoted text"), ("e2", "other")], "evidence_id string, text string")
    rows = {r.claim_id: r for r in answers.case_set(claims, citations, evidence).collect()}
    assert [(c.evidence_id, c.exact) for c in rows["c1"].cases] == [("e1", True), ("e2", False)] and rows["c2"].cases is None


def test_graph_stays_within_its_nodes():
    assert answers.bounded_graph([("r2", "b", "c"), ("r1", "a", "b"), ("r3", "d", "e")], ["a", "z"], 4) == (["a", "b", "c", "z"], ["r1", "r2"])
    assert answers.drilldown_terms(["x", "y"], ["y", "z"], 2) == ["x", "y"]


def test_resolution_needs_all_collections(spark):
    decisions = spark.createDataFrame(
        [(1, None, "t1", "u", "accept", ["c1"]), (2, None, "t1", "u", "reject", ["c2"]), (3, None, "t2", "u", "accept", ["c1"]), (4, None, "t3", "u", "accept", ["c1", "c2"]), (5, 4, "t3", "u", "defer", ["c1", "c2"])],
        "decision_id int, supersedes_id int, target_id string, use string, action string, scope array<string>",
    )
    targets = spark.createDataFrame([(t, ["c1", "c2"]) for t in ("t1", "t2", "t3")], "target_id string, collections array<string>")
    assert [r.target_id for r in review.resolved(decisions, targets).collect()] == ["t1"]
    assert [r.target_id for r in review.admission(decisions, ["c1"]).orderBy("target_id").collect()] == ["t1", "t2"]
    assert review.refused(10, 10) and review.refused(1000, 5000) == "backlog_needs_override" and review.refused(1000, 5000, True) is None


def test_bundles_are_verified_before_they_are_restored(spark, tmp_path):
    tables = {"a": spark.range(5), "b": spark.createDataFrame([("x", None)], "t string, n int")}
    bundles.create(tables, str(tmp_path / "b"))
    assert sorted(r.id for r in bundles.restore(spark, str(tmp_path / "b"))["a"].collect()) == [0, 1, 2, 3, 4]
    spark.range(1).write.mode("append").parquet(str(tmp_path / "b" / "a"))
    assert [r.name for r in bundles.verify(spark, str(tmp_path / "b")).collect()] == ["a"]
    with pytest.raises(ValueError):
        bundles.restore(spark, str(tmp_path / "b"))
