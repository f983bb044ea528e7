import json

import pytest

from quern.operators import atlas


def test_an_atlas_is_closed_or_says_where_not(spark, tmp_path):
    doc = {"questions": [{"id": "q1", "evidence_ids": ["e1", "e9"]}], "evidence": [{"id": "e1", "source_ids": ["s1"]}], "sources": [{"id": "s1", "title": "t"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    loaded = atlas.load(spark, str(tmp_path / "a.json"))
    assert [tuple(r) for r in atlas.dangling(loaded).collect()] == [("questions", "q1", "evidence_ids", "e9")]
    moved = atlas.migrate_ids(loaded["questions"], spark.createDataFrame([("q1", "Q1"), ("e1", "E1")], "old string, new string"), ["id"], ["evidence_ids"])
    assert [(r.id, r.evidence_ids) for r in moved.collect()] == [("Q1", ["E1", None])]


def test_budgets_admit_in_order():
    objects = [{"id": "a", "evidence_ids": ["1", "2"]}, {"id": "b", "evidence_ids": ["3", "4"]}, {"id": "c", "evidence_ids": ["2"]}, {"id": "d", "evidence_ids": ["5"]}]
    assert atlas.admit(objects, {"5": ["x"], "1": ["y"]}, 3, 1) == (["a", "c"], [("b", "evidence_budget"), ("d", "source_budget")])


def test_connector_packets_never_truncate(spark):
    rows = spark.createDataFrame([("e1", "context", 1), ("e2", "claim", 2), ("e3", "claim", 1)], "id string, role string, rank int")
    ordered, missing = atlas.connector_packet(rows, ["claim", "context", "counter"], 3)
    assert [r.id for r in ordered.collect()] == ["e3", "e2", "e1"] and missing == ["counter"]
    with pytest.raises(ValueError):
        atlas.connector_packet(rows, ["claim"], 2)


def test_candidates_are_ranked_per_channel(spark):
    rows = spark.createDataFrame([("l", "q1", 0.9), ("l", "q1", 0.8), ("l", "q2", 0.9), ("s", "q1", 0.1)], "channel string, question_id string, score double")
    assert [(r.question_id, r.rank) for r in atlas.route_candidates(rows, 0.5, 5).orderBy("rank").collect()] == [("q1", 1), ("q2", 2)]


def test_trace_faults(spark):
    steps = spark.createDataFrame([(1, 1, "extract", []), (1, 2, "compare", [1]), (1, 3, "infer", [3]), (1, 4, "infer", [2])], "trace_id int, step_no int, operation string, premises array<int>")
    found = {tuple(r) for r in atlas.trace_faults(steps, spark.createDataFrame([(1, 4)], "trace_id int, step_no int")).collect()}
    assert found == {(1, 2, "shape"), (1, 3, "premise_not_earlier")}
