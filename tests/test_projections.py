import json

import pytest
from pyspark.sql import functions as F

from quern.operators import projections


def test_projection_loads_only_bound_and_closed(spark, tmp_path):
    atlas = {"sources": spark.createDataFrame([("s1",)], "id string"), "questions": spark.createDataFrame([("q1",)], "id string")}
    path = tmp_path / "p.json"
    doc = {"case_id": "c", "base_manifest_hash": "h", "materials": [{"id": "m", "source_id": "s1"}], "themes": [{"id": "t", "question_ids": ["q1"]}]}
    path.write_text(json.dumps(doc))
    found = projections.load_projection(spark, str(path), "c", "h", atlas)
    assert found["materials"].count() == 1 and found["periods"].isEmpty()
    with pytest.raises(ValueError, match="another"):
        projections.load_projection(spark, str(path), "c", "other", atlas)
    doc["themes"][0]["gap_ids"] = ["g"]
    path.write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="names objects"):
        projections.load_projection(spark, str(path), "c", "h", atlas)


def test_append_faults_with_repeats_and_nulls(spark):
    shape = "k int, v string"
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (None, "n"), (None, "m")], shape)
    after = spark.createDataFrame([(1, "a"), (2, ""), (4, "new"), (None, "n"), (None, "m")], shape)
    assert {tuple(r) for r in projections.append_faults(before, after, "k").collect()} == {(1, "updated"), (2, "updated"), (3, "deleted")}
    assert projections.append_faults(before, before.unionByName(after), "k").isEmpty()


def test_reference_map(spark):
    shape = "library_id string, external_id string, kind string, target string, alias string"
    entries = spark.createDataFrame([("l", "x", "doc", "1", "Ünï  One"), ("l", "y", "doc", "2", "ünï one"), ("o", "z", "doc", "3", "z"), ("l", "z", "doc", "4", "w")], shape)
    expected = spark.createDataFrame([("x",), ("y",), ("v",)], "external_id string")
    got = {tuple(r) for r in projections.reference_faults(entries, expected, "l").collect()}
    assert got == {("v", "missing"), ("z", "extra"), ("z", "foreign"), ("z", "repeated_id"), ("x", "repeated_alias"), ("y", "repeated_alias")}
    asked = spark.createDataFrame([(" W ",), ("z",)], "alias string")
    assert {(r.alias, r.external_id) for r in projections.resolved_reference(entries, "l", asked).collect()} == {(" W ", "z"), ("z", None)}


def test_trimmed_text_is_a_slice(spark):
    texts = ["  a b\n", "", "  　", None, "x", " y z\t"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", projections.trimmed(F.col("t")).alias("r")).collect()
    for r in rows:
        if r.t is None:
            assert r.r.text is None
        else:
            assert r.r.text == r.t.strip() and (r.r.text == "" or r.t[r.r.start : r.r.end] == r.r.text)


def test_graphs_of_runs_merge(spark):
    nodes = spark.createDataFrame([("r1", "a", "k", "L", ["2", "1"]), ("r2", "a", "k", "L", ["3"]), ("r1", "b", "k", "M", []), ("r2", "b", "k", "N", None)], "run_id string, node_id string, kind string, label string, members array<string>")
    got = {r.node_id: (r.runs, r.consistent, r.members) for r in projections.merged_nodes(nodes).collect()}
    assert got == {"a": (2, True, ["1", "2", "3"]), "b": (2, False, [])}
    edges = spark.createDataFrame([("e", "a", "b", "x"), ("e", "a", "b", "x"), ("f", "a", "gone", "x")], "edge_id string, a string, b string, kind string")
    assert [tuple(r) for r in projections.merged_edges(edges, nodes).collect()] == [("e", "a", "b", "x", True)]


def test_recall_reads_only_what_is_permitted(spark):
    fragments = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "fragment_id int, text string")
    compiled = spark.createDataFrame([(1, True, False), (2, False, True), (3, True, False)], "fragment_id int, permitted boolean, policy_denied boolean")
    search = lambda rows: rows.select(F.lit("q").alias("query_id"), F.col("fragment_id").alias("id"), F.col("fragment_id").cast("long").alias("rank"), F.lit(1.0).alias("score"))
    results, packets, receipt = projections.recall(fragments, compiled, search)
    assert sorted(r.id for r in results.collect()) == [1, 3]
    assert packets.first().items == 2 and receipt.first().read == 2 and receipt.first().policy_omission_present
    outside, _, _ = projections.recall(fragments, compiled, lambda rows: search(fragments))
    with pytest.raises(Exception, match="outside of the scope"):
        outside.collect()


def test_generator_failures_are_rows(spark):
    rows = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "boom")], "fragment_id string, text string")

    def generate(key, text):
        if text == "boom":
            raise RuntimeError("no")
        return text.split()

    got = {tuple(r) for r in projections.generated(rows, generate).collect()}
    assert got == {("a", "made", "x", None), ("a", "made", "y", None), ("b", "empty", None, None), ("c", "failed", None, "RuntimeError: no")}


def test_receipts_show_changes(spark):
    made = projections.receipts(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), "k")
    assert projections.receipt_faults(made).isEmpty()
    changed = made.withColumn("body", F.when(F.col("subject") == "1", "{}").otherwise(F.col("body")))
    assert [r.subject for r in projections.receipt_faults(changed).collect()] == ["1"]


def test_a_generator_sees_one_text_at_a_time(spark):
    """No pandas frame holds a batch of texts: plans have an Arrow map, and texts beyond a piece come in order."""
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else "w " * (k % 3)) for k in range(700)], "fragment_id int, text string").coalesce(1)
    out = projections.generated(rows, lambda key, text: text.split())
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    found = [(r.fragment_id, r.status) for r in out.collect()]
    assert found == [(str(k), s) for k in range(700) for s in (["made"] * (k % 3) if k % 5 and k % 3 else ["empty"])]
