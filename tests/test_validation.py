import pytest

from quern.operators import atlas, scope, validation
from quern.plans import registry


def test_entailment_decisions(spark):
    answers = spark.createDataFrame([(k, k != 1, k != 2, f"h{k}") for k in range(1, 12)], "answer_id int, contract_accepted boolean, coverage_complete boolean, case_set_hash string")
    cases = spark.createDataFrame([(k, c, "inference" if c == "b" else "supported") for k in range(1, 12) for c in "ab"], "answer_id int, claim_id string, status string")
    receipts = spark.createDataFrame([(k, f"r{k}", "old" if k == 4 else f"h{k}", "human" if k == 5 else "model") for k in range(1, 12) if k != 3], "answer_id int, receipt_id string, case_set_hash string, judge string")
    verdicts = {8: ("directly_supported", "supported_inference"), 9: ("directly_supported", "uncertain"), 10: ("contradicted", "uncertain"), 11: ("supported_inference", "directly_supported")}
    rows = [(f"r{k}", c, verdicts.get(k, ("directly_supported",) * 2)[i]) for k in range(1, 12) for i, c in enumerate("ab") if (k, c) != (6, "b")] + [("r7", "zz", "uncertain"), ("r7", "a", "uncertain")]
    judgments = spark.createDataFrame(rows, "receipt_id string, claim_id string, verdict string")
    found = {r.answer_id: (r.decision, r.reasons) for r in validation.entailment(answers, cases, receipts, judgments, "model").collect()}
    assert found == {
        1: ("unchecked", ["contract"]), 2: ("unchecked", ["coverage"]), 3: ("review_required", ["no_receipt"]), 4: ("review_required", ["stale_receipt"]), 5: ("review_required", ["wrong_judge"]), 6: ("review_required", ["missing_judgment"]),
        7: ("review_required", ["extra_judgment", "repeated_judgment"]), 8: ("passed", []), 9: ("review_required", ["claim_uncertain"]), 10: ("failed", ["claim_failed", "claim_uncertain"]), 11: ("failed", ["claim_failed"]),
    }


def test_entailment_of_a_claim_with_two_statuses_and_few_shuffles(spark):
    """A verdict weighs by each status of its claim; cases and judgments meet in one shuffle, and answers are made once."""
    answers = spark.createDataFrame([(k, True, True, "h") for k in (1, 2, 3)], "answer_id int, contract_accepted boolean, coverage_complete boolean, case_set_hash string")
    cases = spark.createDataFrame([(1, "a", "inference"), (1, "a", "supported"), (2, "a", "inference"), (2, "a", "inference"), (3, "a", None)], "answer_id int, claim_id string, status string")
    receipts = answers.selectExpr("answer_id", "concat('r', answer_id) AS receipt_id", "case_set_hash", "'model' AS judge")
    judgments = spark.createDataFrame([("r1", "a", "supported_inference"), ("r2", "a", "supported_inference"), ("r3", "a", None), ("r9", "a", "uncertain")], "receipt_id string, claim_id string, verdict string")
    found = {r.answer_id: (r.decision, r.reasons) for r in validation.entailment(answers, cases, receipts, judgments, "model").collect()}
    assert found == {1: ("failed", ["claim_failed"]), 2: ("passed", []), 3: ("failed", ["claim_failed"])}
    plan = registry.QUERIES["answer_entailment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") <= 8


def test_coverage_of_a_task(spark):
    answers = spark.createDataFrame([(1, "t", "p", "supported", "open"), (2, "t", "q", "draft", None), (3, "u", "p", "supported", None), (4, "none", "p", "supported", None)], "answer_id int, task_id string, packet_hash string, status string, open_gap string")
    specs = spark.createDataFrame([("t", "p", ["supported"], True, 2), ("u", "p", ["supported"], False, 0)], "task_id string, packet_hash string, allowed_statuses array<string>, require_open_gap boolean, min_cited_sources int")
    facets = spark.createDataFrame([("t", "f1", 2, ["a", "b", "b"]), ("t", "f2", 1, ["c", "gone"])], "task_id string, facet_id string, min_evidence int, evidence_ids_any array<string>")
    packet = spark.createDataFrame([("p", x) for x in "abc"], "packet_hash string, evidence_id string")
    used = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (1, "a")], "answer_id int, evidence_id string")
    cited = spark.createDataFrame([(1, "s1"), (1, "s2"), (1, "s2"), (2, "s1")], "answer_id int, source_id string")
    found = {r.answer_id: (r.covered, r.required, r.basis_points, r.cited_sources, r.violations, r.decision) for r in validation.answer_coverage(answers, specs, facets, packet, used, cited).collect()}
    assert found == {
        1: (1, 2, 5000, 2, ["facet_missing:f2", "facet_outside_packet:f2"], "incomplete"),
        2: (0, 2, 0, 1, ["cited_sources", "facet_missing:f1", "facet_missing:f2", "facet_outside_packet:f2", "not_bound", "open_gap_required", "status_not_allowed"], "incomplete"),
        3: (0, 0, 10000, 0, [], "complete"), 4: (0, 0, 10000, 0, ["no_spec"], "incomplete"),
    }


def test_candidates_of_routes(spark):
    rows = [("r", "semantic", "q1", 0.5), ("r", "semantic", "q2", 0.9), ("r", "semantic", "q3", 0.1), ("r", "lexical", "q4", 0.05), ("s", "semantic", "q1", 0.1), ("t", "semantic", "q1", 0.9), ("t", "lexical", "q1", 0.9), ("u", "lexical", "q1", 0.0), ("v", "semantic", "zz", 1.0), ("w", "semantic", "q1", float("nan"))]
    scores = spark.createDataFrame(rows, "route_id string, channel string, question_id string, score double")
    found, faults = validation.candidate_receipts(scores, spark.createDataFrame([(f"q{k}",) for k in range(1, 5)], "question_id string"), 0.4)
    assert sorted((r.route_id, r.question_id, r.rank, r.place) for r in found.collect()) == [("r", "q1", 2, 2), ("r", "q2", 1, 1), ("r", "q4", 1, 3)]
    assert {tuple(r) for r in faults.collect()} == {("t", "q1", "repeated"), ("u", "q1", "not_positive"), ("v", "zz", "unknown"), ("w", "q1", "not_finite")}


def test_reads_are_authorised_anew(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "a" if k % 2 else "b") for k in range(6)], "fragment_id long, text string, source_id string")
    members = docs.select("fragment_id", "source_id").selectExpr("*", "'c' AS collection_id", "'active' AS state")
    rules, none = spark.createDataFrame([("c", "allow")], "collection_id string, effect string"), spark.createDataFrame([], "source_id string, effect string")
    compiled = scope.compile_access(members, rules, none, ["c"])
    token = validation.scope_token(compiled, "library", "snapshot")
    assert validation.authorised_read(docs, compiled, token, "library", "snapshot").count() == 6
    denied = scope.compile_access(members, rules, spark.createDataFrame([("b", "deny")], "source_id string, effect string"), ["c"])
    for now, parts in ((denied, ("library", "snapshot")), (compiled, ("library", "other"))):
        with pytest.raises(PermissionError):
            validation.authorised_read(docs, now, token, *parts)


def test_packets_keep_hard_budgets(spark):
    evidence = spark.createDataFrame([("p", "e1", "counter", 1, "s1"), ("p", "e2", "support", 9, "s2"), ("p", "e3", "support", 2, "s1"), ("q", "e1", "support", 1, "s1"), ("r", "e1", "odd", 1, "gone"), ("t", "e1", "support", 1, "s1"), ("t", "e2", "counter", 1, "s2"), ("t", "e3", "counter", 2, "s3"), ("t", "e4", "counter", 3, "s1")], "packet_id string, id string, role string, rank int, source_id string")
    gaps = spark.createDataFrame([("p", "g2", 2), ("p", "g1", 1), ("v", "g1", 1)], "packet_id string, id string, rank int")
    sources = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "id string")
    rows, states = atlas.connector_packets(evidence, gaps, sources, ["support", "counter"], {"evidence": 3, "gaps": 2, "sources": 2})
    assert {(r.packet_id, r.state, tuple(r.missing_roles), tuple(r.faults)) for r in states.collect()} == {("p", "complete", (), ()), ("q", "partial", ("counter",), ()), ("r", "refused", ("support", "counter"), ("unknown_role", "unknown_source")), ("t", "refused", (), ("over:evidence", "over:sources")), ("v", "partial", ("support", "counter"), ())}
    assert sorted((r.section, r.place, r.id, r.role) for r in rows.filter("packet_id = 'p'").collect()) == [("evidence", 1, "e3", "support"), ("evidence", 2, "e2", "support"), ("evidence", 3, "e1", "counter"), ("gaps", 1, "g1", None), ("gaps", 2, "g2", None), ("sources", 1, "s1", None), ("sources", 2, "s2", None)]
    assert rows.filter("packet_id IN ('r', 't')").count() == 0


def test_an_open_atlas_is_refused(spark):
    questions = spark.createDataFrame([("q", ["e1"])], "id string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", ["s1"])], "id string, source_ids array<string>")
    whole = {"questions": questions, "evidence": evidence, "sources": spark.createDataFrame([("s1",)], "id string")}
    assert atlas.closed(whole) is whole
    with pytest.raises(ValueError, match="not closed"):
        atlas.closed(whole | {"sources": spark.createDataFrame([("other",)], "id string")})


def test_coverage_deals_no_row_by_evidence(spark):
    """A row for each piece of evidence, dealt by its id, is what grew; nulls and repeats in a facet's list count for nothing."""
    answers = spark.createDataFrame([(1, 1, "p", "O", None), (2, 9, "p", "O", None)], "answer_id int, task_id int, packet_hash string, status string, open_gap string")
    specs = spark.createDataFrame([(1, "p", ["O"], False, 1)], "task_id int, packet_hash string, allowed_statuses array<string>, require_open_gap boolean, min_cited_sources int")
    facets = spark.createDataFrame([(1, 1, 1, ["a", "a", None]), (1, 2, 2, ["a", "b", "b"]), (1, 3, 1, ["x"]), (1, 4, 0, [])], "task_id int, facet_id int, min_evidence int, evidence_ids_any array<string>")
    packet = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "x")], "packet_hash string, evidence_id string")
    used = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x"), (2, "b")], "answer_id int, evidence_id string")
    cited = spark.createDataFrame([(1, 7), (1, 7), (1, None)], "answer_id int, source_id int")
    out = validation.answer_coverage(answers, specs, facets, packet, used, cited)
    found = {r.answer_id: (r.covered, r.required, r.cited_sources, r.violations) for r in out.collect()}
    assert found == {1: (2, 4, 1, ["facet_missing:2", "facet_missing:3", "facet_outside_packet:3"]), 2: (0, 0, 0, ["no_spec"])}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "evidence_id" in line.split("hashpartitioning")[1]]
