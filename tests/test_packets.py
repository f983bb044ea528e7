import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quern.functions import canonical
from quern.functions import text as T
from quern.operators import answers, gates, graph, mining, packets, retrieval, review, scope
from quern.streaming import journal


def test_packets_load_only_unaltered(spark):
    rows = spark.createDataFrame([("q", 1, "a", 0.5), ("q", 2, "b", 0.25), ("p", 1, "a", 1.0)], "query_id string, rank long, id string, score double")
    stored = packets.packets(rows)
    assert packets.load(stored, rows.repartition(3)).count() == 3
    later = rows.withColumn("score", F.when(F.col("id") == "b", 0.3).otherwise(F.col("score")))
    assert [tuple(r) for r in packets.altered(stored, later).collect()] == [("q", "changed")]
    with pytest.raises(ValueError):
        packets.load(stored, later)


def test_texts_open_with_valid_permits_only(spark):
    docs = spark.createDataFrame([(1, "x", "one"), (2, "x", "two"), (3, "y", None)], "id int, lang string, text string")
    permits = docs.select("id", "lang").withColumn("token", packets.permit(F.col("id"), F.col("lang"))).withColumn("lang", F.when(F.col("id") == 2, "z").otherwise(F.col("lang")))
    assert {r.id: r.text for r in packets.read_text(docs, permits, "id").collect()} == {1: "one", 2: None, 3: None}
    assert "text" not in packets.metadata(docs).columns


def test_scopes_close_what_was_used_least():
    closed = []

    class Held:
        def __init__(self, name):
            self.name = name

        def close(self):
            closed.append(self.name)

    scopes = packets.Scopes(2)
    for name in ("a", "b", "a", "c"):
        assert scopes.open(name, lambda name=name: Held(name)).name == name
    assert closed == ["b"] and list(scopes.held) == ["a", "c"]


def test_a_saved_index_answers_alike(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"fox {'dog ' * (k % 4)} café", "x") for k in range(30)] + [(99, None, "x")], "fragment_id int, text string, source string")
    asked = spark.createDataFrame([(1, "fox dog"), (2, "cafe"), (3, "absent")], "query_id int, question string")
    index = retrieval.Index(docs)
    saved = index.saved(str(tmp_path / "index"))
    assert retrieval.replay_difference(index.search(asked), saved.search(asked)).isEmpty()
    saved.close()
    assert not (tmp_path / "index").exists()


def test_a_saved_index_is_written_where_its_texts_are(spark, tmp_path, monkeypatch):
    def refuse(self, *a):
        raise AssertionError("all postings go to a fixed number of tasks")

    monkeypatch.setattr(type(spark.range(1)), "repartition", refuse)
    monkeypatch.setattr(retrieval, "BLOCK_WORDS", 7)
    docs = [(k, " ".join(f"w{(k * j) % 5}" for j in range(k % 9))) for k in range(50)] + [(60, None)]
    saved = retrieval.Index(spark.createDataFrame(docs, "fragment_id int, text string").coalesce(1)).saved(str(tmp_path / "index"))
    want = {(k, len(ws), w, ws.count(w)) for k, t in docs for ws in [(t or "").split()] for w in ws}
    assert sorted(tuple(r) for r in saved.postings.collect()) == sorted(want)


def test_many_questions_are_scored_where_the_texts_are(spark, tmp_path, monkeypatch):
    docs = [(f"d{k:03}", None if k == 7 else " ".join(f"w{(k * j * j) % 83}" for j in range(k % 40))) for k in range(120)] + [(f"copy{k:02}", "w1 w4 w9 w1") for k in range(30)] + [(None, "w1 w5")]
    docs = spark.createDataFrame(docs, "fragment_id string, text string").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(f"w{(k + j) % 90}" for j in range(k + 1))) for k in range(80)] + [(100, "nowhere"), (101, None), (None, "w1")], "query_id int, question string")
    saved = retrieval.Index(docs).saved(str(tmp_path / "index")).search(asked).collect()
    cut = retrieval.Index(docs).cut(str(tmp_path / "cut"))
    for cells in (4_000_000, 300, 1):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        for index in (retrieval.Index(docs), cut):
            found = index.search(asked)
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, saved))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # no row for a pair of text and question is shuffled
    none = retrieval.Index(docs.limit(0)).search(asked)
    assert none.columns == found.columns and none.count() == 0


def test_ties_are_cut_as_sql_rounds_them():
    raw = np.array([-1.0000000004, -1.0000000006, -1.0, -2.0, 0.0, -1.0000000001])
    assert retrieval._first(raw, np.array([5, 4, 3, 2, 1, 0]), 3).tolist() == [3, 1, 5]
    assert sorted(retrieval._first(raw, np.arange(6), 9)) == [0, 1, 2, 3, 5]


def test_texts_that_hold_a_question(spark):
    docs = spark.createDataFrame([(1, "so one two three four five six"), (2, "someone two three four fives"), (3, "tiny"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([("a", "one two three four five"), ("b", "tiny"), ("c", None), ("d", "one two three four six")], "query_id string, question string")
    found = {tuple(r) for r in retrieval.holding(docs, "doc_id", asked).collect()}
    assert found == {("a", 1), ("a", 2), ("b", 3)}


def test_journals_chain_and_reject_after_the_end(spark):
    events = spark.createDataFrame([(1, 5, "a", "x"), (1, 7, "b", "closed"), (1, 9, "c", "x"), (2, 1, None, "x")], "s int, q int, p string, kind string")
    rows = journal.chained(events, "s", "q", "p", "kind")
    found = {(r.s, r.q): r for r in rows.collect()}
    assert [found[1, q].status for q in (5, 7, 9)] == ["accepted", "accepted", "closed"] and found[1, 7].previous_hash == found[1, 5].event_hash
    good = rows.filter("status = 'accepted'")
    assert journal.violations(good, "s", "chain_sequence", "p").isEmpty()
    changed = good.withColumn("p", F.when(F.col("q") == 5, "other").otherwise(F.col("p")))
    assert [(r.chain_sequence, r.fault) for r in journal.violations(changed, "s", "chain_sequence", "p").collect()] == [(0, "hash")]


def test_a_stream_of_events_extends_the_chain(spark, tmp_path):
    rows = [(1, k, f"p{k}", "closed" if k == 3 else "x") for k in range(5)] + [(2, 0, "z", "x")]
    schema = "s int, q int, p string, kind string"
    whole = journal.chained(spark.createDataFrame(rows, schema), "s", "q", "p", "kind")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = journal.append_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "s", "q", "p", "kind")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.s, r.q, r.chain_sequence, r.event_hash, r.status) for r in df.select("s", "q", "chain_sequence", "event_hash", "status").fillna(-1, ["chain_sequence"]).fillna("", ["event_hash"]).collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(whole)


def test_requirements_are_bounded_and_checked(spark, monkeypatch):
    from quern.plans import evidence

    needs = spark.sql(evidence.REQUIREMENTS)
    bare = spark.createDataFrame([(1, 1, None, None, None, None, None, None, None)], "candidate_id int, rank int, source_id string, source_kind string, source_family string, authority string, tags array<string>, independence_group string, text string")
    codes = {r.key: r.codes for r in gates.requirement_codes(needs, bare).collect()}
    assert codes == {"english": ["missing_anchor_group_0", "wrong_source_kind"], "romance": ["missing_tag_long", "wrong_source_kind"], "any": ["wrong_authority"], "nowhere": ["missing_anchor_group_0", "wrong_source", "wrong_source_family"]}
    assert gates.spec_faults(needs).isEmpty() and gates.spec_faults(needs.unionByName(needs.limit(1))).count() == 1
    monkeypatch.setattr(gates, "MOST_REQUIREMENTS", 3)
    with pytest.raises(ValueError):
        gates.requirement_codes(needs, bare)


def test_closures_follow_every_premise(spark):
    steps = spark.createDataFrame([(1, k, k - 1 if k else None) for k in range(20)] + [(1, 19, 100), (1, 100, None)], "trace_id int, step int, premise int")
    grounded = lambda *s: {r.step: (r.closed, r.grounds) for r in gates.reasoning_closure(steps, spark.createDataFrame([(1, x) for x in s], "trace_id int, step int")).collect()}
    one, both = grounded(0), grounded(0, 100)
    assert one[18] == (True, 1) and one[19] == (False, 2) and both[19] == (True, 2) and one[100] == (False, 1)


def test_names_anchors_and_words(spark):
    assert mining.labels({"rome": 3.0, "rome city": 2.0, "city": 1.5, "art": 1.0, "b": 0.5}) == ["rome", "city", "art"]
    asked = spark.createDataFrame([(1, "what of rome"), (2, "art of war"), (3, "rome")], "k int, t string")
    assert {r.term for r in mining.common_terms(asked, "k", "t").collect()} == {"of", "rome"}
    words = spark.createDataFrame([(1, "idiot idiots idiot"), (2, "an idiot\nidiot")], "id int, text string")
    known = spark.createDataFrame([("idiot", "x")], "term string, replacement string")
    assert sorted((r.id, r.line, r["column"]) for r in answers.terms_used(words, known).collect()) == [(1, 1, 1), (1, 1, 14), (2, 1, 4), (2, 2, 1)]


def test_numbers_like_a_scan(spark):
    texts = ["in 1999, -3.5% of 12:30 x7 v2 7", "+4 4. 5-6 a1 ²", "", None, "１２ 3‰"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = {r.k: r.n for r in rows.select("k", T.numbers(F.col("t")).alias("n")).collect()}
    assert found == {k: list(dict.fromkeys(regex.findall(T.NUMBER, t or ""))) for k, t in enumerate(texts)}


def test_pages_paths_and_lookups(spark):
    rows = spark.range(65)
    assert [r.id for r in answers.page(rows, "id", 3).collect()] == list(range(60, 65)) and answers.page(rows.limit(0), "id", 1).count() == 0
    with pytest.raises(ValueError):
        answers.page(rows, "id", 4)
    paths = spark.createDataFrame([("a",), ("a/b",), ("a/bc",), ("a/b/c",), ("d/e",)], "path string")
    assert {tuple(r) for r in scope.contained_paths(paths).collect()} == {("a", "a/b"), ("a", "a/bc"), ("a", "a/b/c"), ("a/b", "a/b/c")}
    assert spark.createDataFrame([("x y/ü&.md",)], "p string").select(canonical.file_uri("/lib/", F.col("p"))).first()[0] == "file:///lib/x%20y/%C3%BC%26.md"


def test_imports_are_idempotent(spark):
    rows = spark.createDataFrame([("t", 1, 2), ("t", 1, 2), ("t", 2, 1)], "relation_type string, subject_id int, object_id int")
    new, receipt = graph.import_relations(spark.createDataFrame([], "relation_id string"), rows)
    assert tuple(receipt.first()) == (3, 2, 2, 0) and tuple(graph.import_relations(new, rows)[1].first()) == (3, 2, 0, 2)
    assert review.refused(1, 10, egress=False) == "egress_not_allowed"


def test_folds_keep_other_scripts():
    assert [T.fold_value(x) for x in ("Ｃafé", "Ấn  ﬁ", "їЙ", "Straße", "i̇", "é̂x")] == ["cafe", "an fi", "їй", "strasse", "i", "ex"]
