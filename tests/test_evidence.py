import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import canonical
from quern.functions import text as T
from quern.operators import gates, graph, mining, retrieval, scope
from quern.sources import fragments
from quern.streaming import journal, outbox


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("v"))).collect()]


def test_tokens_fold_latin_marks_only(spark):
    found = column(spark, ["Café don't foo_bar Ấn x² їжак", "İi", None, ""], T.tokens)
    assert found[0] == ["cafe", "don", "t", "foo", "bar", "an", "x²", "їжак"] and found[2:] == [[], []]


def test_folds(spark):
    assert T.fold_value("  Ｃafé­x  ЇЙ ") == "cafex їй"
    assert column(spark, ["Straße  é", None], T.strict) == ["straße é", None]
    assert column(spark, ["ÉTÉ ё", None], T.fold) == ["ete ё", None]


@pytest.mark.parametrize(("text", "literal", "profile", "expected"), [("the blends", "blend", "strict", False), ("a blend.", "Blend", "strict", True), ("café", "cafe", "strict", False), ("Café bar", "cafe", "folded", True), ("c++ code", "c++", "strict", True), ("ac++", "c++", "strict", False), ("cats", "cat", "contains", True), ("x", "", "strict", False)])
def test_literal_presence(spark, text, literal, profile, expected):
    assert column(spark, [text], lambda c: T.literal_present(c, literal, profile)) == [expected]


def test_noise_rules(spark):
    refs = "\n".join(f"[{k}] Doe, J. Title. Press. {1990 + k}" for k in range(5))
    index = "Index\nalpha 1, 2\nbeta 3\ngamma 4, 5"
    table = "a\tb\tc\nd\te\tf\ng\th\ti\nj\tk\tl"
    rows = column(spark, [refs, index, table, "plain words on a topic", ""], lambda c: T.noise_reasons(F.lit("what topic words"), c, F.lit("paragraph"), F.array(F.lit("Intro"))))
    assert rows == [["bibliography", "topic_drift"], ["index", "topic_drift"], ["table", "topic_drift"], [], ["topic_drift"]]


def test_numbers_and_router_terms(spark):
    assert column(spark, ["in 1999, -3.5% of 12:30 x7 v2", None], T.numbers) == [["1999", "-3.5%", "12:30"], []]
    assert column(spark, ["The 7 cats and cats of Rome"], T.router_terms) == [["7", "cats", "rome", "the"]]


def test_canonical_json():
    assert canonical.canonical_json({"b": [1, None, True], "a": "é"}) == '{"a":"é","b":[1,null,true]}'.encode()
    with pytest.raises(TypeError):
        canonical.canonical_json({"x": 1.5})
    with pytest.raises(ValueError):
        canonical.canonical_json({"é": 1, "é": 2})


def test_scores_round_half_even(spark):
    assert column(spark, [0.0000005, -0.0, 1.0000015, -2.5], canonical.score_text, "double") == ["0.000000", "0.000000", "1.000002", "-2.500000"]


def test_bm25_equals_sqlite(spark):
    import sqlite3

    texts = ["the quick brown fox", "the lazy dog and the fox", "Café au lait, café noir", "dog dog dog", "nothing here", ""]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, text, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    for question, match in (("fox dog", '"fox" OR "dog"'), ("cafe NOIR", '"cafe" OR "noir"')):
        want = db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t), id", (match,)).fetchall()
        docs = spark.createDataFrame(list(enumerate(texts)), "fragment_id int, text string")
        got = retrieval.Index(docs).search(spark.createDataFrame([(1, question)], "query_id int, question string")).orderBy("rank").collect()
        assert [r.id for r in got] == [i for i, _ in want] and all(abs(r.score - s) < 1e-6 for r, (_, s) in zip(got, want, strict=True))


def test_denied_fragments_change_no_score(spark):
    docs = spark.createDataFrame([(k, f"fox {'dog ' * k}", "a" if k < 4 else "b") for k in range(8)], "fragment_id int, text string, c string")
    asked = spark.createDataFrame([(1, "fox dog")], "query_id int, question string")
    few = retrieval.Index(docs.filter("c = 'a'")).search(asked)
    assert retrieval.replay_difference(few, retrieval.Index(docs.filter("fragment_id < 4")).search(asked)).isEmpty()


def test_access_is_denied_by_default(spark):
    members = spark.createDataFrame([("f1", "s1", "c1", "active"), ("f1", "s1", "c2", "active"), ("f2", "s1", "c1", "active"), ("f3", "s2", "c1", "holdout"), ("f4", "s3", "c1", "active"), ("f5", "s4", "c9", "active"), ("f6", "s5", "c1", "active")], "fragment_id string, source_id string, collection_id string, state string")
    rules = spark.createDataFrame([("c1", "allow")], "collection_id string, effect string")
    denied = spark.createDataFrame([("s3", "deny")], "source_id string, effect string")
    out = spark.createDataFrame([("source", "s5")], "kind string, id string")
    rows = {r.fragment_id: (r.permitted, r.policy_denied) for r in scope.compile_access(members, rules, denied, ["c1", "c2"], out).collect()}
    assert rows == {"f1": (False, True), "f2": (True, False), "f3": (False, False), "f4": (False, True)}
    only_excluded = scope.compile_access(members.filter("fragment_id IN ('f2', 'f6')"), rules, denied, ["c1"], out)
    assert scope.policy_omission(only_excluded).first()[0] is False


def test_gate_decisions(spark):
    cases = [(True, 2, 2, True), (True, 2, 2, False), (True, 2, 0, True), (False, 2, 2, True), (False, 2, 1, True)]
    rows = spark.createDataFrame(cases, "a boolean, n int, c int, t boolean")
    assert [r[0] for r in rows.select(gates.gate_decision(F.col("a"), F.col("n"), F.col("c"), F.col("t"))).collect()] == ["ready", "partial", "insufficient", "gap_challenged", "gap_preserved"]
    assert gates.minimal_set(["a", "b", "c"], lambda x: "b" in x) == ["b"]


def test_claims_and_spans(spark):
    rows = spark.createDataFrame([("c", "It rose 5% in 1999", ["in 1999 it rose"])], "claim_id string, text string, quotes array<string>")
    assert gates.unquoted_numbers(rows).first().unsupported == ["5%"]
    spans = spark.createDataFrame([(1, 0, 4), (1, 4, 9), (2, 1, 3)], "answer_id int, start int, end int")
    assert [r.answer_id for r in gates.proposition_gaps(spans).collect()] == [2]
    steps = spark.createDataFrame([(1, "c", "b"), (1, "b", "a")], "trace_id int, step string, premise string")
    assert {(r.step, r.ancestor) for r in gates.premise_closure(steps).collect()} == {("c", "b"), ("b", "a"), ("c", "a")}


def test_walk_takes_simple_paths_only(spark):
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "a"), ("4", "b", "d")], "relation_id string, src string, dst string")
    found = {r.node_path for r in graph.walk(edges, spark.createDataFrame([("a",)], "node string"), 4).collect()}
    assert found == {"a>b", "a>b>c", "a>b>d"}
    first = graph.walk(edges, spark.createDataFrame([("a",)], "node string"), 4, most_paths=2)
    assert sorted(r.relation_path for r in first.collect()) == ["1", "1>2"]
    assert {r.node for r in graph.reach(edges, spark.createDataFrame([("c",)], "node string")).collect()} == set("abcd")


def test_nodes_need_all_their_grounding(spark):
    grounding = spark.createDataFrame([("t", "n1", "f1"), ("t", "n1", "f2"), ("t", "n2", "f1")], "node_type string, node_id string, fragment_id string")
    assert [r.node_id for r in graph.authorised_nodes(grounding, spark.createDataFrame([("f1",)], "fragment_id string")).collect()] == ["n2"]


def test_dispositions(spark):
    history = spark.createDataFrame([("u", "a", 1, False), ("u", "b", 2, True)], "uri string, sha256 string, version int, is_head boolean")
    incoming = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "c"), ("v", "a")], "uri string, sha256 string")
    assert sorted((r.uri, r.sha256, r.disposition, r.version) for r in scope.disposition(incoming, history).collect()) == [("u", "a", "reverted", 1), ("u", "b", "unchanged", 2), ("u", "c", "changed", 3), ("v", "a", "added", 1)]


def test_markdown_addresses():
    text = "# One #\r\nintro\n\n## Two\n```\n# not a heading\n\n```\nlast\n### \n"
    found = fragments.parse_markdown(text.encode())
    assert [(f["kind"], f["text"], f["heading_path"]) for f in found] == [("heading", "One", ["One"]), ("paragraph", "intro", ["One"]), ("heading", "Two", ["One", "Two"]), ("paragraph", "```\n# not a heading\n\n```\nlast\n### ", ["One", "Two"])]
    flat = text.replace("\r\n", "\n")
    assert all(flat[f["char_start"] : f["char_end"]] == f["text"] for f in found)


def test_discovery_and_parsers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# T\n\nbody")
    (tmp_path / "a" / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "a" / "y.bin").write_bytes(b"1")
    (tmp_path / "b.fb2").write_text("<FictionBook><body><section><p>one</p><p>two</p></section></body></FictionBook>")
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="i" href="t.xhtml"/></manifest><spine><itemref idref="i"/></spine></package>')
        z.writestr("o/t.xhtml", "<html><body><h1>H</h1><p>para</p></body></html>")
    files = fragments.discover(spark, str(tmp_path))
    rows = sorted((r.relative_path, r.status, r.text or r.failure_code) for r in fragments.parse(files).collect())
    assert rows == [("a/bad.txt", "failed", "invalid_utf8"), ("a/x.md", "processed", "T"), ("a/x.md", "processed", "body"), ("a/y.bin", "skipped", "unsupported_media_type"), ("b.fb2", "processed", "one"), ("b.fb2", "processed", "two"), ("c.epub", "processed", "H"), ("c.epub", "processed", "para")]
    assert [r.relative_path for r in fragments.discover(spark, str(tmp_path), include=["**/*.md"]).collect()] == ["a/x.md"]


def test_source_diverse_takes_each_source_first(spark):
    rows = spark.createDataFrame([(1, "a", 9.0, 1), (1, "a", 8.0, 2), (1, "b", 1.0, 3)], "g int, s string, score double, rank int")
    found = mining.source_diverse(rows, "g", "s", "score", "rank", 2).orderBy("place").collect()
    assert [r.rank for r in found] == [1, 3]


def test_journal_streams_like_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10), (1, 10), (2, 70), (3, 4000)], "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts"), F.lit("k").alias("kind"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        outbox.export(stream, str(tmp_path / "out"), str(tmp_path / "ck"), order="ts").awaitTermination()
    assert sorted(r.event_id for r in outbox.exported(spark, str(tmp_path / "out"), rows.schema, order="ts").collect()) == [1, 2, 3]
    assert journal.dedup_stream(rows, "event_id", "ts").count() == 3
    assert journal.windowed_counts(rows, "ts", "1 hour", "kind").count() == 2
