"""Queries of projections, append-only tables, reference maps, merged graphs, recall, generators and receipts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import projections, scope
from quern.operators.retrieval import Index
from quern.plans.registry import query
from quern.session import table


@query("""SELECT 'material' AS kind, CAST(c_custkey AS VARCHAR) AS id, 'source_id' AS field, CAST(c_nationkey AS VARCHAR) AS missing FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)
UNION ALL SELECT 'theme', CAST(p_partkey AS VARCHAR), 'question_ids', CAST(p_size AS VARCHAR) FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'theme', CAST(p_partkey AS VARCHAR), 'question_ids', CAST(p_size + 1 AS VARCHAR) FROM part WHERE p_size + 1 NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'theme', CAST(p_partkey AS VARCHAR), 'gap_ids', '1' FROM part WHERE p_size > 40""")
def projection_faults(spark, sf_dir):
    """Customers as materials of 20 nations, parts as themes of the nations as questions and of a kind that the atlas lacks."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    materials = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("source_id"))
    gaps = F.when(F.col("p_size") > 40, F.array(F.lit("1")))
    themes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_size", F.col("p_size") + 1).alias("question_ids"), gaps.alias("gap_ids"))
    return projections.projection_faults(materials, themes, {"sources": nations.filter("id < 20"), "questions": nations})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' ELSE 'updated' END AS fault FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def append_faults(spark, sf_dir):
    """Orders against a later state that lost some, changed others and has new ones."""
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.filter("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "changed").otherwise(F.col("o_orderstatus")))
    return projections.append_faults(before, after.unionByName(before.withColumn("o_orderkey", -1 - F.col("o_orderkey"))), "o_orderkey")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 4 THEN c_custkey - 1 ELSE c_custkey END AS t FROM customer WHERE c_custkey % 9 <> 0),
t AS (SELECT t FROM c GROUP BY t HAVING count(*) > 1)
SELECT CAST(c_custkey AS VARCHAR) AS external_id, 'missing' AS fault FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 8 <> 0
UNION ALL SELECT CAST(k AS VARCHAR), 'extra' FROM c WHERE k % 8 = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'foreign' FROM c WHERE k % 17 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'repeated_target' FROM c WHERE t IN (FROM t) UNION ALL SELECT CAST(k AS VARCHAR), 'repeated_alias' FROM c WHERE t IN (FROM t)""")
def reference_faults(spark, sf_dir):
    """A map of customers without some, with others not asked for, of another library, or onto one target by one alias."""
    key = F.col("c_custkey")
    target = F.when(key % 10 == 4, key - 1).otherwise(key).cast("string")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    alias = F.concat(F.when(key % 2 == 0, " Customer  ").otherwise("CUSTOMER "), target)
    entries = customers.filter(key % 9 != 0).select(F.when(key % 17 == 0, "other").otherwise("own").alias("library_id"), key.cast("string").alias("external_id"), F.lit("customer").alias("kind"), target.alias("target"), alias.alias("alias"))
    return projections.reference_faults(entries, customers.filter(key % 8 != 0).select(key.cast("string").alias("external_id")), "own")


@query("""WITH d AS (SELECT doc_id, repeat(' ', CAST(doc_id % 4 AS INTEGER)) || text || repeat(chr(10), CAST(doc_id % 3 AS INTEGER)) AS t FROM documents),
k AS (SELECT doc_id, CAST(length(regexp_extract(t, '^\\s*')) AS BIGINT) AS start_at, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS kept FROM d)
SELECT doc_id, start_at, start_at + length(kept) AS end_at, sha256(kept) AS text_hash FROM k""".replace("\\\\", "\\"))
def trimmed_texts(spark, sf_dir):
    padded = F.expr("concat(repeat(' ', CAST(doc_id % 4 AS INT)), text, repeat('\\n', CAST(doc_id % 3 AS INT)))")
    rows = table(spark, sf_dir, "documents").select("doc_id", projections.trimmed(padded).alias("r"))
    return rows.select("doc_id", F.col("r.start").alias("start_at"), F.col("r.end").alias("end_at"), "r.text_hash")


@query("""SELECT l_partkey AS node_id, min(l_returnflag) AS label, count(DISTINCT l_orderkey) AS runs, count(DISTINCT l_returnflag) = 1 AS consistent, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS members FROM lineitem GROUP BY l_partkey""")
def merged_nodes(spark, sf_dir):
    builds = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("node_id"), F.lit("part").alias("kind"), F.col("l_returnflag").alias("label"), F.array(F.col("l_suppkey").cast("string")).alias("members"))
    return projections.merged_nodes(builds).select("node_id", "label", "runs", "consistent", F.array_join("members", ",").alias("members"))


@query("""SELECT l_partkey * 100000 + l_suppkey AS edge_id, l_partkey AS a, l_suppkey AS b, min(l_returnflag) AS kind, count(DISTINCT l_returnflag) = 1 AS consistent FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) GROUP BY l_partkey, l_suppkey""")
def merged_edges(spark, sf_dir):
    """Edges of parts to suppliers, over nodes that are all parts and the suppliers of some nations."""
    builds = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("edge_id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("kind"))
    ends = builds.select(F.col("a").alias("node_id"))
    suppliers = table(spark, sf_dir, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("node_id"))
    some = projections.merged_edges(builds, ends.unionByName(builds.select(F.col("b").alias("node_id"))))
    return some.join(suppliers, some["b"] == suppliers["node_id"], "left_semi")


@query("SELECT CAST(doc_id AS VARCHAR) AS fragment_id, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' ELSE 'made' END AS status, CASE WHEN n > 0 THEN n END AS words FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\x0C\\r]+')) AS n FROM documents WHERE doc_id % 7 <> 0) UNION ALL SELECT CAST(doc_id AS VARCHAR), 'failed', NULL FROM documents WHERE doc_id % 7 = 0".replace("\\\\", "\\"))
def generated_runs(spark, sf_dir):
    """A generator that fails on some documents and proposes the number of words of others."""

    def words(key: str, text: str) -> list[str]:
        if int(key) % 7 == 0:
            raise ValueError(key)
        return [str(len(text.encode().split()))] if text.encode().split() else []

    rows = projections.generated(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fragment_id"), "text"), words)
    return rows.select("fragment_id", "status", F.col("proposal").cast("long").alias("words"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"toxic\":' || toxic || '}') AS receipt_id FROM labels WHERE doc_id % 3 <> 0")
def stored_receipts(spark, sf_dir):
    """Receipts of all labels, sent twice over a table that holds a third of them: what is added."""
    made = projections.receipts(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    added = scope.insert_or_ignore(made.filter("CAST(subject AS BIGINT) % 3 = 0"), made.unionByName(made), "receipt_id")
    return added.select(F.col("subject").cast("long").alias("doc_id"), "receipt_id")


@query(r"""SELECT count(*) FILTER (WHERE lang <> 'de') AS read, bool_or(lang = 'de') AS policy_omission_present,
least(10, count(*) FILTER (WHERE lang <> 'de' AND regexp_matches(lower(text), '\b(data|the)\b'))) AS items FROM documents WHERE lang IS NOT NULL""")
def recall_receipt(spark, sf_dir):
    """A recall over all languages but one that policy denies: what its receipt says was read, and its packet's items."""
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("doc_id").alias("fragment_id"), "lang", "text")
    members = docs.select("fragment_id", F.col("lang").alias("source_id"), F.lit("all").alias("collection_id"), F.lit("active").alias("state"))
    compiled = scope.compile_access(members, spark.sql("SELECT 'all' AS collection_id, 'allow' AS effect"), spark.sql("SELECT 'de' AS source_id, 'deny' AS effect"), ["all"])
    search = lambda rows: Index(rows).search(spark.sql("SELECT 'q' AS query_id, 'the data' AS question"))
    _, packet, receipt = projections.recall(docs, compiled, search)
    return receipt.crossJoin(F.broadcast(packet)).select("read", "policy_omission_present", "items")  # one question, one row
