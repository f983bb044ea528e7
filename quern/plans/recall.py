"""The query of stored batch recalls, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import recall, scope
from quern.plans.local import checkpointed, scratch
from quern.plans.registry import bm25_sql, query
from quern.session import table
from quern.sources.commits import Versions


@query(f"""WITH r AS ({bm25_sql("SELECT doc_id AS id, text FROM documents WHERE lang <> 'de'", "doc_id", "SELECT item_id AS query_id, text AS question FROM benchmark", 10)})
SELECT query_id, count(*) AS items, sha256(string_agg(rank || '|' || doc_id || '|' || printf('%.6f', score), chr(10) ORDER BY rank)) AS packet_hash, CAST((SELECT count(*) FROM documents WHERE lang <> 'de') AS BIGINT) AS read, TRUE AS policy_omission_present FROM r GROUP BY query_id""")
def stored_recall(spark, sf_dir):
    """Benchmark items recalled in two batches over all languages but one, the second with the first's requests again; read from the store."""
    checkpointed(spark)
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("doc_id").alias("fragment_id"), "lang", "text")
    members = docs.select("fragment_id", F.col("lang").alias("source_id"), F.lit("all").alias("collection_id"), F.lit("active").alias("state"))
    compiled = scope.compile_access(members, spark.sql("SELECT 'all' AS collection_id, 'allow' AS effect"), spark.sql("SELECT 'de' AS source_id, 'deny' AS effect"), ["all"]).checkpoint()
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    store = Versions(spark, scratch(spark, "recalls"))
    backend = recall.Bm25(folder=scratch(spark, "cut"))
    recall.recall_batch(store, docs, compiled, asked.filter("query_id % 2 = 0"), backend)
    version = recall.recall_batch(store, docs, compiled, asked, backend)
    requests, held, receipts = (store.table(name, version) for name in ("requests", "packets", "receipts"))
    return requests.select("request_id", "query_id").join(held, "request_id").join(receipts, "request_id").select("query_id", "items", "packet_hash", "read", "policy_omission_present")
