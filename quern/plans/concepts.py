"""Queries of concept mining, with the SQL of what SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import mining, topics
from quern.plans.local import checkpointed
from quern.plans.registry import query
from quern.session import table

STOP = ["the", "of", "and"]


@query()
def concept_edges(spark, sf_dir):
    """Concepts of the documents, named by their topics and by the benchmark's phrases: which meet, and where."""
    checkpointed(spark)
    found = topics.concept_map(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "benchmark"), "text", STOP)
    ends = {side: found.concepts.select(F.col("concept").alias(side), F.col("component").alias(f"{side}_component"), F.col("origin").alias(f"{side}_origin")) for side in ("left", "right")}
    return found.edges.join(ends["left"], "left").join(ends["right"], "right").withColumn("evidence", F.array_join("evidence", ","))


@query()
def topic_loadings(spark, sf_dir):
    """Each document's strongest topic among seven, by loadings from the terms of all documents."""
    checkpointed(spark)
    weights = mining.weighed(table(spark, sf_dir, "documents"), "doc_id", "text", STOP)
    loadings = topics.factors(*weights, "doc_id", 7).loadings
    return loadings.groupBy("doc_id").agg(F.max_by("component", "loading").alias("component"), F.count(F.lit(1)).alias("components"))


#: Benchmark phrases that documents hold, with the edges between them.
_LISTED = ["the", "thing", "clown", "idiot", "worthless", "trash", "scum", "loser", "moron", "pathetic"]


@query(r"""WITH o AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1), lambda v: v IN (""" + ", ".join(f"'{w}'" for w in _LISTED) + r"""))) AS concept, doc_id AS fragment, source FROM documents),
e AS (SELECT a.concept AS l, b.concept AS r, count(DISTINCT a.fragment) AS shared, count(DISTINCT a.source) AS sources FROM o a JOIN o b ON a.fragment = b.fragment AND a.concept < b.concept GROUP BY 1, 2 HAVING count(DISTINCT a.source) >= 2 ORDER BY sources DESC, shared DESC, l, r LIMIT 30),
f AS (SELECT e.l, e.r, a.source, min(a.fragment) AS fragment FROM e JOIN o a ON a.concept = e.l JOIN o b ON b.concept = e.r AND b.fragment = a.fragment GROUP BY 1, 2, 3),
g AS (SELECT l, r, string_agg(CAST(fragment AS VARCHAR), ',' ORDER BY fragment) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY fragment) AS p FROM f) x WHERE p <= 8 GROUP BY l, r)
SELECT e.l AS "left", e.r AS "right", e.shared, e.sources, g.evidence FROM e JOIN g ON g.l = e.l AND g.r = e.r""")
def edge_evidence(spark, sf_dir):
    """Pairs of listed words that meet in documents of two sources, with up to eight documents of different sources each."""
    checkpointed(spark)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(mining.TOKEN), F.lit(1)))
    rows = table(spark, sf_dir, "documents").select(F.explode(F.filter(words, lambda w: w.isin(_LISTED))).alias("concept"), F.col("doc_id").alias("fragment"), "source")
    return topics.edges_with_evidence(rows).withColumn("evidence", F.array_join("evidence", ","))
