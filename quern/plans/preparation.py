"""Queries of answer preparation, the blob store, identity manifests and versions by profile, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import preparation, scope
from quern.plans.local import checkpointed, scratch
from quern.plans.registry import query
from quern.session import table
from quern.sources import blobs

# Cases are languages; each asks for texts of over 300 characters from some sources, first among its ten shortest texts,
# then among its twenty longest. Texts under 60 characters are withheld.
PREPARED = """WITH d AS (SELECT coalesce(lang, 'none') AS case_id, doc_id, source, coalesce(n_chars, 0) AS n FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n, doc_id) AS up, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, doc_id) AS down FROM d),
c AS (SELECT DISTINCT case_id, 1 + length(case_id) % 2 AS g, CASE WHEN case_id >= 'f' THEN 100 ELSE 1 END AS t FROM d),
b AS (SELECT case_id, doc_id, source, n, row_number() OVER (PARTITION BY case_id ORDER BY up) AS rank FROM w WHERE up <= 10 AND n >= 60),
f AS (SELECT c.case_id, count(DISTINCT CASE WHEN n > 300 THEN source END) AS k FROM c LEFT JOIN b USING (case_id) GROUP BY 1),
s AS (SELECT case_id, NOT (k >= g AND k >= t) AS drilled FROM c JOIN f USING (case_id)),
l AS (SELECT w.case_id, w.doc_id, w.source, w.n, w.down FROM w JOIN s USING (case_id) WHERE drilled AND down <= 20 AND n >= 60 AND NOT EXISTS (SELECT 1 FROM b WHERE b.case_id = w.case_id AND b.doc_id = w.doc_id)),
a AS (SELECT case_id, doc_id, source, n, rank FROM b UNION ALL SELECT case_id, doc_id, source, n, coalesce((SELECT max(rank) FROM b WHERE b.case_id = l.case_id), 0) + row_number() OVER (PARTITION BY case_id ORDER BY down) FROM l),
k AS (SELECT c.case_id, g, t, drilled, count(DISTINCT CASE WHEN n > 300 THEN source END) AS k FROM c JOIN s USING (case_id) LEFT JOIN a USING (case_id) GROUP BY ALL),
v AS (SELECT case_id, drilled, g, t, CASE WHEN k >= g AND k >= t THEN 'ready' WHEN k >= g THEN 'partial' ELSE 'insufficient' END AS decision FROM k),
o AS (SELECT case_id, doc_id, rank, row_number() OVER (PARTITION BY case_id, source ORDER BY rank) AS own FROM a WHERE n > 300),
p AS (SELECT *, sum(CASE WHEN own = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY rank) AS place FROM o)
"""


def _prepared(spark, sf_dir):
    checkpointed(spark)
    rows = """SELECT coalesce(lang, 'none') AS case_id, doc_id AS candidate_id, source AS independence_group, coalesce(n_chars, 0) AS n FROM {documents}"""
    docs = spark.sql(rows, documents=table(spark, sf_dir, "documents"))
    ranked = docs.selectExpr("*", "row_number() OVER (PARTITION BY case_id ORDER BY n, candidate_id) AS up", "row_number() OVER (PARTITION BY case_id ORDER BY n DESC, candidate_id) AS down")
    asked = docs.select("case_id").distinct().selectExpr("case_id", "'long' AS key", "TRUE AS in_corpus", "1 + length(case_id) % 2 AS min_groups", "CASE WHEN case_id >= 'f' THEN 100 ELSE 1 END AS min_total")

    def assessed(order: str, most: int):
        found = ranked.filter(F.col(order) <= most).withColumn("rank", F.col(order).cast("long")).withColumn("reasons", F.array_compact(F.array(F.when(F.col("n") < 60, "short"))))
        codes = F.array_compact(F.array(F.when(F.col("n") <= 300, "missing_tag_long")))
        return preparation.eligible(found, ["independence_group"]).select("case_id", F.lit("long").alias("key"), "candidate_id", "rank", "independence_group", codes.alias("codes"))

    return preparation.prepare(asked.select("case_id", "in_corpus", "min_total"), asked.select("case_id", "key", "min_groups"), assessed("up", 10), assessed("down", 20))


@query(PREPARED + "SELECT case_id, drilled, decision FROM v")
def answer_preparation(spark, sf_dir):
    return _prepared(spark, sf_dir)[0].select("case_id", "drilled", "decision")


@query(PREPARED + "SELECT case_id, doc_id AS candidate_id, rank FROM p JOIN v USING (case_id) WHERE decision <> 'ready' OR (own = 1 AND place <= greatest(g, t))")
def prepared_evidence(spark, sf_dir):
    return _prepared(spark, sf_dir)[1].select("case_id", "candidate_id", "rank")


@query("SELECT DISTINCT sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3) AS relative_path, TRUE AS intact FROM benchmark WHERE text IS NOT NULL")
def blob_store(spark, sf_dir):
    """The benchmark's texts as blobs, stored in the shared folder and read back."""
    root = scratch(spark, "blobs")
    root = root if "://" in root or not root.startswith("/") else f"file://{root}"
    made = blobs.promote(table(spark, sf_dir, "benchmark"), root, "text")
    path = scratch(spark, "blob-records")
    made.write.parquet(path)
    records = spark.read.parquet(path)
    faults = blobs.verify(records, root).select("relative_path", F.lit(False).alias("_ok"))
    return records.join(faults, "relative_path", "left").select("sha256", "bytes", "relative_path", F.coalesce("_ok", F.lit(True)).alias("intact"))


@query("""WITH f AS (SELECT 'o/' || o_orderkey AS relative_path, o_orderkey AS k FROM orders)
SELECT relative_path, 'undeclared' AS fault FROM f WHERE k % 7 = 0 UNION ALL SELECT relative_path || '.x', 'absent' FROM f WHERE k % 11 = 0 UNION ALL SELECT relative_path, 'repeated' FROM f WHERE k % 13 = 0 AND k % 7 <> 0""")
def manifest_faults(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("concat('o/', o_orderkey) AS relative_path", "o_orderkey AS k")
    entry = lambda path: F.struct(path.alias("relative_path"), F.col("k").alias("logical_id"))
    own = F.col("relative_path")
    entries = F.array_compact(F.array(F.when(F.col("k") % 7 != 0, entry(own)), F.when((F.col("k") % 13 == 0) & (F.col("k") % 7 != 0), entry(own)), F.when(F.col("k") % 11 == 0, entry(F.concat(own, F.lit(".x"))))))
    return scope.manifest_faults(files.select("relative_path"), files.select(F.inline(entries)))


@query("SELECT sha256(text) AS sha256, count(DISTINCT source) AS families FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def lineage_conflicts(spark, sf_dir):
    return scope.lineage_conflicts(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), "source"), "source")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS uri, 'a' AS sha256, CASE WHEN o_orderkey % 2 = 0 THEN 'p1' WHEN o_orderkey % 3 = 0 THEN 'p2' ELSE 'p3' END AS profile,
CASE WHEN o_orderkey % 2 = 0 THEN 'reverted' WHEN o_orderkey % 3 = 0 THEN 'unchanged' ELSE 'changed' END AS disposition, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS BIGINT) AS version FROM orders""")
def profile_disposition(spark, sf_dir):
    """The same bytes read with another parser profile are another version."""
    rows = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS uri", "'a' AS sha256", "CASE WHEN o_orderkey % 2 = 0 THEN 'p1' WHEN o_orderkey % 3 = 0 THEN 'p2' ELSE 'p3' END AS profile")
    known = rows.selectExpr("uri", "sha256", "inline(array(struct('p1' AS profile, 1 AS version, FALSE AS is_head), struct('p2' AS profile, 2 AS version, TRUE AS is_head)))")
    return scope.disposition(rows, known, ("profile",))
