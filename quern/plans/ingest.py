"""The query of ingest outcomes, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.session import table
from quern.sources import fragments


@query(r"""WITH f AS (SELECT lang, CASE WHEN doc_id % 4 = 2 THEN 'skipped' WHEN doc_id % 4 = 3 OR doc_id % 8 = 1 OR NOT regexp_matches(coalesce(text, ''), '[^\s]') THEN 'failed' ELSE 'processed' END AS status,
  CASE WHEN doc_id % 4 = 2 THEN 'unsupported_media_type' WHEN doc_id % 4 = 3 THEN 'parser_output_invalid' WHEN doc_id % 8 = 1 THEN 'invalid_utf8' WHEN NOT regexp_matches(coalesce(text, ''), '[^\s]') THEN 'no_extractable_text' END AS failure_code FROM documents),
w AS (SELECT lang, count(*) FILTER (status = 'processed') AS good, count(*) AS every FROM f GROUP BY lang)
SELECT f.lang, f.status, f.failure_code, count(*) AS files, any_value(CASE WHEN good = every THEN 'complete' WHEN good > 0 THEN 'partial' ELSE 'failure' END) AS state FROM f JOIN w ON w.lang IS NOT DISTINCT FROM f.lang GROUP BY f.lang, f.status, f.failure_code""")
def ingest_outcomes(spark, sf_dir):
    """Documents as files of four types, some with broken bytes: what became of each, by language."""
    docs = table(spark, sf_dir, "documents")
    k, text = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".txt", ".bin", ".fb2"))), (k % 4 + 1).cast("int"))
    content = F.when(k % 8 == 1, F.concat(F.unhex(F.lit("FF")), text)).otherwise(text)
    path = F.concat(F.lit("/in/"), F.coalesce("lang", F.lit("")), F.lit("/"), k.cast("string"), suffix)
    files = docs.select(path.alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.length(content).cast("long").alias("length"), content.alias("content"))
    found = fragments.outcomes(fragments.parse(fragments.described(files, "/in")))
    lang = F.nullif(F.regexp_extract("relative_path", "^([^/]*)/", 1), F.lit(""))
    return fragments.catalog(found.withColumn("lang", lang), "lang").drop("units")
