"""Queries of stored packets, journals, gates, reviews, graphs and concepts over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.canonical import file_uri, set_manifest
from quern.operators import answers, gates, graph, mining, packets, review, scope
from quern.plans.local import checkpointed, kept
from quern.plans.registry import ORACLES, query
from quern.session import table
from quern.streaming import journal

CHAIN = """WITH RECURSIVE e AS (SELECT conv_id, turn, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS s FROM conversations),
c AS (SELECT conv_id, turn, s, repeat('0', 64) AS previous_hash, sha256(conv_id || '|' || s || '|' || t || '|' || repeat('0', 64)) AS event_hash FROM e WHERE s = 0
UNION ALL SELECT e.conv_id, e.turn, e.s, c.event_hash, sha256(e.conv_id || '|' || e.s || '|' || e.t || '|' || c.event_hash) FROM c JOIN e ON e.conv_id = c.conv_id AND e.s = c.s + 1)
"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.chained(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@query(CHAIN + "SELECT conv_id, turn, event_hash, previous_hash FROM c")
def hash_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select("conv_id", "turn", "event_hash", "previous_hash")


@query(CHAIN + """SELECT conv_id, s AS chain_sequence, 'hash' AS fault FROM e WHERE conv_id % 7 = 0 AND s = 1
UNION ALL SELECT conv_id, s, 'sequence' FROM e WHERE conv_id % 7 = 1 AND s > 1 UNION ALL SELECT conv_id, s, 'chain' FROM e WHERE conv_id % 7 = 1 AND s = 2""")
def chain_violations(spark, sf_dir):
    """A journal of which some sessions were changed and others lost an event."""
    second = F.col("chain_sequence") == 1
    rows = _chain(spark, sf_dir).filter(~(second & (F.col("conv_id") % 7 == 1)))
    rows = rows.withColumn("text", F.when(second & (F.col("conv_id") % 7 == 0), F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return journal.violations(rows, "conv_id", "chain_sequence", "text")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", journal.CLOSES).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("kind"), "props")


@query("""WITH w AS (SELECT event_id, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
SELECT event_id, CASE WHEN c = 0 THEN n END AS chain_sequence, CASE WHEN c = 0 THEN 'accepted' ELSE 'closed' END AS status FROM w""")
def journal_append(spark, sf_dir):
    return journal.chained(_events(spark, sf_dir), "user_id", "event_id", "props", "kind").select("event_id", "chain_sequence", "status")


@query("""WITH k AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'closed' ELSE event_type END AS kind, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2)
SELECT user_id, CAST(sum(n) AS BIGINT) AS events, max(last) AS last_sequence, max_by(kind, last) AS last_kind, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds, bool_or(kind = 'closed') AS closed FROM k GROUP BY user_id""")
def journal_replay(spark, sf_dir):
    rows = journal.replayed(_events(spark, sf_dir), "user_id", "event_id", "kind")
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return rows.select("user_id", "events", "last_sequence", "last_kind", kinds.alias("kinds"), "closed")


@query("SELECT user_id, event_type, min(event_id) AS started, CASE WHEN count(*) > 1 THEN max(event_id) END AS completed, count(*) - 1 AS repeats FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)")
def command_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return journal.commands(rows, ["user_id", "event_type", "day"], "event_id").drop("day")


@query(ORACLES["recent_k"])
def recent_k(spark, sf_dir):
    return journal.recent(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id", 3)


@query(ORACLES["version_cap"])
def version_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("candidate_id"))
    return review.per_version_cap(rows, 6).withColumnRenamed("version_id", "l_orderkey")


@query(ORACLES["source_diverse"])
def source_diverse(spark, sf_dir):
    return mining.source_diverse(table(spark, sf_dir, "documents").select("lang", "doc_id", "source", "n_chars"), "lang", "source", "n_chars", "doc_id", 25).select("lang", "doc_id", "place")


@query(ORACLES["review_queue"])
def review_queue(spark, sf_dir):
    targets = table(spark, sf_dir, "documents").select(F.lit(0).alias("created_at"), F.lit("document").alias("target_type"), F.col("doc_id").alias("target_id"), "lang")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("target_id"))
    return review.queue(targets, done, 100).select(F.col("target_id").alias("doc_id"), "lang")


@query("""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 END AS sup, doc_id // 3 AS target, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'defer' END AS action, doc_id % 2 AS c FROM labels)
SELECT target AS target_id FROM d WHERE id NOT IN (SELECT sup FROM d WHERE sup IS NOT NULL) AND action = 'accept' AND c = 0 GROUP BY target HAVING count(*) = 1""")
def relation_admission(spark, sf_dir):
    action = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("defer")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("decision_id"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).alias("supersedes_id"), F.floor(F.col("doc_id") / 3).alias("target_id"), action.alias("action"), F.array(F.concat(F.lit("c"), (F.col("doc_id") % 2).cast("string"))).alias("scope"))
    return review.admission(rows, ["c0"])


# gates
GATE = r"""
WITH c AS (SELECT doc_id AS candidate_id, source, lang, n_chars, 'a' || (doc_id % 3) AS auth, ' ' || regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '[\s]+', ' ', 'g')), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g') || ' ' AS t FROM documents),
r AS (SELECT * FROM (VALUES ('english', 3, '', ['en'], '', [], 'the', FALSE, TRUE), ('romance', 2, '', ['es', 'fr'], '', [], '', TRUE, TRUE), ('any', 5, '', [], '', ['a0', 'a1'], '', FALSE, TRUE), ('nowhere', 1, 'absent', [], 'absent', [], 'no such words', FALSE, FALSE)) v(key, min_groups, src, kinds, fam, auths, anchor, long_, forb)),
a AS (SELECT key, min_groups, candidate_id, source, list_sort(list_filter([
  CASE WHEN src <> '' AND src <> source THEN 'wrong_source' END, CASE WHEN len(kinds) > 0 AND NOT list_contains(kinds, lang) THEN 'wrong_source_kind' END, CASE WHEN fam <> '' AND fam <> source THEN 'wrong_source_family' END,
  CASE WHEN len(auths) > 0 AND NOT list_contains(auths, auth) THEN 'wrong_authority' END, CASE WHEN forb AND (contains(t, ' worthless ') OR contains(t, ' idiot ')) THEN 'forbidden_anchor_present' END,
  CASE WHEN anchor <> '' AND NOT contains(t, ' ' || anchor || ' ') THEN 'missing_anchor_group_0' END, CASE WHEN long_ AND n_chars <= 1000 THEN 'missing_tag_long' END], lambda v: v IS NOT NULL)) AS codes FROM c, r)"""
NONE = "CAST(array() AS array<string>)"
REQUIREMENTS = f"""SELECT * FROM VALUES
('english', 3, {NONE}, array('en'), {NONE}, {NONE}, array(array('the')), {NONE}, array('worthless', 'idiot')),
('romance', 2, {NONE}, array('es', 'fr'), {NONE}, {NONE}, CAST(array() AS array<array<string>>), array('long'), array('worthless', 'idiot')),
('any', 5, {NONE}, {NONE}, {NONE}, array('a0', 'a1'), CAST(array() AS array<array<string>>), {NONE}, array('worthless', 'idiot')),
('nowhere', 1, array('absent'), {NONE}, array('absent'), {NONE}, array(array('no such words')), {NONE}, {NONE})
AS t(key, min_groups, sources_any, source_kinds_any, source_families_any, authorities_any, anchors, tags_all, forbidden)"""


def _assessed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tags = F.when(F.col("n_chars") > 1000, F.array(F.lit("long"))).otherwise(F.array().cast("array<string>"))
    candidates = docs.select(F.col("doc_id").alias("candidate_id"), F.col("doc_id").alias("rank"), F.col("source").alias("source_id"), F.col("lang").alias("source_kind"), F.col("source").alias("source_family"), F.concat(F.lit("a"), (F.col("doc_id") % 3).cast("string")).alias("authority"), tags.alias("tags"), F.col("source").alias("independence_group"), "text")
    return gates.requirement_codes(spark.sql(REQUIREMENTS), candidates)


@query(GATE + " SELECT key, candidate_id, array_to_string(codes, ',') AS codes FROM a")
def requirement_codes(spark, sf_dir):
    return _assessed(spark, sf_dir).select("key", "candidate_id", F.array_join("codes", ",").alias("codes"))


@query(GATE + " SELECT key, candidate_id, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY len(codes), candidate_id) AS place FROM a WHERE len(codes) > 0) q WHERE place <= 3")
def closest_rejected(spark, sf_dir):
    return gates.closest(_assessed(spark, sf_dir)).select("key", "candidate_id", F.col("place").cast("long").alias("place"))


CASES = "('a', TRUE, 1, 'any'), ('a', TRUE, 1, 'romance'), ('b', TRUE, 1, 'any'), ('b', TRUE, 1, 'nowhere'), ('c', TRUE, 1, 'nowhere'), ('d', FALSE, 1, 'any'), ('e', FALSE, 1, 'nowhere'), ('f', TRUE, 100000, 'any')"


@query(GATE + f""", g AS (SELECT key, min_groups, count(DISTINCT CASE WHEN len(codes) = 0 THEN source END) >= min_groups AS covered FROM a GROUP BY key, min_groups),
k AS (SELECT * FROM (VALUES {CASES}) v(case_id, in_corpus, min_total, key)),
n AS (SELECT case_id, in_corpus, min_total, count(*) AS requirements, count(CASE WHEN covered THEN 1 END) AS covered FROM k JOIN g USING (key) GROUP BY ALL),
d AS (SELECT case_id, count(DISTINCT source) AS groups FROM k JOIN g USING (key) JOIN a USING (key) WHERE covered AND len(codes) = 0 GROUP BY case_id)
SELECT case_id, requirements, n.covered AS covered, coalesce(groups, 0) AS groups, CASE WHEN requirements = n.covered AND coalesce(groups, 0) >= min_total THEN CASE WHEN in_corpus THEN 'ready' ELSE 'gap_challenged' END WHEN NOT in_corpus THEN 'gap_preserved' WHEN n.covered > 0 THEN 'partial' ELSE 'insufficient' END AS decision FROM n LEFT JOIN d USING (case_id)""")
def gate_decision(spark, sf_dir):
    """Six cases that meet all five outcomes of the decision table."""
    cases = spark.sql(f"SELECT * FROM VALUES {CASES} AS t(case_id, in_corpus, min_total, key)")
    return gates.decide(cases, _assessed(spark, sf_dir)).select("case_id", "requirements", "covered", "groups", "decision")


@query("""WITH p AS (SELECT p_brand || '-' || p_size AS key, count(*) AS n, min(CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END) AS c FROM part GROUP BY 1)
SELECT key, 'duplicate_key' AS fault FROM p WHERE n > 1 UNION ALL SELECT key, 'no_positive_condition' FROM p WHERE c = 0""")
def spec_faults(spark, sf_dir):
    empty = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("key"), F.when(F.col("p_retailprice") > 1000, F.array("p_type")).otherwise(empty).alias("source_kinds_any"), *[empty.alias(c) for c in ("sources_any", "source_families_any", "authorities_any", "tags_all")], F.array().cast("array<array<string>>").alias("anchors"))
    return gates.spec_faults(rows)


@query("""WITH s AS (SELECT l_partkey AS s, l_suppkey AS f, CASE WHEN l_quantity > 49 THEN 9 ELSE l_suppkey % 5 END AS g FROM lineitem)
SELECT 'source' AS kind, CAST(s AS VARCHAR) AS id FROM s GROUP BY s HAVING count(DISTINCT f) > 1 OR count(DISTINCT g) > 1 UNION ALL SELECT 'family', CAST(f AS VARCHAR) FROM s GROUP BY f HAVING count(DISTINCT g) > 1""")
def lineage_faults(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("source_family"), F.when(F.col("l_quantity") > 49, 9).otherwise(F.col("l_suppkey") % 5).alias("independence_group"))
    return gates.lineage_faults(rows)


@query("SELECT doc_id AS answer_id, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id END AS fragment_id, unnest(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'not_in_packet' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 = 0 THEN 'quote_not_in_excerpt' END, CASE WHEN doc_id % 11 = 0 OR doc_id % 17 = 0 THEN 'lines_changed' END], lambda v: v IS NOT NULL)) AS fault FROM documents")
def contract_faults(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    odd = lambda n, then, other: F.when(F.col("doc_id") % n == 0, then).otherwise(other)
    head = F.substring_index("text", "\n", 2)
    quotes = docs.select(F.col("doc_id").alias("answer_id"), odd(11, F.lit(-1), F.col("doc_id")).alias("fragment_id"), odd(13, F.concat(F.lit("zz~"), "doc_id"), F.substring("text", 1, 20)).alias("quote"), F.lit(1).alias("line_from"), F.lit(2).alias("line_to"), odd(17, F.lit("x"), F.sha2(head, 256)).alias("lines_hash"))
    packet = docs.select(F.col("doc_id").alias("fragment_id"), F.substring("text", 1, 100).alias("excerpt"))
    return gates.contract_faults(quotes, packet, docs.select(F.col("doc_id").alias("fragment_id"), "text"))


@query("""WITH s AS (SELECT doc_id AS answer_id, quality = 1 AS e, toxic = 0 AS c, doc_id % 3 <> 0 AS m FROM labels)
SELECT answer_id, CASE WHEN e THEN 'passed' ELSE 'failed' END AS exact, CASE WHEN NOT e THEN 'skipped' WHEN c THEN 'passed' ELSE 'failed' END AS coverage, CASE WHEN NOT (e AND c) THEN 'skipped' WHEN m THEN 'passed' ELSE 'failed' END AS semantic, e AND c AND m AS valid FROM s""")
def unified_validation(spark, sf_dir):
    return gates.validated(table(spark, sf_dir, "labels").selectExpr("doc_id AS answer_id", "quality = 1 AS exact", "toxic = 0 AS coverage", "doc_id % 3 <> 0 AS semantic"))


@query("SELECT conv_id AS trace_id, turn AS step, conv_id % 3 <> 0 AS closed, CAST(1 AS BIGINT) AS grounds FROM conversations")
def reasoning_closure(spark, sf_dir):
    """Turns as steps that follow from the turn before; the first turn of two conversations in three is supported."""
    checkpointed(spark)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("step"))
    first = rows.groupBy("trace_id").agg(F.min("step").alias("_f"))
    steps = rows.join(first, "trace_id").select("trace_id", "step", F.when(F.col("step") > F.col("_f"), F.col("step") - 1).alias("premise"))
    return gates.reasoning_closure(steps, first.filter("trace_id % 3 <> 0").select("trace_id", F.col("_f").alias("step")))


# packets and permits
RESULTS = "WITH s AS (SELECT lang AS query_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, doc_id AS id FROM documents), r AS (SELECT *, 1.5 * rank AS score FROM s WHERE rank <= 20)"


def _results(spark, sf_dir):
    return spark.sql(RESULTS.replace("FROM documents", "FROM {documents}") + " SELECT query_id, rank, id, CAST(score AS DOUBLE) AS score FROM r", documents=table(spark, sf_dir, "documents"))


@query(RESULTS + " SELECT query_id, count(*) AS items, sha256(string_agg(rank || '|' || id || '|' || printf('%.6f', CAST(score AS DOUBLE)), chr(10) ORDER BY rank)) AS packet_hash FROM r GROUP BY query_id")
def packet_hashes(spark, sf_dir):
    return packets.packets(_results(spark, sf_dir))


@query(RESULTS + " SELECT DISTINCT query_id, CASE query_id WHEN 'de' THEN 'changed' ELSE 'lost' END AS state FROM r WHERE query_id IN ('de', 'fr')")
def packets_altered(spark, sf_dir):
    """Stored packets against rows of which one packet lost its first item's score and another is gone."""
    rows = _results(spark, sf_dir)
    later = rows.filter("query_id <> 'fr'").withColumn("score", F.when((F.col("query_id") == "de") & (F.col("rank") == 1), 0.0).otherwise(F.col("score")))
    return packets.altered(packets.packets(rows), later)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS r, sha256(CAST(l_suppkey AS VARCHAR)) AS h FROM lineitem),
b AS (SELECT r, substr(h, 1, 4) AS bucket, count(*) AS n, sha256(string_agg(h, chr(30) ORDER BY h)) AS bh FROM m GROUP BY r, substr(h, 1, 4)),
p AS (SELECT r, CAST(sum(n) AS BIGINT) AS members, sha256(string_agg(bucket || bh, chr(30) ORDER BY bucket)) AS set_hash FROM b GROUP BY r)
SELECT set_hash, members, count(*) AS requests FROM p GROUP BY set_hash, members""")
def read_sets(spark, sf_dir):
    return packets.read_sets(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("member")))


@query("SELECT doc_id, sha256(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || length(lang) || ':' || lang || '2:p1') AS token FROM documents")
def permit_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", packets.permit(F.col("doc_id"), F.col("lang"), F.lit("p1")).alias("token"))


@query("SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NOT NULL THEN length(text) END AS opened FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 5 <> 0) l USING (doc_id)")
def permitted_texts(spark, sf_dir):
    """Texts that a permit opens: those of good documents, of whose tokens one in five is false."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    parts = docs.join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang", F.lit("p1").alias("policy"))
    token = packets.permit(F.col("doc_id"), F.col("lang"), F.col("policy"))
    permits = parts.withColumn("token", F.when(F.col("doc_id") % 5 == 0, F.lit("false")).otherwise(token))
    return packets.read_text(docs, permits, "doc_id").select("doc_id", "lang", F.length("text").cast("long").alias("opened"))


@query("""WITH s AS (SELECT lang AS question, source AS query_id, doc_id % 40 AS id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
p AS (SELECT question, id, min(rank) AS best, count(DISTINCT query_id) AS forms FROM s GROUP BY question, id)
SELECT question, id, best, forms, row_number() OVER (PARTITION BY question ORDER BY best, forms DESC, id) AS place FROM p QUALIFY place <= 10""")
def fused_queries(spark, sf_dir):
    rows = spark.sql("SELECT lang AS question, source AS query_id, doc_id % 40 AS id, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS BIGINT) AS rank FROM {documents}", documents=table(spark, sf_dir, "documents"))
    return packets.fused(rows)


# concepts
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '([\p{L}\p{N}]+)', 1)"
CONCEPTS = ["clown", "idiot", "worthless", "trash", "scum", "loser", "moron", "pathetic", "the blend", "no such phrase at all"]
GRAMS = "list_distinct(list_concat(w, list_concat(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))))"


def _phrases(spark):
    return spark.createDataFrame([(c,) for c in CONCEPTS], "phrase string")


def _occurrences_sql(phrases: str) -> str:
    return f"WITH q AS ({phrases}), w AS (SELECT doc_id, source, {TOKENS} AS w FROM documents), g AS (SELECT doc_id, source, unnest({GRAMS}) AS phrase FROM w), o AS (SELECT g.* FROM g SEMI JOIN q USING (phrase)), c AS (SELECT phrase, count(DISTINCT doc_id) AS df, count(DISTINCT source) AS sources FROM o GROUP BY phrase)"


LISTED = f"SELECT unnest({CONCEPTS!r}) AS phrase"


@query(f"WITH e AS (SELECT item_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark) SELECT term, count(*) AS queries FROM e, n GROUP BY term, n HAVING count(*) >= greatest(2, ceil(n / 2))")
def query_stop_terms(spark, sf_dir):
    return mining.common_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(_occurrences_sql(f"SELECT DISTINCT unnest({GRAMS}) AS phrase FROM (SELECT list_filter({TOKENS}, lambda v: v NOT IN ('the', 'of', 'and')) AS w FROM benchmark)") + " SELECT phrase, df, sources FROM c WHERE df >= 3 AND sources >= 2")
def query_anchors(spark, sf_dir):
    return mining.query_anchors(table(spark, sf_dir, "benchmark"), "text", table(spark, sf_dir, "documents"), "doc_id", "text", "source", ["the", "of", "and"])


@query(_occurrences_sql(LISTED) + " SELECT phrase, df, sources FROM c WHERE df >= 3 AND sources >= 2")
def literal_closure(spark, sf_dir):
    return mining.literal_closure(_phrases(spark), table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@query(_occurrences_sql(LISTED) + ", m AS (SELECT phrase, doc_id % 3 AS component, avg((doc_id % 8) / 8.0) AS mean FROM o GROUP BY 1, 2) SELECT phrase, component, CAST(mean AS DOUBLE) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY mean DESC, component) AS r FROM m) WHERE r = 1")
def anchor_components(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = mining.occurrences(_phrases(spark), docs, "doc_id", "text", "source").withColumnRenamed("doc_id", "key")
    return mining.assigned(found, docs.select(F.col("doc_id").alias("key"), (F.col("doc_id") % 3).alias("component"), ((F.col("doc_id") % 8) / 8.0).alias("loading")))


@query(_occurrences_sql(LISTED) + """, e AS (SELECT a.phrase AS l, b.phrase AS r, count(DISTINCT a.source) AS s FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.phrase < b.phrase GROUP BY 1, 2 HAVING count(DISTINCT a.source) >= 2 ORDER BY s DESC, count(DISTINCT a.doc_id) DESC, l, r LIMIT 30), d AS (SELECT l AS p FROM e UNION SELECT r FROM e)
SELECT (SELECT count(*) FROM q) AS concepts, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE s >= 2) AS multi_source, (SELECT count(*) FROM q WHERE phrase NOT IN (SELECT p FROM d)) AS isolated, CAST(0 AS BIGINT) AS dangling""")
def concept_metrics(spark, sf_dir):
    checkpointed(spark)
    found = kept(mining.occurrences(_phrases(spark), table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    edges = mining.cooccurrence(found.select(F.col("phrase").alias("concept"), F.col("doc_id").alias("fragment"), "source"))
    return mining.concept_metrics(_phrases(spark).withColumnRenamed("phrase", "concept"), edges)


# snapshots, identities and structure
@query("""WITH d AS (SELECT lang, count(*) AS n, count(CASE WHEN NOT (lang = 'de' AND doc_id % 10 = 0) THEN 1 END) AS m, count(CASE WHEN lang = 'fr' AND doc_id % 10 = 1 THEN 1 END) AS c FROM documents GROUP BY lang)
SELECT lang AS collection, CASE WHEN n <> m THEN 'count' ELSE 'content' END AS fault FROM d WHERE n <> m OR c > 0""")
def snapshot_faults(spark, sf_dir):
    """A stored snapshot against members of which one collection lost some and another changed some."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), "doc_id", F.sha2("text", 256).alias("h"))
    member = F.concat_ws("\x1f", F.col("doc_id").cast("string"), "h")
    later = docs.filter("NOT (collection = 'de' AND doc_id % 10 = 0)").withColumn("h", F.when((F.col("collection") == "fr") & (F.col("doc_id") % 10 == 1), F.lit("other")).otherwise(F.col("h")))
    return scope.snapshot_faults(*[set_manifest(x.select("collection", member.alias("member")), "collection", "member") for x in (docs, later)])


@query("""WITH b AS (SELECT l_partkey AS s, l_partkey % 50 + CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END AS l, l_partkey % 25 AS f FROM lineitem)
SELECT 'rebound' AS fault, CAST(s AS VARCHAR) AS id FROM b GROUP BY s HAVING count(DISTINCT l) > 1 UNION ALL SELECT 'families', CAST(l AS VARCHAR) FROM b GROUP BY l HAVING count(DISTINCT f) > 1""")
def identity_faults(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), (F.col("l_partkey") % 50 + F.when(F.col("l_quantity") > 49, 1).otherwise(0)).alias("logical_id"), (F.col("l_partkey") % 25).alias("family"))
    return scope.identity_faults(rows)


@query("""WITH f AS (SELECT conv_id AS v, turn AS o FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 1)), p AS (SELECT v, v % 4 <> 0 AS md, max(o) - min(o) + 1 <> count(*) AS gaps FROM f GROUP BY v), x AS (SELECT count(*) > 0 AS out_ FROM f WHERE v % 100 = 3)
SELECT v AS version_id, unnest(list_filter([CASE WHEN NOT md THEN 'not_markdown' END, CASE WHEN gaps THEN 'not_contiguous' END, CASE WHEN md AND out_ THEN 'scope_exclusion' END], lambda r: r IS NOT NULL)) AS reason FROM p, x""")
def structure_exclusions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("NOT (conv_id % 5 = 0 AND turn = 1)").selectExpr("conv_id AS version_id", "concat(conv_id, '.', turn) AS fragment_id", "turn AS ordinal", "conv_id % 4 <> 0 AS markdown")
    return scope.structure_exclusions(rows, rows.filter("version_id % 100 = 3").select("fragment_id"))


@query("WITH f AS (SELECT l_orderkey AS u, l_linenumber AS f, bool_or(l_quantity > 45) AS a, bool_or(l_returnflag <> 'R') AS p FROM lineitem GROUP BY 1, 2) SELECT u AS unit_id FROM f GROUP BY u HAVING bool_or(a) AND bool_and(p)")
def units_around(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS unit_id", "concat(l_orderkey, '.', l_linenumber) AS fragment_id", "l_quantity", "l_returnflag")
    return scope.units_around(rows.select("unit_id", "fragment_id"), rows.filter("l_quantity > 45"), rows.filter("l_returnflag <> 'R'"))


@query(r"""WITH u AS (SELECT rtrim(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages), p AS (SELECT DISTINCT p FROM (SELECT p FROM u UNION ALL SELECT split_part(p, '/', 1) FROM u) WHERE p IS NOT NULL)
SELECT a.p AS "outer", b.p AS "inner" FROM p a JOIN p b ON starts_with(b.p, a.p || '/')""")
def path_containment(spark, sf_dir):
    url = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/+$", "")
    rows = table(spark, sf_dir, "pages").select(F.explode(F.array(url, F.substring_index(url, "/", 1))).alias("path")).filter("path IS NOT NULL")
    return scope.contained_paths(rows)


@query("SELECT a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus AND a.o_orderkey < b.o_orderkey AND year(a.o_orderdate) <> year(b.o_orderdate)")
def comparable_pairs(spark, sf_dir):
    """Orders as requests: one question, budget and contract each, over collections by year."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.year("o_orderdate").alias("collection"), "o_custkey", "o_orderpriority", "o_orderstatus")
    return scope.comparable(rows, ["o_custkey", "o_orderpriority", "o_orderstatus"])


@query("SELECT v.place, n.n_nationkey, n.n_name FROM (VALUES (1, 5), (2, 0), (3, 5), (4, 99)) v(place, n_nationkey) JOIN nation n USING (n_nationkey)")
def ordered_lookup(spark, sf_dir):
    keys = spark.sql("SELECT * FROM VALUES (1, 5), (2, 0), (3, 5), (4, 99) AS t(place, n_nationkey)")
    return scope.ordered_lookup(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), keys, "n_nationkey").select("place", "n_nationkey", "n_name")


@query("SELECT p_partkey, 'file:///library/' || replace(p_name, ' ', '%20') || '/' || p_partkey || '.md' AS uri FROM part")
def file_uris(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", file_uri("/library", F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md"))).alias("uri"))


# graphs
@query("""WITH g AS (SELECT ['claim', 'statement', 'concept_meaning', 'structure_unit'][l_linenumber % 4 + 1] AS node_type, l_orderkey AS node_id, l_quantity AS q FROM lineitem)
SELECT DISTINCT node_type, node_id FROM g WHERE node_type <> 'claim' AND q >= 40""")
def seeds_from_fragments(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ["claim", "statement", "concept_meaning", "structure_unit"])), F.col("l_linenumber") % 4 + 1)
    rows = table(spark, sf_dir, "lineitem").select(kinds.alias("node_type"), F.col("l_orderkey").alias("node_id"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("fragment_id"), "l_quantity")
    return graph.seeds(rows.filter("l_quantity >= 40").select("fragment_id"), rows.select("node_type", "node_id", "fragment_id"))


@query("""WITH l AS (SELECT *, l_orderkey || '.' || l_linenumber AS f FROM lineitem)
SELECT 'order' AS node_type, o_orderkey AS node_id, f AS fragment_id FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_totalprice > 300000 UNION SELECT 'part', p_partkey, f FROM part JOIN l ON l_partkey = p_partkey WHERE p_size = 1 UNION SELECT 'supplier', s_suppkey, f FROM supplier JOIN l ON l_suppkey = s_suppkey WHERE s_acctbal < 0""")
def node_grounding(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("fragment_id", F.concat_ws(".", "l_orderkey", "l_linenumber"))
    node = lambda name, test, kind, key: table(spark, sf_dir, name).filter(test).select(F.lit(kind).alias("node_type"), F.col(key).cast("long").alias("node_id"))
    nodes = node("orders", "o_totalprice > 300000", "order", "o_orderkey").unionByName(node("part", "p_size = 1", "part", "p_partkey")).unionByName(node("supplier", "s_acctbal < 0", "supplier", "s_suppkey"))
    links = {kind: items.select(F.col(key).cast("long").alias("node_id"), "fragment_id") for kind, key in (("order", "l_orderkey"), ("part", "l_partkey"), ("supplier", "l_suppkey"))}
    return graph.grounding_of(nodes, links)


@query("""WITH i AS (SELECT l_suppkey AS s, l_partkey AS o, l_quantity AS q FROM lineitem), d AS (SELECT s, o, bool_or(q < 10) AS held FROM i GROUP BY s, o)
SELECT (SELECT count(*) FROM i) AS received, count(*) AS "distinct", count(CASE WHEN NOT held THEN 1 END) AS inserted, count(CASE WHEN held THEN 1 END) AS known FROM d""")
def relation_import(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("'supplies' AS relation_type", "l_suppkey AS subject_id", "l_partkey AS object_id", "l_quantity")
    few = rows.filter("l_quantity < 10").drop("l_quantity")
    held, _ = graph.import_relations(few.selectExpr("'' AS relation_id").limit(0), few)
    return graph.import_relations(held, rows.drop("l_quantity"))[1]


# reviews and imports
TABLES = {"document": ("documents", "doc_id"), "page": ("pages", "page_id"), "item": ("benchmark", "item_id"), "label": ("labels", "doc_id"), "order": ("orders", "o_orderkey"), "part": ("part", "p_partkey"), "customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey")}


@query(" UNION ALL ".join(f"SELECT CAST({k} % 100 AS VARCHAR) AS created_at, '{kind}' AS target_type, CAST({k} AS VARCHAR) AS target_id FROM {t}" for kind, (t, k) in TABLES.items()))
def candidate_stubs(spark, sf_dir):
    return review.stubs({kind: (table(spark, sf_dir, t).select((F.col(k) % 100).alias("at"), k), "at", k) for kind, (t, k) in TABLES.items()})


@query("""WITH d AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN doc_id - 1 WHEN 1 THEN doc_id - 2 END AS sup, doc_id // 3 AS target, CASE WHEN doc_id % 13 = 0 THEN 'c9' ELSE 'c' || (doc_id % 2) END AS scope FROM labels)
SELECT id AS decision_id, 'stale' AS fault FROM d WHERE id % 11 = 0 UNION ALL SELECT id, 'scope' FROM d WHERE id % 13 = 0
UNION ALL SELECT id, 'second' FROM (SELECT id, row_number() OVER (PARTITION BY target, scope ORDER BY id) AS n FROM d WHERE id NOT IN (SELECT sup FROM d WHERE sup IS NOT NULL)) x WHERE n > 1
UNION ALL SELECT id, 'forked' FROM (SELECT id, row_number() OVER (PARTITION BY sup ORDER BY id) AS n FROM d WHERE sup IS NOT NULL) y WHERE n > 1""")
def decision_faults(spark, sf_dir):
    i = F.col("doc_id")
    target = F.floor(i / 3)
    rows = table(spark, sf_dir, "labels").select(i.alias("decision_id"), F.when(i % 5 == 0, i - 1).when(i % 5 == 1, i - 2).alias("supersedes_id"), target.alias("target_id"), F.when(i % 11 == 0, "old").otherwise(F.concat(F.lit("h"), target.cast("string"))).alias("target_hash"), F.array(F.when(i % 13 == 0, "c9").otherwise(F.concat(F.lit("c"), (i % 2).cast("string")))).alias("scope"))
    targets = rows.select("target_id").distinct().select("target_id", F.concat(F.lit("h"), F.col("target_id").cast("string")).alias("hash"), F.array(F.lit("c0"), F.lit("c1")).alias("collections"))
    return review.decision_faults(rows, targets)


@query("""WITH o AS (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT doc_id) > 10)
SELECT doc_id AS import_key, unnest(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'unknown_fragment' END, CASE WHEN doc_id % 9 <> 0 AND doc_id % 7 = 0 THEN 'inexact_quote' END, CASE WHEN doc_id % 5 = 0 THEN 'no_voice' END, CASE WHEN source IN (SELECT source FROM o) THEN 'over_cap' END], lambda v: v IS NOT NULL)) AS fault FROM documents""")
def proposal_faults(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    odd = lambda n, then, other: F.when(F.col("doc_id") % n == 0, then).otherwise(other)
    rows = docs.select(F.col("doc_id").alias("import_key"), F.col("source").alias("version_id"), odd(9, F.lit(-1), F.col("doc_id")).alias("fragment_id"), odd(7, F.concat(F.lit("zz~"), "doc_id"), F.substring("text", 1, 15)).alias("quote"), odd(5, F.lit(""), F.col("lang")).alias("voice"))
    return review.proposal_faults(rows, docs.select(F.col("doc_id").alias("fragment_id"), "text"), 10)


@query("""WITH d AS (SELECT doc_id AS decision_id, doc_id % 10 AS packet_id, doc_id % 100 AS created_at FROM labels)
SELECT decision_id, created_at FROM d WHERE packet_id = 3 ORDER BY created_at, decision_id LIMIT 200""")
def packet_decisions(spark, sf_dir):
    """Three logs that share decisions: each is listed once."""
    rows = table(spark, sf_dir, "labels").selectExpr("doc_id AS decision_id", "CAST(doc_id % 10 AS STRING) AS packet_id", "doc_id % 100 AS created_at")
    return review.packet_decisions([rows.filter("decision_id % 3 <> 0"), rows.filter("decision_id % 3 <> 1"), rows.filter("decision_id % 3 <> 2")], "3", 200).select("decision_id", "created_at")


@query("SELECT doc_id, CAST(ceil(count(*) OVER () / 30.0) AS BIGINT) AS pages FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 30")
def page_of_rows(spark, sf_dir):
    return answers.page(table(spark, sf_dir, "documents").filter("lang = 'es'").select("doc_id"), "doc_id", 1)
