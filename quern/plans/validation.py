"""Queries of answer validation, candidate receipts and times, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import atlas, validation
from quern.plans.local import checkpointed, kept
from quern.plans.registry import query
from quern.session import table

#: Orders as answers of a customer's task, their items as claims with evidence and a judgment each.
_ANSWERS = """i AS (SELECT DISTINCT l_orderkey AS a, l_linenumber AS line, l_orderkey || '.' || l_linenumber AS claim FROM lineitem),
e AS (SELECT DISTINCT l_orderkey AS a, l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS ev, l_suppkey AS supp, l_discount >= 0.03 AS used, l_tax > 0.07 AS loose FROM lineitem),
an AS (SELECT o_orderkey AS a, o_custkey AS task, o_orderstatus AS status, CASE WHEN o_totalprice > 100000 THEN 'gap' END AS gap, o_orderpriority = '1-URGENT' AS needs FROM orders)"""

_COVERED = _ANSWERS + """,
f AS (SELECT a, supp % 2 AS facet, count(DISTINCT CASE WHEN used THEN ev END) AS n, bool_or(loose) AS outside FROM e GROUP BY a, supp % 2),
s AS (SELECT a, count(DISTINCT CASE WHEN used THEN supp END) AS cited FROM e GROUP BY a),
v AS (SELECT an.a, coalesce(sum(CASE WHEN n >= 1 AND NOT outside THEN 1 END), 0) AS covered, count(facet) AS required, any_value(coalesce(cited, 0)) AS cited,
  list_filter(list_concat(flatten(list([CASE WHEN outside THEN 'facet_outside_packet:' || facet END, CASE WHEN NOT (n >= 1 AND NOT outside) THEN 'facet_missing:' || facet END])),
    [CASE WHEN any_value(status) = 'P' THEN 'status_not_allowed' END, CASE WHEN any_value(needs) AND any_value(gap) IS NULL THEN 'open_gap_required' END, CASE WHEN any_value(coalesce(cited, 0)) < 2 THEN 'cited_sources' END]), lambda z: z IS NOT NULL) AS codes
  FROM an LEFT JOIN f USING (a) LEFT JOIN s USING (a) GROUP BY an.a)"""


def _coverage(spark, sf_dir):
    """Each order is a task of its own with facets by supplier; evidence of a high tax is outside of the packet."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k, ev = F.col("o_orderkey"), F.concat_ws(".", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    answers = orders.select(k.alias("answer_id"), k.alias("task_id"), k.cast("string").alias("packet_hash"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") > 100000, "gap").alias("open_gap"))
    specs = orders.select(k.alias("task_id"), k.cast("string").alias("packet_hash"), F.array(F.lit("O"), F.lit("F")).alias("allowed_statuses"), (F.col("o_orderpriority") == "1-URGENT").alias("require_open_gap"), F.lit(2).alias("min_cited_sources"))
    held = items.select(F.col("l_orderkey").alias("k"), ev.alias("evidence_id"), "l_suppkey", (F.col("l_discount") >= 0.03).alias("used"), (F.col("l_tax") > 0.07).alias("loose"))  # sets are made of these
    facets = held.groupBy(F.col("k").alias("task_id"), (F.col("l_suppkey") % 2).alias("facet_id")).agg(F.lit(1).alias("min_evidence"), F.array_sort(F.collect_set(F.concat("evidence_id", F.when(F.col("loose"), "x").otherwise("")))).alias("evidence_ids_any"))
    packet = held.filter("NOT loose").select(F.col("k").cast("string").alias("packet_hash"), "evidence_id")
    used = held.filter("used").select(F.col("k").alias("answer_id"), F.concat("evidence_id", F.when(F.col("loose"), "x").otherwise("")).alias("evidence_id"))
    cited = held.filter("used").select(F.col("k").alias("answer_id"), F.col("l_suppkey").alias("source_id"))
    return validation.answer_coverage(answers, specs, facets, packet, used, cited)


@query(f"WITH {_COVERED} SELECT a AS answer_id, CAST(covered AS BIGINT) AS covered, required, CAST(CASE WHEN required > 0 THEN floor(covered * 10000 / required) ELSE 10000 END AS BIGINT) AS basis_points, cited AS cited_sources, array_to_string(list_sort(codes), ',') AS violations, CASE WHEN len(codes) = 0 THEN 'complete' ELSE 'incomplete' END AS decision FROM v")
def answer_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir).withColumn("violations", F.array_join("violations", ","))


@query(f"""WITH {_COVERED},
m AS (SELECT l_orderkey AS a, l_orderkey || '.' || l_linenumber AS claim, min(CASE WHEN l_discount > 0.09 THEN 'unsupported' WHEN l_returnflag = 'R' AND l_tax > 0.05 THEN 'uncertain' ELSE 'directly_supported' END) AS verdict, count(*) AS n FROM lineitem WHERE NOT (l_linenumber = 3 AND l_orderkey % 7 = 0) GROUP BY 1, 2),
x AS (SELECT coalesce(i.a, m.a) AS a, i.claim IS NULL AS extra, m.claim IS NULL AS missing, m.n > 1 AS twice, verdict FROM i FULL JOIN m ON i.claim = m.claim),
p AS (SELECT a, bool_or(missing) AS missing, bool_or(twice) AS twice, bool_or(NOT missing AND verdict = 'unsupported') AS failed, bool_or(NOT missing AND verdict = 'uncertain') AS unsure FROM x GROUP BY a),
r AS (SELECT v.a, CASE WHEN v.a % 19 = 0 THEN ['contract'] WHEN len(v.codes) > 0 THEN ['coverage'] END AS late, CASE WHEN v.a % 13 = 0 THEN ['no_receipt'] ELSE list_filter([CASE WHEN p.missing THEN 'missing_judgment' END, CASE WHEN p.twice THEN 'repeated_judgment' END, CASE WHEN v.a % 17 = 0 THEN 'stale_receipt' END], lambda z: z IS NOT NULL) END AS faults, p.failed, p.unsure FROM v LEFT JOIN p USING (a))
SELECT a AS answer_id, CASE WHEN late IS NOT NULL THEN 'unchecked' WHEN len(faults) > 0 THEN 'review_required' WHEN failed THEN 'failed' WHEN unsure THEN 'review_required' ELSE 'passed' END AS decision,
  array_to_string(CASE WHEN late IS NOT NULL THEN late WHEN len(faults) > 0 THEN faults ELSE list_filter([CASE WHEN failed THEN 'claim_failed' END, CASE WHEN unsure THEN 'claim_uncertain' END], lambda z: z IS NOT NULL) END, ',') AS reasons FROM r""")
def answer_entailment(spark, sf_dir):
    """Orders as answers through all three stages: a contract, coverage as computed, and receipts of which some are missing or stale."""
    checkpointed(spark)
    covered = _coverage(spark, sf_dir).select("answer_id", (F.col("decision") == "complete").alias("coverage_complete"))
    items = table(spark, sf_dir, "lineitem")
    a = F.col("l_orderkey").alias("answer_id")
    claim = F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("claim_id")
    cases = items.select(a, claim, F.lit("supported").alias("status")).repartition("answer_id").distinct()
    hashes = validation.case_set_hash(cases)
    answers = covered.join(hashes, "answer_id", "left").select("answer_id", (F.col("answer_id") % 19 != 0).alias("contract_accepted"), "coverage_complete", "case_set_hash")
    answers = kept(answers)  # receipts are made of them as well
    receipt = F.concat(F.lit("r"), F.col("answer_id").cast("string"))
    receipts = answers.filter("answer_id % 13 <> 0").select("answer_id", receipt.alias("receipt_id"), F.when(F.col("answer_id") % 17 == 0, "stale").otherwise(F.col("case_set_hash")).alias("case_set_hash"), F.lit("model").alias("judge"))
    verdict = F.when(F.col("l_discount") > 0.09, "unsupported").when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05), "uncertain").otherwise("directly_supported")
    judgments = items.filter("NOT (l_linenumber = 3 AND l_orderkey % 7 = 0)").select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("receipt_id"), claim, verdict.alias("verdict"))
    return validation.entailment(answers, cases, receipts, judgments, "model").withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH c AS (SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, round_even(avg(CAST(v AS DOUBLE)), 6) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) x GROUP BY label, i) y GROUP BY label),
s AS (SELECT vec_id, c.label, round_even(list_sum(list_transform(list_zip(embedding, c), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 4) AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM s WHERE score >= 0.05 AND vec_id % 10 <> 3)
SELECT vec_id AS route_id, label AS question_id, score, rank, rank AS place FROM r WHERE rank <= 3""")
def semantic_candidates(spark, sf_dir):
    """Every vector as a route, the labels' mean vectors as questions: candidates over a threshold; routes that score a question twice have none."""
    vectors = table(spark, sf_dir, "embeddings")
    each = vectors.select("label", F.posexplode("embedding").alias("i", "v"))
    means = each.groupBy("label", "i").agg(F.bround(F.avg(F.col("v").cast("double")), 6).alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))
    n = means.count()
    if n > 10_000:
        raise ValueError(f"{n} questions")
    dot = F.aggregate(F.zip_with(F.col("embedding"), F.col("mean"), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scores = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(means)).select(F.col("vec_id").alias("route_id"), F.lit("semantic").alias("channel"), F.col("label").alias("question_id"), F.bround(dot, 4).alias("score"))  # questions are counted few
    again = scores.filter("route_id % 10 = 3")
    found, _ = validation.candidate_receipts(scores.unionByName(again), means.select(F.col("label").alias("question_id")), 0.05, 3)
    return found.drop("channel")


@query("""WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS a, strftime(ts + to_seconds(CAST(user_id % 7 - 2 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.%fZ') AS b FROM events),
r AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE a END AS a, CASE WHEN event_id % 18 = 0 THEN NULL WHEN event_id % 11 = 0 THEN replace(b, 'Z', '+00:00') WHEN event_id % 23 = 0 THEN '2024-02-30T00:00:00.000000Z' ELSE b END AS b, event_id % 18 <> 0 AND (event_id % 11 = 0 OR event_id % 23 = 0) AS wrong FROM t)
SELECT event_id, 'no_clock' AS fault FROM r WHERE a IS NULL AND b IS NULL UNION ALL SELECT event_id, 'not_canonical:b' FROM r WHERE wrong UNION ALL SELECT event_id, 'reversed' FROM r WHERE NOT wrong AND a > b""")
def interval_faults(spark, sf_dir):
    """Events as intervals in canonical text, of which some lack clocks, some have another form or an impossible date, and some end before they begin."""
    k = F.col("event_id")
    a = validation.timestamp_text(F.col("ts"))
    b = validation.timestamp_text(F.col("ts") + F.make_dt_interval(secs=(F.col("user_id") % 7 - 2).cast("decimal(18,6)")))
    b = F.when(k % 18 == 0, F.lit(None)).when(k % 11 == 0, F.replace(b, F.lit("Z"), F.lit("+00:00"))).when(k % 23 == 0, "2024-02-30T00:00:00.000000Z").otherwise(b)
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k % 9 != 0, a).alias("a"), b.alias("b"))
    return validation.interval_faults(rows, "event_id", "a", "b")


@query("""WITH e AS (SELECT o_custkey AS p, l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS id, CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'R' THEN 'counter' ELSE 'context' END AS role, CAST(floor(l_extendedprice) AS BIGINT) AS rank, l_suppkey AS src FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 40),
o AS (SELECT *, CASE role WHEN 'support' THEN 1 WHEN 'counter' THEN 2 ELSE 3 END AS k FROM e), g AS (SELECT o_custkey AS p, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS rank FROM orders WHERE o_orderpriority = '1-URGENT'),
s AS (SELECT coalesce(a.p, b.p) AS p, coalesce(ne, 0) AS ne, coalesce(ns, 0) AS ns, coalesce(ng, 0) AS ng, lost, roles FROM (SELECT p, count(*) AS ne, count(DISTINCT src) AS ns, bool_or(src NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > -900)) AS lost, count(DISTINCT role) AS roles FROM o GROUP BY p) a FULL JOIN (SELECT p, count(*) AS ng FROM g GROUP BY p) b ON a.p = b.p),
t AS (SELECT p, CASE WHEN ne > 12 OR ng > 4 OR ns > 9 OR coalesce(lost, FALSE) THEN 'refused' WHEN coalesce(roles, 0) < 3 THEN 'partial' ELSE 'complete' END AS state FROM s),
r AS (SELECT p, 'evidence' AS section, row_number() OVER (PARTITION BY p ORDER BY k, rank, id) AS place, id, role FROM o
  UNION ALL SELECT p, 'gaps', row_number() OVER (PARTITION BY p ORDER BY rank, id), CAST(id AS VARCHAR), NULL FROM g
  UNION ALL SELECT p, 'sources', row_number() OVER (PARTITION BY p ORDER BY f), CAST(src AS VARCHAR), NULL FROM (SELECT p, src, min({'k': k, 'rank': rank, 'id': id}) AS f FROM o GROUP BY p, src) x)
SELECT t.p AS packet_id, t.state, r.section, r.place, r.id, r.role FROM t LEFT JOIN r ON r.p = t.p AND t.state <> 'refused'""")
def connector_packets(spark, sf_dir):
    """A packet per customer: dear items as evidence in three roles, urgent orders as gaps, suppliers as sources, within hard budgets."""
    checkpointed(spark)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("packet_id"), "o_totalprice", "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").join(orders, "l_orderkey")
    role = F.when(F.col("l_returnflag") == "A", "support").when(F.col("l_returnflag") == "R", "counter").otherwise("context")
    evidence = items.select("packet_id", F.concat_ws(".", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), role.alias("role"), F.floor("l_extendedprice").cast("long").alias("rank"), F.col("l_suppkey").alias("source_id"))
    gaps = orders.filter("o_orderpriority = '1-URGENT'").select("packet_id", F.col("l_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("rank"))
    sources = table(spark, sf_dir, "supplier").filter("s_acctbal > -900").select(F.col("s_suppkey").alias("id"))
    rows, states = atlas.connector_packets(evidence, gaps, sources, ["support", "counter", "context"], {"evidence": 12, "gaps": 4, "sources": 9})
    return states.select("packet_id", "state").join(rows, "packet_id", "left")
