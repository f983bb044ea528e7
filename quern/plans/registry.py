"""Queries of the evidence operators over the driver tables, and the SQL they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.canonical import content_id, set_manifest
from quern.operators import answers, gates, graph, mining, packets, retrieval, review, scope
from quern.plans.local import checkpointed, scratch
from quern.plans.relational import SQL
from quern.session import table
from quern.sources import fragments
from quern.streaming import journal, outbox

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _sql(name: str, text: str, oracle: str) -> None:
    tables = sorted(set(re.findall(r"{(\w+)}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})

    QUERIES[name] = run
    ORACLES[name] = re.sub(r"LEFT ANTI JOIN", "ANTI JOIN", re.sub(r"{(\w+)}", r"\1", oracle))


#: SQL of queries that call an operator (see quern.plans.evidence).
ORACLES["review_queue"] = "SELECT d.doc_id, d.lang FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id ORDER BY doc_id LIMIT 100"

for _name, _text in SQL.items():
    _sql(_name, *(_text if isinstance(_text, tuple) else (_text, _text)))


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


QUESTION = "the blend of thing and erer tion ther"
TOK = r"regexp_extract_all(translate(lower(coalesce({}, '')), 'äçèéêíñóöü', 'aceeeinoou'), '([\p{{L}}\p{{N}}]+)', 1)"
LINES = r"(SELECT doc_id, lang, source, CAST(i - 1 AS INTEGER) AS ordinal, ls[i] AS text FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(ls[i]) <> '')"


def bm25_sql(rows: str, key: str, questions: str, most: int, terms: int | None = retrieval.MOST_TERMS) -> str:
    """BM25 in plain SQL: `rows` has (id, text), `questions` has (query_id, question), asked by `terms` terms at most or by all."""
    own = f"list_distinct({TOK.format('question')})"
    asked = own if terms is None else f"list_slice({own}, 1, {terms})"
    return f"""
WITH f AS ({rows}), p AS (SELECT id, {TOK.format("text")} AS ts FROM f), l AS (SELECT id, len(ts) AS dl FROM p),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
q AS (SELECT DISTINCT query_id, unnest({asked}) AS term FROM ({questions})),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM p) x GROUP BY id, term),
m AS (SELECT tf.* FROM tf SEMI JOIN q USING (term)), d AS (SELECT term, count(*) AS df FROM m GROUP BY term),
w AS (SELECT m.id, m.term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w
  FROM m JOIN d USING (term) JOIN l USING (id), tot),
s AS (SELECT query_id, id, -sum(w) AS raw FROM w JOIN q USING (term) GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round_even(raw, 9), id) AS rank, count(*) OVER (PARTITION BY query_id) AS candidates FROM s)
SELECT query_id, rank, id AS {key}, round_even(raw, 6) + 0.0 AS score, candidates FROM r WHERE rank <= {most}"""


#: Scope sessions that stay open between questions.
SESSIONS = packets.Scopes()


def _session(spark: SparkSession, fragments: DataFrame, key: str) -> retrieval.Index:
    """The saved index of a scope, made at its first question. A scope is named by the hash of what it may read, ids
    and texts, so a table that changed, or another permitted set, gets an index of its own."""
    own = fragments.select(F.lit(1).alias("scope"), F.concat_ws("\x1f", F.col(key).cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("member"))
    held = set_manifest(own, "scope", "member").first()
    scope_hash = held["manifest_hash"] if held else "nothing"
    return SESSIONS.open(f"{spark.sparkContext.applicationId}:{key}:{scope_hash}", lambda: retrieval.Index(fragments, key).saved(scratch(spark, "index")))


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English and French line fragments, one source denied: what the flagship question may read."""
    docs = table(spark, sf_dir, "documents")
    members = docs.select(F.col("doc_id").alias("fragment_id"), F.col("source").alias("source_id"), F.col("lang").alias("collection_id"), F.lit("active").alias("state"))
    rules = spark.createDataFrame([("en", "allow"), ("fr", "allow")], "collection_id string, effect string")
    denied = spark.createDataFrame([("src3", "deny")], "source_id string, effect string")
    ok = scope.compile_access(members, rules, denied, ["en", "fr"]).filter("permitted").select(F.col("fragment_id").alias("doc_id"))
    return docs.join(ok, "doc_id", "left_semi")


@query(bm25_sql("SELECT doc_id AS id, text FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src3'", "doc_id", f"SELECT 1 AS query_id, '{QUESTION}' AS question", 10).replace("SELECT query_id, rank,", "SELECT rank,"))
def scoped_bm25_top10(spark, sf_dir):
    asked = spark.createDataFrame([(1, QUESTION)], "query_id int, question string")
    return _session(spark, _scoped(spark, sf_dir), "doc_id").search(asked, 10).select("rank", F.col("id").alias("doc_id"), "score", "candidates")


def _batch(spark: SparkSession, sf_dir: str, terms: int | None) -> DataFrame:
    """The first ten documents of each item, asked by `terms` terms at most or by all."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return _session(spark, table(spark, sf_dir, "documents"), "doc_id").search(asked, 10, terms).withColumnRenamed("id", "doc_id")


@query(bm25_sql("SELECT doc_id AS id, text FROM documents", "doc_id", "SELECT item_id AS query_id, text AS question FROM benchmark", 10, None))
def bm25_batch(spark, sf_dir):
    return _batch(spark, sf_dir, None)


@query(bm25_sql(f"SELECT doc_id || '#' || ordinal AS id, text FROM {LINES} x", "fragment_id", f"SELECT 1 AS query_id, '{QUESTION}' AS question", 25))
def bm25_lines(spark, sf_dir):
    asked = spark.createDataFrame([(1, QUESTION)], "query_id int, question string")
    return retrieval.Index(fragments.line_fragments(table(spark, sf_dir, "documents"))).search(asked, 25).withColumnRenamed("id", "fragment_id")


@query(bm25_sql("SELECT doc_id AS id, text FROM documents WHERE source IN ('src1', 'src2', 'src5')", "doc_id", f"SELECT 1 AS query_id, '{QUESTION}' AS question", 100))
def bm25_drilldown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = spark.createDataFrame([("src5", 1), ("src1", 2), ("src2", 3), ("src1", 4), ("src9", 5)], "source string, rank int")
    asked = spark.createDataFrame([(1, QUESTION)], "query_id int, question string")
    return retrieval.drilldown(docs.withColumn("fragment_id", F.col("doc_id")), hits, "source", asked).withColumnRenamed("id", "doc_id")


@query("SELECT CAST(0 AS BIGINT) AS differing")
def replay_diff(spark, sf_dir):
    """A search that cuts the texts anew against one over the saved index of the same lines."""
    asked = spark.createDataFrame([(1, QUESTION)], "query_id int, question string")
    lines = fragments.line_fragments(table(spark, sf_dir, "documents"))
    again = _session(spark, lines, "fragment_id").search(asked, 25).withColumnRenamed("id", "fragment_id")
    return retrieval.replay_difference(bm25_lines(spark, sf_dir), again).agg(F.count(F.lit(1)).alias("differing"))


@query(f"""WITH hits AS ({bm25_sql("SELECT doc_id AS id, text FROM documents", "doc_id", "SELECT item_id AS query_id, text AS question FROM benchmark", 10)}),
e AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT count(DISTINCT e.query_id) AS questions, count(DISTINCT h.query_id) AS found FROM e LEFT JOIN hits h ON h.query_id = e.query_id AND h.doc_id = e.doc_id""")
def recall_at_k(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    expected = retrieval.holding(docs, "doc_id", items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")))
    return retrieval.recall_at(_batch(spark, sf_dir, retrieval.MOST_TERMS).withColumnRenamed("doc_id", "id"), expected, 10).select("questions", F.coalesce("found", F.lit(0)).alias("found"))


@query(f"""WITH hits AS ({bm25_sql("SELECT doc_id AS id, text FROM documents", "doc_id", "SELECT item_id AS query_id, text AS question FROM benchmark", 10)}),
e AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id, d.lang FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT e.query_id, e.lang, max(CASE WHEN h.query_id IS NULL THEN 0 ELSE 1 END) AS hit FROM e LEFT JOIN hits h ON h.query_id = e.query_id AND h.doc_id = e.doc_id GROUP BY 1, 2)
SELECT lang, count(*) AS questions, CAST(sum(hit) AS BIGINT) AS found FROM f GROUP BY lang""")
def recall_by_language(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    expected = retrieval.holding(docs, "doc_id", items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")))
    expected = expected.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    found = _batch(spark, sf_dir, retrieval.MOST_TERMS).withColumnRenamed("doc_id", "id")
    met = expected.join(found.select("query_id", "id", F.lit(1).alias("h")), ["query_id", "id"], "left").groupBy("query_id", "lang").agg(F.max(F.coalesce("h", F.lit(0))).alias("hit"))
    return met.groupBy("lang").agg(F.count(F.lit(1)).alias("questions"), F.sum("hit").alias("found"))


@query("SELECT doc_id AS fragment_id, source AS source_id, lang IN ('en', 'fr') AND source NOT IN ('src3', 'src7') AND doc_id % 50 <> 0 AS permitted, doc_id % 50 <> 0 AND NOT (lang IN ('en', 'fr') AND source NOT IN ('src3', 'src7')) AS policy_denied FROM documents WHERE lang IN ('de', 'en', 'fr') AND source <> 'src8'")
def access_permitted_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    members = docs.select(F.col("doc_id").alias("fragment_id"), F.col("source").alias("source_id"), F.col("lang").alias("collection_id"), F.when(F.col("doc_id") % 50 == 0, "holdout").otherwise("active").alias("state"))
    rules = spark.createDataFrame([("en", "allow"), ("fr", "allow")], "collection_id string, effect string")
    denied = spark.createDataFrame([("src3", "deny"), ("src7", "deny")], "source_id string, effect string")
    out = spark.createDataFrame([("source", "src8")], "kind string, id string")
    return scope.compile_access(members, rules, denied, ["de", "en", "fr"], out)


@query(f"SELECT bool_or(policy_denied) AS policy_omission_present FROM ({ORACLES['access_permitted_manifest']}) m")
def access_policy_omission_bit(spark, sf_dir):
    return scope.policy_omission(access_permitted_manifest(spark, sf_dir))


@query("SELECT doc_id, sha256(text) AS text_sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS root_id, count(*) OVER (PARTITION BY sha256(text)) AS family_size, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'root' ELSE 'duplicate' END AS role FROM documents")
def lineage_exact_duplicates(spark, sf_dir):
    return scope.duplicate_lineage(fragments.document_fragments(table(spark, sf_dir, "documents")).select("doc_id", "text_sha256"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS uri, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'x' END AS sha256,
CASE WHEN o_orderkey % 3 = 0 THEN 'added' WHEN o_orderkey % 4 = 0 THEN 'reverted' WHEN o_orderkey % 4 = 1 THEN 'unchanged' ELSE 'changed' END AS disposition,
CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 4 = 0 THEN 1 WHEN o_orderkey % 4 = 1 THEN 2 ELSE 3 END AS BIGINT) AS version FROM orders""")
def ingest_disposition(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("uri"))
    incoming = orders.select("uri", F.element_at(F.array(*map(F.lit, "abcx")), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("sha256"))
    known = orders.filter("o_orderkey % 3 <> 0")
    history = known.select("uri", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(v).alias("v"), F.lit(v == 2).alias("head")) for h, v in (("a", 1), ("b", 2))])).alias("x")).select("uri", F.col("x.h").alias("sha256"), F.col("x.v").alias("version"), F.col("x.head").alias("is_head"))
    return scope.disposition(incoming, history)


@query("""WITH m AS (SELECT lang, sha256(doc_id || chr(31) || sha256(text)) AS h FROM documents), b AS (SELECT lang, substr(h, 1, 4) AS bucket, count(*) AS n, sha256(string_agg(h, chr(30) ORDER BY h)) AS bh FROM m GROUP BY lang, substr(h, 1, 4))
SELECT lang AS collection, CAST(sum(n) AS BIGINT) AS members, sha256(string_agg(bucket || bh, chr(30) ORDER BY bucket)) AS manifest_hash FROM b GROUP BY lang""")
def snapshot_members(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), F.sha2("text", 256)).alias("member"))
    return set_manifest(rows, "collection", "member")


@query("SELECT doc_id, 'fragment_' || substr(sha256(text), 1, 32) AS content_id FROM documents")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content_id("fragment", F.col("text")).alias("content_id"))


@query(r"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1), lambda v: (length(v) >= 3 OR regexp_matches(v, '^[0-9]+$')) AND v NOT IN ('about','after','also','and','are','been','before','between','could','does','from','have','how','into','is','it','that','their','this','through','what','when','where','which','with','would')))) AS terms FROM documents".replace("SELECT doc_id, list_sort", "SELECT doc_id, array_to_string(list_sort").replace(" AS terms", ", ' ') AS terms"))
def router_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.router_terms(F.col("text")), " ").alias("terms"))


@query(f"""WITH q AS (SELECT {TOK.format(f"'{QUESTION}'")} AS t), f AS (SELECT doc_id, {TOK.format("text")} AS ts FROM documents)
SELECT doc_id, len(list_filter((SELECT t FROM q), lambda v: length(v) >= 3 AND v NOT IN ('and', 'that', 'this', 'with'))) > 0 AND NOT list_has_any(ts, list_filter((SELECT t FROM q), lambda v: length(v) >= 3 AND v NOT IN ('and', 'that', 'this', 'with'))) AS drifts FROM f""")
def topic_drift(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.topic_drift(F.lit(QUESTION), F.col("text")).alias("drifts"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(' ' || regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', '  ', 'g') || ' ', ' worthless ')")
def literal_whole_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(T.literal_present(F.col("text"), "worthless")).select("doc_id")


@query()
def unquoted_numbers(spark, sf_dir):
    """Every line as a claim, the line before it as its quote."""
    rows = fragments.line_fragments(table(spark, sf_dir, "documents"))
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    claims = rows.select("doc_id", "ordinal", F.concat_ws("#", "doc_id", "ordinal").alias("claim_id"), "text", F.array(F.coalesce(before, F.lit(""))).alias("quotes"))
    return gates.unquoted_numbers(claims).filter(F.size("unsupported") > 0).select("doc_id", "ordinal", F.array_join("unsupported", ",").alias("found"))


@query("SELECT doc_id, doc_id % 20 AS start, length(text) >= doc_id % 20 + 10 AND doc_id % 9 <> 0 AS exact FROM documents")
def exact_span(spark, sf_dir):
    """Spans of ten characters at a place of their own; one in nine was changed, and one beyond the end is none."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 20).cast("int").alias("start"), "text")
    quoted = F.rpad(F.substr("text", F.col("start") + 1, F.lit(10)), 10, "~")
    claimed = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("~"), quoted)).otherwise(quoted)
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), gates.exact_span(F.col("text"), F.col("start"), F.col("start") + 10, claimed).alias("exact"))


@query("""WITH j AS (SELECT l_orderkey AS claim_set, CASE WHEN l_returnflag = 'R' AND l_tax > 0.06 THEN 'uncertain' WHEN l_discount > 0.09 THEN 'unsupported' ELSE 'directly_supported' END AS verdict FROM lineitem)
SELECT claim_set, CASE WHEN max(CASE WHEN verdict = 'unsupported' THEN 2 WHEN verdict = 'uncertain' THEN 1 ELSE 0 END) = 2 THEN 'failed' WHEN max(CASE WHEN verdict = 'unsupported' THEN 2 WHEN verdict = 'uncertain' THEN 1 ELSE 0 END) = 1 THEN 'review_required' ELSE 'passed' END AS state FROM j GROUP BY claim_set""")
def claim_sets(spark, sf_dir):
    verdict = F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.06), "uncertain").when(F.col("l_discount") > 0.09, "unsupported").otherwise("directly_supported")
    judged = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_set"), gates.claim_state(F.lit("supported"), verdict).alias("state"))
    return gates.set_state(judged, "claim_set")


EDGE = "(SELECT 'o' || o_orderkey AS relation_id, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 's' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey, 's' || l_suppkey FROM lineitem)"


def _edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("concat('o', o_orderkey) AS relation_id", "concat('c', o_custkey) AS src", "concat('o', o_orderkey) AS dst")
    return o.unionByName(table(spark, sf_dir, "lineitem").selectExpr("concat('s', l_orderkey, '.', l_linenumber) AS relation_id", "concat('o', l_orderkey) AS src", "concat('s', l_suppkey) AS dst"))


@query(f"""WITH RECURSIVE e AS {EDGE}, w AS (
SELECT src AS seed, dst AS at_, CAST(1 AS BIGINT) AS depth, relation_id AS relation_path, src || '>' || dst AS node_path FROM e WHERE src IN ('c1', 'c2', 'c4', 'c5', 'c7', 'c8', 'c10')
UNION ALL SELECT w.seed, e.dst, w.depth + 1, w.relation_path || '>' || e.relation_id, w.node_path || '>' || e.dst FROM w JOIN e ON e.src = w.at_ WHERE w.depth < 3 AND NOT contains('>' || w.node_path || '>', '>' || e.dst || '>'))
SELECT seed, at_ AS "at", depth, relation_path, node_path FROM w""")
def bounded_walk(spark, sf_dir):
    seeds = spark.createDataFrame([(f"c{k}",) for k in (1, 2, 4, 5, 7, 8, 10)], "node string")
    return graph.walk(_edges(spark, sf_dir), seeds, 3).drop("path_hash")


@query(f"WITH RECURSIVE e AS {EDGE}, w AS (SELECT 'c1' AS node UNION SELECT 'c2' UNION SELECT 'c4' UNION SELECT e.dst FROM w JOIN e ON e.src = w.node) SELECT node FROM w")
def router_closure(spark, sf_dir):
    checkpointed(spark)
    return graph.reach(_edges(spark, sf_dir), spark.createDataFrame([("c1",), ("c2",), ("c4",)], "node string"))


ITEMS = "i AS (SELECT l_orderkey, l_returnflag, l_orderkey || '.' || l_linenumber AS f FROM lineitem), p AS (SELECT DISTINCT f FROM i WHERE l_returnflag <> 'R'), g AS (SELECT l_orderkey AS node_id, count(*) AS c, bool_and(f IN (SELECT f FROM p)) AS ok FROM i GROUP BY l_orderkey)"


@query(f"""WITH {ITEMS} SELECT 'order' AS node_type, node_id FROM g WHERE ok""")
def authorised_nodes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_returnflag", "concat(l_orderkey, '.', l_linenumber) AS fragment_id")
    permitted = items.filter("l_returnflag <> 'R'").select("fragment_id").distinct()
    return graph.authorised_nodes(items.selectExpr("'order' AS node_type", "l_orderkey AS node_id", "fragment_id"), permitted)


@query(f"WITH {ITEMS} SELECT o_orderkey AS relation_id, o_orderkey AS subject_id, o_orderkey AS object_id FROM orders JOIN g ON node_id = o_orderkey WHERE ok AND c >= 3")
def authorised_edges(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS relation_id", "l_returnflag", "concat(l_orderkey, '.', l_linenumber) AS fragment_id")
    counts = items.groupBy("relation_id").agg(F.count(F.lit(1)).alias("evidence_count")).filter("evidence_count >= 3")
    edges = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS relation_id", "'supports' AS relation_type", "o_orderkey AS subject_id", "o_orderkey AS object_id").join(counts, "relation_id")
    permitted = items.filter("l_returnflag <> 'R'").select("fragment_id")
    return graph.authorised_edges(edges, items.select("relation_id", "fragment_id"), permitted, authorised_nodes(spark, sf_dir), ["supports"]).select("relation_id", "subject_id", "object_id")


@query(r"""WITH a AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '([\p{L}\p{N}]+)', 1) AS n, regexp_extract_all(lower(p_type), '([\p{L}\p{N}]+)', 1) AS t FROM part),
q AS (SELECT ['brass', 'green', 'large', 'steel', 'red'] AS q), s AS (SELECT p_partkey, CAST(5 * len(list_intersect(list_distinct(n), q)) + 2 * len(list_intersect(list_distinct(t), q)) AS BIGINT) AS score FROM a, q)
SELECT p_partkey, score, row_number() OVER (ORDER BY score DESC, p_partkey) AS rank FROM s WHERE score > 0 QUALIFY rank <= 40""")
def router_rank(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", T.router_terms(F.col("p_name")).alias("name"), T.router_terms(F.col("p_type")).alias("type"))
    asked = F.array(*[F.lit(x) for x in ("brass", "green", "large", "steel", "red")])
    return graph.route_rank(parts, asked, {"name": 5, "type": 2}, "p_partkey", 40).select("p_partkey", "score", "rank")


@query("""WITH p AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, round_even(CAST(list_sum(list_transform(list_zip(embedding, e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS DOUBLE), 6) AS score FROM embeddings, p)
SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.1 QUALIFY rank <= 20""")
def route_receipt(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    probe = F.broadcast(rows.orderBy("vec_id").limit(1).select(F.col("embedding").alias("e")))  # one vector
    dot = F.aggregate(F.zip_with("embedding", "e", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = rows.crossJoin(probe).select("vec_id", F.bround(dot, 6).alias("score")).filter("score >= 0.1")
    top = scored.orderBy(F.desc("score"), "vec_id").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long"))


@query(r"""WITH w AS (SELECT source, unnest(regexp_extract_all(coalesce(text, ''), '(\p{L}+)', 1)) AS w FROM documents),
p AS (SELECT lower(w) AS word, count(DISTINCT CASE WHEN w <> lower(w) THEN source END) AS sources, max(CASE WHEN w = lower(w) THEN 1 ELSE 0 END) AS low FROM w GROUP BY lower(w))
SELECT word, sources FROM p WHERE sources >= 2 AND low = 0 AND word <> 'spark'""")
def proper_name_stops(spark, sf_dir):
    return mining.proper_names(table(spark, sf_dir, "documents"), "source", "text", ["spark"])


@query(r"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '([\p{L}\p{N}]+)', 1), lambda v: v NOT IN ('the', 'of', 'and')) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_concat(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term), n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term), v AS (SELECT term, df FROM df, n WHERE df >= 3 AND df <= n * 0.55 ORDER BY cf DESC, term LIMIT 6000),
r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN v USING (term), n),
s AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY doc_id)
SELECT doc_id, term, round_even(raw / norm, 6) AS weight FROM r JOIN s USING (doc_id)""")
def tfidf_terms(spark, sf_dir):
    checkpointed(spark)
    return mining.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", ["the", "of", "and"]).withColumn("weight", F.bround("weight", 6))


@query(r"""WITH o AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '([\p{L}]+)', 1), lambda v: v IN ('clown', 'idiot', 'worthless', 'trash', 'scum', 'loser', 'moron', 'pathetic'))) AS concept, doc_id AS fragment, source FROM documents)
SELECT a.concept AS "left", b.concept AS "right", count(DISTINCT a.fragment) AS shared, count(DISTINCT a.source) AS sources FROM o a JOIN o b ON a.fragment = b.fragment AND a.concept < b.concept GROUP BY a.concept, b.concept HAVING count(DISTINCT a.source) >= 2 ORDER BY sources DESC, shared DESC, "left", "right" LIMIT 30""")
def cooccurrence_pairs(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)))
    known = ["clown", "idiot", "worthless", "trash", "scum", "loser", "moron", "pathetic"]
    rows = table(spark, sf_dir, "documents").select(F.explode_outer(F.filter(words, lambda w: w.isin(known))).alias("concept"), F.col("doc_id").alias("fragment"), "source").filter("concept IS NOT NULL")
    return mining.cooccurrence(rows)


@query("""WITH f AS (SELECT conv_id AS version_id, turn AS ordinal, role AS heading FROM conversations),
s AS (SELECT *, CASE WHEN lag(heading) OVER w IS NOT DISTINCT FROM heading AND lag(ordinal) OVER w + 1 = ordinal THEN 0 ELSE 1 END AS st FROM f WINDOW w AS (PARTITION BY version_id ORDER BY ordinal)),
r AS (SELECT *, sum(st) OVER (PARTITION BY version_id ORDER BY ordinal) AS run FROM s)
SELECT version_id, CAST(run AS BIGINT) AS run, min(heading) AS heading, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, count(*) AS members, CASE WHEN count(*) < 2 THEN 'below_minimum' WHEN count(*) > 128 THEN 'oversized' END AS omission FROM r GROUP BY version_id, run""")
def structure_units(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("version_id"), F.col("turn").alias("ordinal"), F.col("role").alias("heading"))
    return scope.structure_units(rows)


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS char_end FROM conversations")
def rendered_units(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), "text")
    return fragments.render(rows, "conv_id").select("conv_id", F.col("ordinal").alias("turn"), "char_start", "char_end")


@query(r"""WITH b AS (SELECT page_id, url, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<!--.*?-->', '', 'g') AS body FROM pages)
SELECT page_id, len(list_filter(list_transform(regexp_extract_all(body, '(?is)<(?:p|li)\b[^>]*>(.*?)</(?:p|li)>', 1), lambda v: trim(regexp_replace(regexp_replace(v, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda v: v <> '')) AS blocks FROM b WHERE len(list_filter(list_transform(regexp_extract_all(body, '(?is)<(?:p|li)\b[^>]*>(.*?)</(?:p|li)>', 1), lambda v: trim(regexp_replace(regexp_replace(v, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda v: v <> '')) > 0""")
def page_blocks(spark, sf_dir):
    return fragments.page_blocks(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"))


@query()
def noise_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(T.noise_reasons(F.lit(QUESTION), F.col("text"), F.lit("paragraph"), F.array().cast("array<string>")), ",").alias("reasons"))


@query()
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), F.lit(QUESTION)).alias("excerpt"))


@query()
def folded_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("""WITH d AS (SELECT doc_id AS decision_id, CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 END AS sup, doc_id // 3 AS target, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'defer' END AS action, doc_id % 2 AS c FROM labels),
st AS (SELECT * FROM d WHERE decision_id NOT IN (SELECT sup FROM d WHERE sup IS NOT NULL) AND action <> 'defer')
SELECT target AS target_id FROM st GROUP BY target HAVING count(DISTINCT c) = 2""")
def resolved_targets(spark, sf_dir):
    action = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("defer")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("decision_id"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).alias("supersedes_id"), F.floor(F.col("doc_id") / 3).alias("target_id"), F.lit("answer").alias("use"), action.alias("action"), F.array(F.concat(F.lit("c"), (F.col("doc_id") % 2).cast("string"))).alias("scope"))
    targets = rows.select("target_id").distinct().withColumn("collections", F.array(F.lit("c0"), F.lit("c1")))
    return review.resolved(rows, targets).select("target_id")


@query("SELECT doc_id AS decision_id FROM labels WHERE doc_id NOT IN (SELECT doc_id + 1 FROM labels WHERE doc_id % 5 = 0)")
def standing_decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("decision_id"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).alias("supersedes_id"))
    return review.standing(rows).select("decision_id")


@query("""WITH r AS (SELECT DISTINCT lang AS task, source AS facet FROM documents), a AS (SELECT DISTINCT lang AS task, source AS facet FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
p AS (SELECT r.task, count(*) AS required, count(a.facet) AS covered FROM r LEFT JOIN a ON a.task = r.task AND a.facet = r.facet GROUP BY r.task)
SELECT *, CAST(floor(covered * 10000 / required) AS BIGINT) AS basis_points, CASE WHEN covered = required THEN 'covered' WHEN covered > 0 THEN 'partial' ELSE 'missing' END AS decision FROM p""")
def facet_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task"), F.col("source").alias("facet"))
    weak = docs.join(table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_semi")
    return answers.facet_coverage(docs.select("task", "facet").distinct(), weak)


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations)
SELECT id, 0 AS "start", 5 AS "end", 'plain' AS kind, substr(text, 1, 5) AS part FROM t WHERE length(text) > 20 UNION ALL SELECT id, 5, 10, 'traced', substr(text, 6, 5) FROM t WHERE length(text) > 20
UNION ALL SELECT id, 10, 12, 'plain', substr(text, 11, 2) FROM t WHERE length(text) > 20 UNION ALL SELECT id, 12, 18, 'traced', substr(text, 13, 6) FROM t WHERE length(text) > 20 UNION ALL SELECT id, 18, CAST(length(text) AS INTEGER), 'plain', substr(text, 19) FROM t WHERE length(text) > 20 UNION ALL SELECT id, 0, CAST(length(text) AS INTEGER), 'plain', text FROM t WHERE length(text) BETWEEN 1 AND 20""")
def traced_segments(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    spans = texts.filter("length(text) > 20").select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 10), (12, 18))])).alias("s")).select("id", "s.start", "s.end", F.lit("traced").alias("kind"))
    return answers.segments(texts, spans)


@query("""WITH e AS (SELECT l_orderkey || '.' || l_linenumber AS id, l_orderkey, l_suppkey, l_returnflag || l_linestatus AS q FROM lineitem)
SELECT l_orderkey AS claim_id, count(*) AS cases, count(CASE WHEN q LIKE 'A%' OR q LIKE 'N%' OR q LIKE 'R%' THEN 1 END) AS exact, TRUE AS complete FROM e GROUP BY l_orderkey""")
def claim_case_set(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "concat(l_orderkey, '.', l_linenumber, '.', xxhash64(l_partkey, l_suppkey, l_extendedprice, l_shipdate)) AS evidence_id", "l_suppkey AS source_id", "concat(l_returnflag, l_linestatus) AS text", "l_returnflag AS quote")
    claims = items.groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_list("evidence_id").alias("evidence_ids"))
    found = answers.case_set(claims, items.select("evidence_id", "source_id", "quote"), items.select("evidence_id", "text"))
    return found.select("claim_id", F.size("cases").cast("long").alias("cases"), F.size(F.filter("cases", lambda c: c["exact"])).cast("long").alias("exact"), "complete")


@query("SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS shown FROM pages")
def redacted_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", answers.redact(F.col("url")).alias("shown"))


@query("SELECT doc_id, CASE WHEN length(text) > 900 THEN rtrim(substr(text, 1, 899)) || '…' ELSE text END AS clipped FROM documents")
def clipped_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", answers.clip(F.col("text")).alias("clipped"))


@query(rf"""WITH p AS (SELECT doc_id, ordinal, regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+)', 1) AS ps FROM {LINES} x),
q AS (SELECT doc_id, ordinal, unnest(ps) AS term, unnest(range(1, len(ps) + 1)) AS k FROM p WHERE list_has_any(ps, ['idiot', 'moron'])),
r AS (SELECT *, 1 + coalesce(sum(length(term)) OVER (PARTITION BY doc_id, ordinal ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM q)
SELECT doc_id AS id, ordinal + 1 AS line, CAST(c AS INTEGER) AS "column", term, 'polite' AS replacement FROM r WHERE term IN ('idiot', 'moron')""")
def deprecated_terms(spark, sf_dir):
    known = spark.createDataFrame([("idiot", "polite"), ("moron", "polite")], "term string, replacement string")
    return answers.terms_used(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), known)


@query("""WITH c AS (SELECT doc_id // 10 AS packet_id, doc_id % 10 AS r, doc_id, CASE WHEN length(text) > 900 THEN rtrim(substr(text, 1, 899)) || '…' ELSE text END AS t FROM documents)
SELECT packet_id, string_agg(r || '. ' || t || ' (0.500000)', chr(10) ORDER BY r) AS markdown FROM c GROUP BY packet_id""")
def packet_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("packet_id"), (F.col("doc_id") % 10).alias("rank"), F.lit("0.500000").alias("score"), "text")
    return answers.packet_lines(rows)


@query("SELECT event_id, event_type, ts FROM events")
def outbox_stream(spark, sf_dir):
    """The events as a stream, exported once each as lines of JSON under an epoch's manifest; what is committed is returned."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "event_type", "ts")
    sink = scratch(spark, "outbox")
    outbox.export(stream, sink, scratch(spark, "outbox-progress"), order="ts").awaitTermination()
    return outbox.exported(spark, sink, stream.schema, order="ts").select("event_id", "event_type", "ts")


from quern.plans import concepts, evidence, graphs, ingest, preparation, projections, recall, sessions, validation  # noqa: E402, F401  register their queries
