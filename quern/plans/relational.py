"""Relational operators on the tables, as SQL both engines read: joins, aggregates, windows, limits and set operations.

Each entry is a name and SQL text; {table} stands for a table. Where the engines differ, the second text is the oracle's.
"""

from __future__ import annotations

SQL: dict[str, str | tuple[str, str]] = {
    # joins
    "inner_chain": "SELECT r.r_name, n.n_name, c.c_mktsegment, count(*) AS orders FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY r.r_name, n.n_name, c.c_mktsegment",
    "left_missing": "SELECT c.c_custkey, c.c_name FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000 WHERE o.o_orderkey IS NULL",
    "all_evidence_permitted": "SELECT o.o_orderkey, count(*) AS links FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey LEFT JOIN (SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_returnflag <> 'R') p ON p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber GROUP BY o.o_orderkey HAVING sum(CASE WHEN p.l_orderkey IS NULL THEN 1 ELSE 0 END) = 0",
    "exists_semi": "SELECT c.c_custkey, c.c_mktsegment FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "nested_not_exists": "SELECT o.o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey) AND NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 0))",
    "scalar_count_match": "SELECT o.o_orderkey, o.o_orderstatus, c.n AS evidence_count FROM {orders} o JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS d FROM {lineitem} GROUP BY l_orderkey) c ON c.l_orderkey = o.o_orderkey WHERE c.n = c.d",
    "not_superseded": "SELECT e.event_id, e.user_id FROM {events} e LEFT ANTI JOIN (SELECT event_id - 1 AS prior, user_id FROM {events} WHERE event_type = 'purchase') s ON s.prior = e.event_id",
    "parameter_table": "SELECT v.k AS wanted, n.n_name FROM (VALUES (1), (5), (7), (99)) AS v(k) LEFT JOIN {nation} n ON n.n_nationkey = v.k",
    "range_join": "SELECT p.p_partkey, b.band FROM {part} p JOIN (VALUES ('low', 0.0, 950.0), ('mid', 950.0, 1400.0), ('high', 1400.0, 99999.0)) AS b(band, lo, hi) ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi",
    # aggregates
    "library_counts": "SELECT 'documents' AS relation, count(*) AS n FROM {documents} UNION ALL SELECT 'pages', count(*) FROM {pages} UNION ALL SELECT 'benchmark', count(*) FROM {benchmark} UNION ALL SELECT 'labels', count(*) FROM {labels} UNION ALL SELECT 'conversations', count(*) FROM {conversations} UNION ALL SELECT 'events', count(*) FROM {events} UNION ALL SELECT 'embeddings', count(*) FROM {embeddings} UNION ALL SELECT 'lineitem', count(*) FROM {lineitem}",
    "orphan_having": "SELECT o.o_custkey, count(l.l_orderkey) AS links FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 49 GROUP BY o.o_custkey HAVING count(l.l_orderkey) = 0",
    "next_version": "SELECT source, max(doc_id) + 1 AS next_version FROM {documents} GROUP BY source",
    "independence_groups": "SELECT lang, count(DISTINCT source) AS independence_groups, count(DISTINCT source) >= 3 AS enough FROM {documents} GROUP BY lang",
    "candidate_diagnostics": "SELECT count(*) AS sources, max(n) AS most_fragments, CAST(sum(n) AS BIGINT) AS fragments FROM (SELECT source, count(*) AS n FROM {documents} GROUP BY source) x",
    "facet_basis_points": "SELECT lang, count(q) AS covered, count(*) AS required, CAST(floor(count(q) * 10000 / count(*)) AS BIGINT) AS basis_points FROM (SELECT d.lang, l.quality AS q FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) x GROUP BY lang",
    "theme_metrics": "SELECT p.p_brand AS theme, count(DISTINCT l.l_orderkey) AS evidence, count(DISTINCT l.l_suppkey) AS families, CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS counter_evidence FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey GROUP BY p.p_brand",
    "review_status_counts": "SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'accept' WHEN toxic = 1 THEN 'reject' ELSE 'revise' END AS review_state, count(*) AS n FROM {labels} GROUP BY 1",
    "latest_decision": "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM {events} GROUP BY user_id",
    "ingest_coverage": "SELECT CASE WHEN n_chars < 50 THEN 'skipped' WHEN text IS NULL THEN 'failed' ELSE 'processed' END AS outcome, lang, count(*) AS n FROM {documents} GROUP BY 1, 2",
    "version_cap": "SELECT l_orderkey, count(DISTINCT l_partkey) AS candidates FROM {lineitem} GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 6",
    "backlog_count": "SELECT count(*) AS unresolved FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)",
    "corroboration_units": "SELECT lang, count(DISTINCT root) AS units FROM (SELECT lang, min(doc_id) OVER (PARTITION BY text) AS root, doc_id FROM {documents}) x WHERE root = doc_id GROUP BY lang",
    "nearest_rank_percentiles": (
        "SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, min(value) AS least, max(value) AS most FROM {events} GROUP BY event_type",
        "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM {events} GROUP BY event_type",
    ),
    "multi_source_ratio": "SELECT CAST(sum(CASE WHEN s >= 2 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS ratio FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS s FROM {lineitem} GROUP BY l_partkey) x",
    "hypothesis_rollup": "SELECT n.n_regionkey AS hypothesis, CAST(sum(t.evidence) AS BIGINT) AS evidence, CAST(sum(t.families) AS BIGINT) AS families FROM (SELECT s.s_nationkey, count(*) AS evidence, count(DISTINCT l.l_partkey) AS families FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey GROUP BY s.s_nationkey) t JOIN {nation} n ON n.n_nationkey = t.s_nationkey GROUP BY n.n_regionkey",
    "atlas_overview": "SELECT count(*) AS sources, count(DISTINCT source) AS families, CAST(sum(CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS materials, count(DISTINCT lang) AS collections FROM {documents}",
    "manifest_closure": "SELECT l_orderkey AS id, max(l_linenumber) + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS stored, count(DISTINCT l_linenumber) AS recomputed FROM {lineitem} GROUP BY l_orderkey HAVING max(l_linenumber) + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END <> count(DISTINCT l_linenumber)",
    "rollup_counts": "SELECT lang, source, grouping(lang) + grouping(source) AS level, count(*) AS n FROM {documents} GROUP BY ROLLUP (lang, source)",
    "cube_counts": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS cell, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "dangling_keys": "SELECT 'orders.o_custkey' AS foreign_key, count(*) AS dangling FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey) UNION ALL SELECT 'lineitem.l_partkey', count(*) FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {part} p WHERE p.p_partkey = l.l_partkey)",
    "recall_coverage": "SELECT lang, count(DISTINCT doc_id) AS processed, CAST(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS omitted FROM {documents} GROUP BY lang",
    # windows, order, limits
    "rank_assignment": "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) * CAST(1 AS BIGINT) AS rank FROM {customer}",
    "contiguity": "SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) - min(turn) + 1 = count(*) AS contiguous FROM {conversations} GROUP BY conv_id",
    "first_distinct": "SELECT user_id, event_type, min(event_id) AS first_event FROM {events} GROUP BY user_id, event_type",
    "recent_k": "SELECT user_id, event_type, event_id, greatest(n - 3, 0) AS omitted FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM {events}) x WHERE r <= 3",
    "closest_three": "SELECT lang, doc_id, codes FROM (SELECT d.lang, d.doc_id, l.toxic + 1 - l.quality AS codes, row_number() OVER (PARTITION BY d.lang ORDER BY l.toxic + 1 - l.quality, d.doc_id) AS r FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.toxic = 1 OR l.quality = 0) x WHERE r <= 3",
    "source_diverse": "SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN r > 1 THEN 1 ELSE 0 END, CASE WHEN r = 1 THEN -n_chars END, doc_id) * CAST(1 AS BIGINT) AS place FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r FROM {documents}) x) y WHERE place <= 25",
    "running_offsets": "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM {conversations}",
    "stable_listing": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "top_relations": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) AS shared FROM {lineitem} GROUP BY l_suppkey ORDER BY parts DESC, shared DESC, l_suppkey LIMIT 30",
    "packet_selection": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM {documents}) x WHERE r <= 100",
    # set operations
    "union_all_log": "SELECT doc_id AS target, 'quality' AS log, quality AS decision FROM {labels} UNION ALL SELECT doc_id, 'toxic', toxic FROM {labels}",
    "union_seeds": "SELECT c_nationkey AS node FROM {customer} UNION SELECT s_nationkey FROM {supplier} UNION SELECT n_nationkey FROM {nation}",
    "intersect_ids": "SELECT doc_id FROM {documents} INTERSECT SELECT doc_id FROM {labels}",
    "except_ids": "SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}",
    "exact_coverage": "SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS state FROM {documents} d FULL OUTER JOIN {labels} l ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    "duplicate_rows": "SELECT text, count(*) AS n FROM {documents} GROUP BY text HAVING count(*) > 1",
    "distinct_pairs": "SELECT DISTINCT lang, source FROM {documents}",
    "insert_or_ignore": "SELECT min(d.doc_id) AS doc_id FROM {documents} d LEFT ANTI JOIN (SELECT text FROM {documents} WHERE doc_id % 2 = 0) h ON h.text = d.text GROUP BY d.text",
    # predicates and scalars
    "purpose_gate": "SELECT role, count(*) AS turns FROM {conversations} WHERE role IN ('user', 'assistant') GROUP BY role",
    "theme_period_filter": "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-07-01' AND o_orderpriority LIKE '1%'",
    "concept_neighbours": "SELECT CASE WHEN l_suppkey = 1 THEN l_partkey ELSE l_suppkey END AS counterpart, count(*) AS shared FROM {lineitem} WHERE l_suppkey = 1 OR l_partkey = 1 GROUP BY 1",
    "snapshot_projection": "SELECT d.doc_id, d.lang AS collection, d.source AS family, l.quality, l.toxic FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE d.lang IN ('de', 'en')",
    "packet_json": ("SELECT doc_id, to_json(named_struct('doc_id', doc_id, 'quality', quality, 'toxic', toxic)) AS packet FROM {labels}", "SELECT doc_id, CAST(to_json(struct_pack(doc_id := doc_id, quality := quality, toxic := toxic)) AS VARCHAR) AS packet FROM {labels}"),
    "event_props": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}"),
    "journal_windows": (
        "SELECT date_trunc('HOUR', ts) AS window_start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2",
        "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2",
    ),
}
